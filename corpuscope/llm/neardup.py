"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. Each document becomes a bag of shingles of five words. The shingles' hashes travel, packed by blocks
   of documents, to the bucket of their leading bits, where the document frequency of each is counted,
   and back to their block. Only shingles that two documents share come back; of the others a
   document needs the total weight alone. There are as many buckets as the bytes of all texts ask for:
   one bucket or one block is all that a worker holds, and both grow with the square root of the input, from about 100 GB on.
2. Weight: term frequency times 1 + ln(1 + N/df) / ln(1 + N), from 2 for a shingle of one document to
   little over 1 for one of all. A document whose shared shingles weigh less than the threshold's
   part of its whole weight can't be similar enough to any other, and goes no further.
3. Documents with the same weighted bag are one node from here on, however many they are.
4. Each node gets BANDS * ROWS consistent weighted samples of its bag; bands of ROWS samples are keys.
   Nodes that share a key are first compared with the first of them in a fixed order, and linked to it
   where the weighted Jaccard similarity reaches the threshold.
5. Links join nodes to classes, by rounds of minimum labels over written tables.
6. Within each key all pairs of nodes of different classes are then compared, dealt out by blocks, a
   pair in the first key that it shares; pairs whose classes other links of their block have joined are
   passed over. So each pair that shares a key is verified or lies in one class. A pair at the threshold
   shares a key with probability 1 - (1 - 0.8**5)**24 = 0.9999. The class id is the least doc_id of the class.

Defined results: text without words, or null, has no shingle and is a class of its own; text of
fewer than five words is one shingle. Rows with a null doc_id take part; a class of such rows only has
a null id. Repeated rows give a row each. An empty table gives an empty result. Extra columns are passed over.
Blocks are cut from docs as they come: a task that runs again must see the same rows, as from a scan. Where it
doesn't, the work ends with an error and not with wrong counts.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, new_name, release, small_batches

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
#: Documents and shingles in a block, at most (but one document may be longer); comparisons dealt to one task by one first node.
BLOCK_DOCS, BLOCK_SHINGLES, PER_SALT = 4096, 1 << 20, 500
#: Bytes of text whose shingles meet in one bucket, on average; shingles that a block sends to a bucket, at least, on average.
BUCKET_BYTES, PER_ROW = 4 << 20, 64
#: Nodes of a key, and bytes of their hashes, in a block of those compared among themselves, on average.
SIDE, SIDE_BYTES = 500, 1 << 24
#: Bits for each doc_id that rows to drop have, and bits in all (8 MB), at most.
ID_BITS, MOST_BITS = 16, 1 << 26
_CHUNK = 1 << 20
_U64 = np.uint64
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of the whole text, read in pieces that end at white space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = data[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, _U64)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and how often each occurs."""
    words = word_hashes(text)
    if not len(words):
        return words, np.empty(0, np.uint32)
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, min(len(words), SHINGLE), _U64)
    for j in range(min(SHINGLE, len(words))):
        total += words[j : j + n] * _MUL[j]
    found, often = np.unique(_mix(total), return_counts=True)
    return found, often.astype(np.uint32)


def idf(df, n: int):
    return 1.0 + np.log1p(n / df) / np.log1p(n)


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits, which tell hashes of one bucket apart: as many of them come together at every size of the input."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(data: bytes, bucket: int) -> np.ndarray:
    """Hashes again: the bucket's number stands above the 48 bits."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1) | (_U64(bucket & 0xFFFF) << _U64(48))


_OUT = "bucket int, block long, parts int, n int, docs binary, nulls binary, digests binary, doc binary, hashes binary, often binary"
_BACK = "block long, bucket int, parts int, n int, docs binary, nulls binary, digests binary, alone binary, doc binary, hashes binary, often binary, df binary"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def growth(n_bytes: int) -> float:
    """By how much blocks and buckets exceed their least sizes. Rows of a block and a bucket get shorter as buckets get more, so from about 100 GB on both grow with the square root of the input: some 30 times at 100 TB, or about 1.5 GB in a worker."""
    return max(1.0, math.sqrt(PER_ROW * n_bytes / 6) / BLOCK_SHINGLES)


def _blocks(n_buckets: int, grown: float = 1.0):
    """Packs documents (doc_id, digest, text) into blocks, a row for each bucket that a block has shingles of; the first of them has the documents."""

    def pack(place: str, ids: list, digests: list, bags: list):
        hashes = np.concatenate([b[0] for b in bags])
        often = np.concatenate([b[1] for b in bags])
        doc = np.repeat(np.arange(len(bags), dtype="<u2"), [len(b[0]) for b in bags])
        bucket = ((hashes >> _U64(32)) * _U64(n_buckets) >> _U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        docs = np.array([i or 0 for i in ids], "<i8").tobytes()
        nulls = np.array([i is None for i in ids], "u1").tobytes()
        name = xxhash.xxh3_64(docs + place.encode())
        name.update(hashes.tobytes())
        block = name.intdigest() >> 1
        if not len(found):
            return _arrow([(0, block, 1, len(bags), docs, nulls, b"".join(digests), b"", b"", b"")], _OUT)
        rows = []
        for i, (b, part) in enumerate(zip(found.tolist(), np.split(order, first[1:]), strict=True)):
            own = (docs, nulls, b"".join(digests)) if i == 0 else (None, None, None)
            rows.append((b, block, len(found), len(bags), *own, doc[part].tobytes(), _short(hashes[part]), often[part].tobytes()))
        return _arrow(rows, _OUT)

    def run(batches):
        from pyspark import TaskContext

        number, ids, digests, bags, held = 0, [], [], [], 0
        place = lambda: f"{TaskContext.get().partitionId()}/{number}"
        for batch in batches:
            for doc_id, digest, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                bag = shingles(text.as_py())
                ids.append(doc_id)
                digests.append(digest.as_py() or bytes(16))
                bags.append(bag)
                held += len(bag[0])
                if held >= BLOCK_SHINGLES * grown or len(bags) >= min(BLOCK_DOCS * grown, 1 << 16):
                    yield pack(place(), ids, digests, bags)
                    number, ids, digests, bags, held = number + 1, [], [], [], 0
        if bags:
            yield pack(place(), ids, digests, bags)

    return run


def _groups(batches, *keys: str):
    """Lists of rows (dicts) with the same keys, from batches sorted by them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0].get(k) != row.get(k) for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count_frequencies(batches):
    """For each bucket: the document frequency of each shingle; back go the shared ones, and how many occurrences of others each document has."""
    for rows in _groups(batches, "bucket"):
        hashes = np.concatenate([_long(r["hashes"], r["bucket"]) for r in rows])
        order = np.argsort(hashes)
        run = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0])) if len(hashes) else np.empty(0, np.int64)
        df = np.empty(len(hashes), "<u4")
        df[order] = np.repeat(np.diff(np.append(run, len(hashes))), np.diff(np.append(run, len(hashes))))
        del hashes, order
        at = 0
        for r in rows:
            doc, often = np.frombuffer(r["doc"], "<u2"), np.frombuffer(r["often"], "<u4")
            own = df[at : at + len(doc)]
            at += len(doc)
            shared = own > 1
            lone, n = np.unique(doc[~shared], return_inverse=True)
            alone = np.zeros(len(lone), [("doc", "<u2"), ("n", "<u4")])
            alone["doc"], alone["n"] = lone, np.bincount(n, often[~shared], len(lone))
            kept = np.frombuffer(r["hashes"], np.uint8).reshape(-1, 6)[shared].tobytes()
            yield _arrow([(r["block"], r["bucket"], r["parts"], r["n"], r["docs"], r["nulls"], r["digests"], alone.tobytes(), doc[shared].tobytes(), kept, often[shared].tobytes(), own[shared].tobytes())], _BACK)


_BAG = "doc_id long, digest binary, node binary, weight double, hashes binary, weights binary"


def _bags(n_docs: int, threshold: float):
    """For each block: a row for each document; node and bag are set where it may be similar to another."""

    def run(batches):
        for rows in _groups(batches, "block"):
            rows.sort(key=lambda r: r["docs"] is None)
            if len(rows) != rows[0]["parts"] or rows[0]["docs"] is None:
                raise RuntimeError("a block came back in part: its task ran again on other rows")
            n = rows[0]["n"]
            ids = np.frombuffer(rows[0]["docs"], "<i8").tolist()
            nulls, digests = np.frombuffer(rows[0]["nulls"], "u1"), rows[0]["digests"]
            alone = np.zeros(n)
            for r in rows:
                own = np.frombuffer(r["alone"], [("doc", "<u2"), ("n", "<u4")])
                alone[own["doc"]] += own["n"]
            doc = np.concatenate([np.frombuffer(r["doc"], "<u2") for r in rows])
            hashes = np.concatenate([_long(r["hashes"], r["bucket"]) for r in rows])
            weights = np.concatenate([np.frombuffer(r["often"], "<u4") * idf(np.frombuffer(r["df"], "<u4").astype(float), n_docs) for r in rows]).astype("<f4")
            block, number = rows[0]["block"], len(rows)
            del rows
            order = np.lexsort((hashes, doc))
            edges = np.searchsorted(doc[order], np.arange(n + 1))
            hashes, weights = hashes[order], weights[order]
            out, seen = [], set()
            for i in range(n):
                own, w = hashes[edges[i] : edges[i + 1]], weights[edges[i] : edges[i + 1]]
                shared = float(w.sum(dtype=np.float64))
                total = shared + float(alone[i]) * float(idf(1.0, n_docs))
                doc_id, digest = None if nulls[i] else ids[i], digests[16 * i : 16 * i + 16]
                if not len(own) or shared < threshold * total * (1 - 1e-6):
                    out.append((doc_id, digest, None, total, None, None))
                    continue
                name = xxhash.xxh3_128(own.tobytes())
                name.update(w.tobytes())
                name.update(np.float64(total).tobytes())
                if alone[i]:  # no other document has the same bag
                    name.update(f"{block}/{number}/{i}")
                node = name.digest()
                first = node not in seen  # a bag is sent once for a block
                seen.add(node)
                out.append((doc_id, digest, node, total, own.tobytes() if first else None, w.tobytes() if first else None))
            yield _arrow(out, _BAG)

    return run


@functools.lru_cache(1)
def _pools():
    """Gamma(2, 1) r, ln of Gamma(2, 1) c and uniform beta, to be picked by 16 bits of a hash."""
    rng = np.random.Generator(np.random.PCG64(20))
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
    return r, np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32), rng.random(1 << 16, np.float32), _mix(np.arange(1, 1 << 12, dtype=_U64)) | _U64(1)


def samples(hashes: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples (element and level, as one hash each) of a bag: two bags agree in one with their weighted Jaccard similarity as probability."""
    r_of, c_of, b_of, muls = _pools()
    best, chosen = np.full(k, np.inf, np.float32), np.zeros(k, _U64)
    rows = np.arange(k)
    for at in range(0, len(hashes), 2048):
        h, lw = hashes[at : at + 2048], np.log(weights[at : at + 2048])
        z = (h ^ (h >> _U64(29))) * muls[:k, None]
        r, beta = r_of[z >> _U64(48)], b_of[(z >> _U64(32)) & _U64(0xFFFF)]
        t = np.floor(lw / r + beta)
        a = c_of[(z >> _U64(16)) & _U64(0xFFFF)] - r * (t - beta) - r
        i = np.argmin(a, axis=1)
        least = a[rows, i]
        better = least < best
        best = np.where(better, least, best)
        chosen = np.where(better, _mix(h[i] + t[rows, i].astype(np.int64).astype(_U64) * _MUL[0]), chosen)
    return chosen


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of bags (sorted hashes, weights, whole weight)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    least = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return least / (a[2] + b[2] - least)


def _bag_of(hashes, weights, weight) -> tuple:
    return np.frombuffer(hashes, _U64), np.frombuffer(weights, "<f4"), weight


def bags(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, digest (MD5 of its text), node (null: not similar to any other), weight, and, at least once for each node, its bag."""
    spark = docs.sparkSession
    small_batches(spark)
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sent = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(_blocks(max(parts, int(n_bytes / BUCKET_BYTES / growth(n_bytes)) + 1), growth(n_bytes)), _OUT)
    counted = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(_count_frequencies, _BACK)
    out = counted.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_bags(n_docs, threshold), _BAG)
    out = materialize(out, "neardup-bags")
    release(spark)
    return out


def _keys(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            picked = samples(np.frombuffer(r["hashes"], _U64), np.frombuffer(r["weights"], "<f4"), BANDS * ROWS)
            rows += [(r["node"], band, xxhash.xxh3_64_intdigest(picked[band * ROWS : (band + 1) * ROWS].tobytes()) - (1 << 63)) for band in range(BANDS)]
        if rows:
            yield _arrow(rows, "node binary, band int, key long")


def _against_first(threshold: float):
    """Rows sorted by (first, salt), the first node's own row before the others: verifies each against it."""

    def run(batches):
        now, bag = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = _bag_of(r["hashes"], r["weights"], r["weight"])
                if r["node"] == r["first"]:
                    now, bag = r["first"], own
                elif r["first"] == now:
                    rows.append((r["node"], r["first"], similarity(own, bag) >= threshold))
            if rows:
                yield _arrow(rows, "node binary, first binary, alike boolean")

    return run


def _among_rest(threshold: float):
    """Rows sorted by (band, key, low, high): each is compared with those before it that no link has joined to it yet.

    Where they are given: nodes of one root are joined from the start, blocks low and high are compared
    with each other if they differ, and a pair is left to the first band whose key (of keys) it shares.
    """

    def compared(rows: list[dict]):
        bags = [_bag_of(r["hashes"], r["weights"], r["weight"]) for r in rows]
        weight = np.array([r["weight"] for r in rows])
        ids: dict[bytes, int] = {}
        root = np.array([ids.setdefault(r.get("root", r["node"]), len(ids)) for r in rows])
        block = np.array([r.get("block", 0) for r in rows])
        keys = np.array([r["keys"] for r in rows]) if "keys" in rows[0] else None
        apart = rows[0].get("low") != rows[0].get("high")
        for i in range(1, len(rows)):
            may = (root[:i] != root[i]) & (np.minimum(weight[:i], weight[i]) >= threshold * np.maximum(weight[:i], weight[i]) * (1 - 1e-6))
            if apart:
                may &= block[:i] != block[i]
            if keys is not None:
                may &= np.argmax(keys[:i] == keys[i], axis=1) == rows[i]["band"]
            for j in np.flatnonzero(may):
                if root[j] != root[i] and similarity(bags[i], bags[j]) >= threshold:
                    root[root == root[j]] = root[i]
                    yield rows[i]["node"], rows[j]["node"]

    def run(batches):
        for rows in _groups(batches, "band", "key", "low", "high"):
            found = list(compared(rows))
            if found:
                yield _arrow(found, "node binary, first binary")

    return run


def candidates(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their bags, and for each node and band: node, band, key and the first node of the key (null: the key has no other node)."""
    spark = held.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    nodes = held.where("hashes IS NOT NULL").groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("weights").alias("weights"), F.first("weight").alias("weight"))
    nodes = materialize(nodes, "neardup-nodes")
    keys = materialize(nodes.repartition(parts, "node").mapInArrow(_keys, "node binary, band int, key long"), "neardup-keys")
    firsts = keys.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    return nodes, materialize(keys.join(firsts.drop("n"), ["band", "key"], "left"), "neardup-met")


def links(nodes: DataFrame, met: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified pairs (a, b) of a node and the first node of a key."""
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = met.where("node != first").select("node", "first").distinct()
    salts = F.ceil(F.count("*") / PER_SALT).cast("int")
    dealt = pairs.groupBy("first").agg(salts.alias("salts"))
    members = pairs.join(dealt, "first").select("node", "first", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    heads = dealt.select(F.col("first").alias("node"), "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    whole = members.unionByName(heads).join(nodes, "node")
    dealt_out = whole.repartition(parts, "first", "salt").sortWithinPartitions("first", "salt", F.col("node") != F.col("first"))
    checked = dealt_out.select("node", "first", "hashes", "weights", "weight").mapInArrow(_against_first(threshold), "node binary, first binary, alike boolean")
    out = materialize(checked.where("alike").select(F.col("node").alias("a"), F.col("first").alias("b")), "neardup-links")
    release(spark)
    return out


def links_across(nodes: DataFrame, met: DataFrame, roots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of roots that all verified pairs of nodes across components join.

    All nodes of a key but the first, which links has compared with all, are dealt to blocks: those of its
    largest component to blocks of their own, which aren't compared with each other.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sizes = nodes.select("node", F.length("hashes").alias("bytes"))
    rest = met.where("node != first").select("node", "band", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes, "node")
    sums = rest.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    groups = sums.groupBy("band", "key").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / SIDE, size / SIDE_BYTES)).cast("int")
    small = (F.col("n") <= SIDE) & (F.col("bytes") <= SIDE_BYTES)
    minor = F.when(small, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")))
    major = F.when(small, 0).otherwise(blocks(F.col("top.n"), F.col("top.bytes")))
    groups = groups.select("band", "key", F.col("top.root").alias("top"), minor.alias("minor"), major.alias("major"))
    large = (F.col("root") == F.col("top")) & (F.col("major") > 0)
    place = lambda n: F.pmod(F.xxhash64("node", "band"), n).cast("int")
    dealt = rest.drop("bytes").join(groups, ["band", "key"]).withColumn("block", F.when(large, F.col("minor") + place(F.greatest("major", F.lit(1)))).otherwise(place(F.col("minor"))))
    others = F.sequence(F.lit(0), F.when(large, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    all_keys = met.join(dealt.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "key"))), lambda k: k["key"]).alias("keys"))
    whole = dealt.select("node", "band", "key", "low", "high", "block", "root").join(nodes.join(all_keys, "node"), "node")
    found = whole.repartition(parts, "band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high", "node").mapInArrow(_among_rest(threshold), "node binary, first binary")
    found = materialize(found.distinct(), "neardup-across")
    release(spark)
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in ("node", "first"))
    named = found.join(a, "node", "left").join(b, "first", "left")
    return named.select(F.coalesce("root_node", "node").alias("a"), F.coalesce("root_first", "first").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component. Each round hangs every node's neighbours to the least of them (large star, then small star) until nothing changes."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        hung = joined.where("b > a") if large else joined.where("b != m")
        own = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        extra = least.where("a != m").select("a", F.col("m").alias("b"))
        return own.unionByName(extra).where("a != b").distinct()

    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        now = materialize(star(star(now, True), False), "neardup-stars")
        release(spark)
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, digest, node), and the root of each node."""
    held = bags(docs, threshold)
    nodes, met = candidates(held)
    roots = components(links(nodes, met, threshold))
    joined = components(links_across(nodes, met, roots, threshold)).select(F.col("node").alias("root"), F.col("root").alias("over"))
    rooted = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(joined, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return held.select("doc_id", "digest", "node"), rooted


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size: a row for each row of docs."""
    held, rooted = _classes(docs, threshold)
    by_node = held.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = rooted.join(by_node, "node")
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = materialize(rooted.select("node", "root").join(classes, "root").select("node", "class_id", "class_size"), "neardup-classes")
    out = held.select("doc_id", "node").join(named, "node", "left")
    return out.select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def _parted(docs: DataFrame, ids: DataFrame, n_ids: int) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows whose doc_id is none of the n_ids ids for certain, and all others, which are few while ids are.

    A bit is set for the hash of each id. The bits are broadcast, so the first part's texts needn't be shuffled. There are
    ID_BITS for each id, and MOST_BITS at most; beyond, the second part grows until it has all rows.
    """
    bits = min(MOST_BITS, ID_BITS * max(n_ids, 1))
    bucket, bitmap = new_name(docs, "bucket"), new_name(docs, "bitmap")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmaps = ids.groupBy(F.bitmap_bucket_number(place(ids["doc_id"])).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(ids["doc_id"]))).alias(bitmap))
    at = F.bitmap_bit_position(place(docs["doc_id"]))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = docs.join(F.broadcast(bitmaps), F.bitmap_bucket_number(place(docs["doc_id"])) == F.col(bucket), "left")
    return marked.where(~is_set).drop(bucket, bitmap), marked.where(is_set).drop(bucket, bitmap)


def keep_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (null last), then of the least digest of the text.

    Of rows that share both doc_id and text one stays, whichever; texts without words all stay. Columns and other rows are untouched.
    """
    held, rooted = _classes(docs, threshold)
    rows = held.where("node IS NOT NULL").groupBy("node", "doc_id", "digest").agg(F.count("*").alias("n")).join(rooted, "node")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")
    firsts = rows.groupBy("root").agg(F.min(order).alias("first"), F.sum("n").alias("size")).where("size > 1")
    found = rows.join(firsts, "root").select("doc_id", "digest", "n", (order == F.col("first")).alias("stays"))
    found = materialize(found.where("NOT stays OR n > 1"), "neardup-drop")
    n_found, n_several = found.agg(F.count("*"), F.count_if("stays")).first()
    others, docs = _parted(docs, found.select("doc_id"), n_found)
    key, digest = new_name(docs, "key"), new_name(docs, "digest")
    named = found.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), "stays")
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.unhex(F.md5(docs["text"])) == F.col(digest))
    kept = docs.join(named.where("NOT stays").drop("stays"), same, "left_anti")
    if n_several:
        several = named.where("stays").drop("stays")
        kept = kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return others.unionByName(kept)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For tables in which doc_id is a key: docs with one document of each class, the one whose doc_id names it; of rows that repeat a doc_id one stays, rows with a null doc_id all stay. keep_rows goes by row instead."""
    found = near_duplicates(docs, threshold)
    drop = found.where("doc_id != class_id").select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti")
    several = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
