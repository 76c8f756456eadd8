"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if any string of `length` bytes that covers it also starts anywhere else. What has to be
known is which suffixes agree in their first `length` bytes, so suffixes are sorted to that depth, one
bucket at a time:

* Buckets. Among the 32-byte grams of the string at each start, the one with the least hash is its
  anchor (the leftmost of equals). Equal strings have equal anchors at equal offsets, so only suffixes with
  one anchor need to be compared. Starts that follow each other and have one anchor form a piece: its
  bytes reach from the first start to the end of the last one's string.
* Pre-aggregation. Pieces with the same bytes are counted first. A piece that occurs twice is repeated as
  a whole; one whose anchor occurs nowhere else isn't repeated at all. Only the distinct pieces of
  buckets in which some piece is alone go on: these are the ends of repeated passages.
* Blocks. A task lays the pieces of one bucket after another into blocks of bounded size, with anchors at
  multiples of the period 40. Two suffixes that can be equal then lie a multiple of the period apart, for
  which the multiples of 40 are a difference cover. The ranks of these cover samples to depth 160 are
  computed first, by sorting depth 40 and doubling. Suffixes are then ordered by bucket, offset and the
  rank of the sample that follows, and only ties by the 40 bytes which that rank leaves out.
* Buckets with many distinct pieces are split by more of what their suffixes have in common. The offsets of the
  anchor fall into classes of close ones; all strings of a class hold the same longer stretch around the anchor, and equal
  strings have equal stretches. So a piece is cut by classes, and each part goes to the one bucket of its stretch. Parts whose
  bucket is still too large, because most of the string is shared, are settled string by string, counted by a hash.
* A document is known by 128 bits of hashes of doc_id and text.

Defined results: null text is empty. Repeated rows, and rows that share a doc_id, are documents of their own,
and so copies of each other. Strings never cross documents. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, release, small_batches

LENGTH, GRAM, PERIOD = 200, 32, 40
_REACH = LENGTH - GRAM
#: Bytes hashed at once; bytes of pieces sorted at once; distinct pieces of a bucket that is sorted as a whole; classes of offsets where it isn't.
BUFFER, BLOCK, PER_SALT, CLASSES = 1 << 18, 2 << 20, 5_000, 8
_U64 = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, _U64)
_FACTORS = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, 5, _U64) * _U64(2) + _U64(1)
_LOW = _U64((1 << 24) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, width = _TABLE[data], 1
    for factor in _FACTORS:
        h = h[:-width] * factor + h[width:]
        width *= 2
    h = (h ^ (h >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a whole string in data: the place of its anchor; and the hash at each place."""
    h = _grams(data)
    least = (h & ~_LOW) | np.arange(len(h), dtype=_U64)
    width = 1
    while 2 * width <= _REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _REACH + 1 - width
    return (np.minimum(least[: len(least) - rest], least[rest:]) & _LOW).astype(np.int64), h


_PIECE = "row long, row2 long, anchor long, h1 long, h2 long, start long, n int, offset int"


def _pieces(batches):
    """Pieces of each document (row, row2, text): place of the first start, number of starts, offset of the anchor."""
    for batch in batches:
        rows, texts = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2)
        at = 0
        while at < len(rows):
            # documents are laid side by side; long ones are cut, where pieces may be cut too
            parts, size = [], 0
            while at < len(rows) and size < BUFFER:
                data = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
                for cut in range(0, max(1, len(data) - LENGTH + 1), 1 << 22):
                    part = data[cut : cut + (1 << 22) + LENGTH - 1]
                    if len(part) >= LENGTH:
                        parts.append((rows[at], cut, part))
                        size += len(part)
                    if size >= 1 << 23:
                        yield _pieces_of(parts)
                        parts, size = [], 0
                at += 1
            if parts:
                yield _pieces_of(parts)


def _pieces_of(parts: list) -> pa.RecordBatch:
    joined = b"".join(p[2] for p in parts)
    place, h = anchors(np.frombuffer(joined, np.uint8))
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = np.zeros(len(place), bool)
    first = np.zeros(len(place) + 1, bool)
    for b, n in zip(begin, sizes):
        whole[b : b + n - LENGTH + 1] = True
        first[b] = True
    new = whole & (first[:-1] | np.concatenate([[True], place[1:] != place[:-1]]))
    start = np.flatnonzero(new)
    ends = np.concatenate([start[1:], [len(place)]])
    last = begin[np.searchsorted(begin, start, "right") - 1]
    doc = np.searchsorted(begin, start, "right") - 1
    n = np.minimum(ends, begin[doc] + sizes[doc] - LENGTH + 1) - start
    digests = b"".join([xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(start.tolist(), (start + n + LENGTH - 1).tolist())])
    two = np.frombuffer(digests, "<i8").reshape(-1, 2)
    row, row2 = np.array([p[0] for p in parts], np.int64)[doc].T
    shift = np.array([p[1] for p in parts], np.int64)[doc] - last
    columns = (row, row2, h[place[start]].view(np.int64), two[:, 0], two[:, 1], start + shift, n.astype(np.int32), (place[start] - start).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[f.split()[0] for f in _PIECE.split(", ")])


_WANTED = "array<struct<anchor:bigint,n:int,offset:int,start:bigint,often:bigint,hot:boolean>>"
_BYTES = "bucket long, row long, row2 long, start long, n int, offset int, often long, data binary"


def _batches(rows: list[tuple], size: int = 5000):
    names = [f.split()[0] for f in _BYTES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds, strict=True)], names)


def _classed(anchor: int, start: int, n: int, offset: int, piece: bytes):
    """(bucket, start, n, offset, data) of the parts of a piece whose anchor's offsets fall into one class: the bucket is a hash of the class and of the bytes that all its strings share."""
    width = -(-(_REACH + 1) // CLASSES)
    for c in range((offset - n + 1) // width, offset // width + 1):
        low, high = c * width, min(c * width + width - 1, _REACH)
        first, last = max(0, offset - high), min(n - 1, offset - low)  # starts of the piece, whose anchor's offset falls as they go on
        core = piece[offset - low : offset - high + LENGTH]
        bucket = xxhash.xxh3_64_intdigest(anchor.to_bytes(8, "little", signed=True) + bytes([c]) + core) - (1 << 63)
        yield bucket, start + first, last - first + 1, offset - first, piece[first : last + LENGTH]


def _cut(batches):
    """The bytes of the wanted pieces of each document (row, row2, text, wanted); those of hot anchors by classes of offsets."""
    for batch in batches:
        for row, row2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            data, out = text.as_py().encode("utf-8", "surrogatepass"), []
            for w in wanted.as_py():
                piece = data[w["start"] : w["start"] + w["n"] + LENGTH - 1]
                parts = _classed(w["anchor"], w["start"], w["n"], w["offset"], piece) if w["hot"] else [(w["anchor"], w["start"], w["n"], w["offset"], piece)]
                out += [(bucket, row, row2, start, n, offset, w["often"], part) for bucket, start, n, offset, part in parts]
                if len(out) >= 5000:
                    yield from _batches(out)
                    out = []
            yield from _batches(out)


def _strings(batches):
    """Each string of the parts of buckets that are still too large, by 128 bits of its hash."""
    names = ["h1", "h2", "row", "row2", "from", "often"]
    for batch in batches:
        for r in batch.to_pylist():
            digests = b"".join(xxhash.xxh3_128_digest(r["data"][i : i + LENGTH]) for i in range(r["n"]))
            two = np.frombuffer(digests, "<i8").reshape(-1, 2)
            columns = (two[:, 0], two[:, 1], np.full(r["n"], r["row"]), np.full(r["n"], r["row2"]), r["start"] + np.arange(r["n"]), np.full(r["n"], r["often"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _repeated(rows: list[dict]) -> list[tuple[int, int, int, int]]:
    """(row, row2, first, end) of runs of starts, in pieces that occur once, whose string occurs in another piece of the block's buckets too."""
    text_size = PERIOD
    places = []
    for r in rows:
        at = text_size + (-(text_size + r["offset"])) % PERIOD  # the anchor falls on a multiple of the period
        places.append(at)
        text_size = at + len(r["data"])
    text_size += -text_size % PERIOD + 6 * PERIOD
    text = np.zeros(text_size, np.uint8)
    for r, at in zip(rows, places):
        text[at : at + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
    rank = _ranks(text.view(f"S{PERIOD}"))
    for step in (1, 2):
        high = np.int64(rank.max() + 2)
        after = np.concatenate([rank[step:], np.full(step, -1)]) + 1
        rank = _ranks(rank * high + after)
    count = np.array([r["n"] for r in rows])
    owner = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.array(places)[owner] + nth
    offset = np.array([r["offset"] for r in rows])[owner] - nth
    bucket = _ranks(np.array([r["bucket"] for r in rows]))[owner]
    sample = -(-at // PERIOD)
    group = _ranks((bucket * (_REACH + 1) + offset) * np.int64(rank.max() + 1) + rank[sample])
    tied = np.bincount(group, minlength=1)[group] > 1
    owner, at, group, sample = owner[tied], at[tied], group[tied], sample[tied]
    if not len(at):
        return []
    left_out = np.arange(PERIOD)
    head = sample * PERIOD - at
    rest = np.empty((len(at), PERIOD + 8), np.uint8)
    for i in range(0, len(at), 1 << 16):
        s = slice(i, i + (1 << 16))
        rest[s, 8:] = text[at[s, None] + left_out + (left_out >= head[s, None]) * (LENGTH - PERIOD)]
    rest[:, :8] = group.astype(">i8").view(np.uint8).reshape(-1, 8)
    same = _ranks(rest.view(f"S{PERIOD + 8}").reshape(-1))
    hit = np.bincount(same)[same] > 1
    hit &= np.array([r["often"] for r in rows])[owner] == 1
    owner, at = owner[hit], at[hit]
    if not len(at):
        return []
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    end = np.concatenate([edge[1:], [len(at)]]) - 1
    out = []
    for a, b in zip(edge, end):
        r, base = rows[owner[a]], places[owner[a]]
        out.append((r["row"], r["row2"], r["start"] + int(at[a]) - base, r["start"] + int(at[b]) - base + LENGTH))
    return out


def _sort_blocks(batches):
    """Rows sorted by bucket: whole buckets, in blocks of about BLOCK bytes."""

    def flush(rows):
        found = _repeated(rows)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["row", "row2", "from", "to"])

    held, size, bucket = [], 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                bucket = r["bucket"]
                if size >= BLOCK:
                    yield flush(held)
                    held, size = [], 0
            held.append(r)
            size += len(r["data"])
    if held:
        yield flush(held)


def _keyed() -> list[F.Column]:
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit("row2"), "text", "doc_id").alias("row2")]


_SPAN = "row long, row2 long, `from` long, `to` long"


def repeats(docs: DataFrame) -> DataFrame:
    """row, row2 (hashes of doc_id and text), from, to: bytes covered by repeated strings; spans may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(*_keyed(), "text").where(F.octet_length("text") >= LENGTH)
    pieces = materialize(keyed.mapInArrow(_pieces, _PIECE), "substrings-pieces")
    often = materialize(pieces.groupBy("anchor").count().where("count > 1").select("anchor"), "substrings-anchors")
    met = materialize(pieces.join(often, "anchor", "left_semi"), "substrings-met")
    release(spark)
    key = ["anchor", "h1", "h2"]
    distinct = materialize(met.groupBy(*key).agg(F.count("*").alias("often"), F.min(F.struct("row", "row2", "start", "n", "offset")).alias("at")), "substrings-distinct")
    twice = distinct.where("often > 1").select(*key)
    whole = met.join(twice, key, "left_semi").select("row", "row2", F.col("start").alias("from"), (F.col("start") + F.col("n") + LENGTH - 1).alias("to"))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.min("often").alias("least")).where("m > 1 AND least = 1")
    several = materialize(several.select("anchor", (F.col("m") > PER_SALT).alias("hot")), "substrings-several")
    open_ = distinct.join(several, "anchor")
    one = F.struct("anchor", F.col("at.n").alias("n"), F.col("at.offset").alias("offset"), F.col("at.start").alias("start"), "often", "hot")
    wanted = open_.groupBy(F.col("at.row").alias("row"), F.col("at.row2").alias("row2")).agg(F.collect_list(one).cast(_WANTED).alias("wanted"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = keyed.join(wanted, ["row", "row2"]).mapInArrow(_cut, _BYTES)
    sort = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks, _SPAN)
    if several.where("hot").isEmpty():
        found = sort(cut)
    else:
        cut = materialize(cut, "substrings-parts")
        large = materialize(cut.groupBy("bucket").count().where(F.col("count") > PER_SALT).select("bucket"), "substrings-large")
        strings = cut.join(large, "bucket", "left_semi").mapInArrow(_strings, "h1 long, h2 long, row long, row2 long, `from` long, often long")
        again = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        again = strings.where("often = 1").join(again, ["h1", "h2"], "left_semi").select("row", "row2", "from", (F.col("from") + LENGTH).alias("to"))
        found = sort(cut.join(large, "bucket", "left_anti")).unionByName(again)
    out = materialize(whole.unionByName(found), "substrings-spans")
    release(spark)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (disjoint ascending spans of bytes), kept_sha256, kept (the bytes that stay): a row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeats(docs).groupBy("row", "row2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = docs.select(*_keyed(), "doc_id", "text").join(spans, ["row", "row2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            sizes, removed, digests, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["from"], s["to"]) for s in found.as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                sizes.append(len(data))
                removed.append([{"from": a, "to": b} for a, b in merged])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(digests), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<`from`:bigint,`to`:bigint>>, kept_sha256 string, kept binary")
