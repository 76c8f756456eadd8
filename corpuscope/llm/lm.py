"""Language-model scores by stupid backoff over bigrams, computed relationally.

Each document's score is the sum over its words of ln S(word | word before), where, with counts c' of
the whole corpus without the document itself,

    S(w | v) = c'(v w) / c'(v)            if c'(v w) > 0
             = BACKOFF * c'(w) / N'       otherwise, with 1/2 for c'(w) = 0,

N' is the number of words and the word before a document's first one is a mark of its own. The
document is left out of its counts, else no bigram of the corpus would ever be unseen.

1. Blocks of documents are written as packed rows: their words, their distinct bigrams, and which
   document holds which bigram how often. A block bounds what a worker holds, and counts its n-grams before any shuffle.
2. Each block's n-grams, known by 64-bit hashes of words and bigrams, travel sorted and in arrays, a row for each
   bucket of the hash, and are exploded where they arrive to rows (bucket, gram, block, place, n).
   Summed by gram they are the count table, which grows with the corpus and is partitioned by hash.
3. The count table is joined to the exploded n-grams, on the partitioning that both have already, so that each block gets the
   totals of its n-grams, by place. While partitions are small, the count table's part is hashed and the n-grams pass by it unsorted. An n-gram of all documents has one row a block, however often it occurs; one that
   stands in no other block needs none.
4. The totals are packed by block. Each block meets its own, and its documents' scores are summed up.

Spark does the aggregation, the join and all shuffles. N-grams that share a bucket and the 48 bits of a hash beside it add up their counts: about one
pair among 20 million n-grams of one bucket, and so a share of n-grams that no score shows.

Defined results: null text and text without words have n_words 0, score 0 and a null mean. Repeated rows give
a row each, and count as documents of their own. Extra columns are passed over.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, release, small_batches
from corpuscope.llm.neardup import _MUL, _U64, _arrow, _mix, word_hashes

BACKOFF = 0.4
#: Documents and words in a block, at most (but one document may be longer); buckets for each partition of n-grams, so that partitions get even parts.
BLOCK_DOCS, BLOCK_WORDS, BUCKETS = 1 << 14, 1 << 19, 8
#: Partitions of n-grams for each shuffle partition, as the rows there take many times the bytes that were shuffled.
PARTS = 2
#: Words for each partition of n-grams up to which counts are hashed for the join: one for each word would take some 250 MB. Above, Spark sorts, as what is sorted can spill.
HASHED_WORDS = 1 << 21
#: Totals that are packed at once.
HELD = 1 << 19
#: Stands before the first word of a document.
_BEGIN = _U64(0x1D8AF066F3A1B2C5)


def _pack(values: np.ndarray, dtype: str) -> bytes:
    """Small numbers, compressed: their lowest bytes first, then the next ones, and so on."""
    planes = np.ascontiguousarray(values.astype(dtype)).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


_BLOCK = "block long, n_docs int, n_words long, docs binary, nulls binary, sizes binary, words binary, often binary, before binary, word binary, entries binary, pair binary, count binary"


def _packed(number: int, ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
    """A block: distinct words (ascending hashes) with counts, distinct bigrams (places of two words, ascending), and for each document its bigrams (places, ascending) with counts."""
    sizes = np.array([len(d) for d in docs])
    full = [np.concatenate([[_BEGIN], d]) if len(d) else d for d in docs]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in full])
    words, place, often = np.unique(np.concatenate(full), return_inverse=True, return_counts=True)
    del full
    within = doc[1:] == doc[:-1]
    bits = max(1, int(len(words)).bit_length())
    code = (place[:-1][within] << bits) | place[1:][within]
    pairs, at = np.unique(code, return_inverse=True)
    wide = max(1, int(len(pairs)).bit_length())
    entry, count = np.unique((doc[1:][within] << wide) | at, return_counts=True)
    entries = np.bincount(entry >> wide, minlength=len(docs))
    pair = entry & ((1 << wide) - 1)
    step = np.diff(pair, prepend=0)
    first = (np.cumsum(entries) - entries)[entries > 0]
    step[first] = pair[first]
    ids_ = np.array([i or 0 for i in ids], "<i8").tobytes()
    nulls = np.array([i is None for i in ids], "u1").tobytes()
    before, word = pairs >> bits, pairs & ((1 << bits) - 1)
    packed = (_pack(sizes, "<u4"), words.tobytes(), _pack(often, "<u4"), _pack(np.diff(before, prepend=0), "<u4"), _pack(word, "<u4"), _pack(entries, "<u4"), _pack(step, "<u4"), _pack(count, "<u4"))
    return _arrow([(number, len(docs), int(sizes.sum()), ids_, nulls, *packed)], _BLOCK)


def _blocks(batches):
    """Cuts a partition's (doc_id, text) rows into blocks."""
    from pyspark import TaskContext

    number, ids, docs, held = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            docs.append(word_hashes(text.as_py()))
            held += len(docs[-1])
            if held >= BLOCK_WORDS or len(docs) >= BLOCK_DOCS:
                yield _packed(number, ids, docs)
                number, ids, docs, held = number + 1, [], [], 0
    if docs:
        yield _packed(number, ids, docs)


class _Block:
    """A row of the block table, unpacked."""

    def __init__(self, row: dict):
        number = lambda k: _unpack(row[k], "<u4").astype(np.int64)
        self.words, self.often = np.frombuffer(row["words"], _U64), number("often")
        self.before, self.word = np.cumsum(number("before")), number("word")
        self.sizes, self.entries, self.count = number("sizes"), number("entries"), number("count")
        run = np.cumsum(number("pair"))
        first = np.cumsum(self.entries) - self.entries
        self.doc = np.repeat(np.arange(len(self.sizes)), self.entries)
        self.pair = run - np.repeat(np.where(first > 0, run[np.maximum(first, 1) - 1], 0) if len(run) else first, self.entries)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, then of all bigrams, how often each occurs in the block, and their places in the order of the hashes."""
        bigrams = _mix(self.words[self.before] * _MUL[0] + self.words[self.word] * _MUL[1] + _MUL[2])
        grams = np.concatenate([self.words, bigrams])
        return grams, np.concatenate([self.often, np.bincount(self.pair, self.count, len(self.word)).astype(np.int64)]), np.argsort(grams)


#: An n-gram travels as the low 48 bits of its hash beside its bucket, which tells the high ones as far as it is one of many.
_GRAMS = "bucket int, origin struct<block:bigint,first:int>, low array<int>, high array<smallint>, often array<tinyint>"
#: A count that one entry carries, at most; an n-gram that occurs more often in a block has several entries.
_MOST = 127


def _entries(grams: np.ndarray, often: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's grams() in the order of their hashes as entries (hash, count up to _MOST), and which of them each is."""
    often = often[order]
    times = -(-often // _MOST)
    last = np.cumsum(times) - 1
    counts = np.full(int(times.sum()), _MOST, np.int8)
    counts[last] = often - (times - 1) * _MOST
    order = np.repeat(order, times)
    return grams[order], counts, order


def _sent(n_buckets: int):
    """The n-grams of each block by bucket: those from place first of the block on, in the order of their hashes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams, often = _entries(*_Block(row).grams())[:2]
                bucket = ((grams >> _U64(32)) * _U64(n_buckets) >> _U64(32)).astype(np.int32)
                found, first = np.unique(bucket, return_index=True)
                ends = pa.array(np.append(first, len(grams)), pa.int32())
                low, high = grams.astype(np.uint32).view(np.int32), (grams >> _U64(32)).astype(np.uint16).view(np.int16)
                arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (low, high, often)]
                origin = pa.StructArray.from_arrays([pa.array(np.full(len(found), row["block"])), pa.array(first.astype(np.int32))], ["block", "first"])
                yield pa.RecordBatch.from_arrays([pa.array(found), origin, *arrays], ["bucket", "origin", "low", "high", "often"])

    return run


_TOTALS = "block long, at binary, total binary"


def _by_block(batches):
    """Rows (block, place, total), a block's rows or at least a bucket's together, packed by block: places and totals."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, at, total = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(3))
        order = np.lexsort((at, block))
        block, at, total = block[order], at[order], total[order]
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)]
        return _arrow([(int(block[a]), _pack(np.diff(at[a:b], prepend=0), "<u4"), _pack(total[a:b], "<u8")) for a, b in zip(edges, edges[1:])], _TOTALS)

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _own(doc: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each entry's word before and its word occur in its own document; the begin mark, which follows no word, once."""
    key, inverse = np.unique(doc * n + word, return_inverse=True)
    if not len(key):
        return np.empty(0), np.empty(0)
    often, wanted = np.bincount(inverse, count), doc * n + before
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return np.where(key[at] == wanted, often[at], 1), often[inverse]


_SCORE = "doc_id long, n_words long, score double"


def _score(total: int, backoff: float):
    """A block and the totals of its n-grams: the sums of its documents."""

    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b = _Block(row)
        grams = b.grams()
        counts, order = grams[1].astype(float), _entries(*grams)[2]
        for r in totals.to_pylist():
            counts[order[np.cumsum(_unpack(r["at"], "<u4").astype(np.int64))]] = _unpack(r["total"], "<u8")
        n_words = len(b.words)
        before, word = b.before[b.pair], b.word[b.pair]
        pairs = counts[n_words + b.pair] - b.count
        own_before, own_word = _own(b.doc, before, word, b.count, n_words)
        context, single = counts[before] - own_before, counts[word] - own_word
        rest = np.maximum(total - b.sizes[b.doc], 1)
        seen = (pairs > 0) & (context > 0)
        chance = np.where(seen, pairs / np.maximum(context, 1), backoff * np.maximum(single, 0.5) / rest)
        score = np.bincount(b.doc, b.count * np.log(chance), len(b.sizes)).astype(float)
        ids, nulls = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["nulls"], "u1") != 0
        return pa.table([pa.array(ids, pa.int64(), mask=nulls), pa.array(b.sizes, pa.int64()), pa.array(score)], ["doc_id", "n_words", "score"])

    return run


@contextlib.contextmanager
def _co_located(spark: SparkSession):
    """Joins on (bucket, gram) take sides that are partitioned by bucket as they are, and both sides read one exchange. Batches of their short rows are bounded by bytes alone.
    Counts go to one map: half of all n-grams differ, so the small one that Spark puts before it is searched in vain."""
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.codegen.aggregate.map.twolevel.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 18)}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def score(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, score (sum of ln S), mean (score for each word): a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(_blocks, _BLOCK), "lm-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = PARTS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = blocks.select(*[f.split()[0] for f in _BLOCK.split(", ")]).mapInArrow(_sent(BUCKETS * parts), _GRAMS)
    each = packed.repartition(parts, "bucket").select("*", F.posexplode("low").alias("at", "part"))
    # sums, as the lower parts may be negative: another number for each of them. The bucket stands above, so that one number sorts a bucket's rows together
    gram = F.shiftleft(F.col("bucket").cast("long"), 48) + F.shiftleft(F.get("high", F.col("at")).cast("long"), 32) + F.col("part")
    grams = each.select("bucket", gram.alias("gram"), "origin", "at", F.get("often", F.col("at")).alias("n"))
    counts = grams.groupBy("gram", "bucket").agg(F.sum("n").alias("total"), F.count("origin").alias("blocks")).where("blocks > 1")
    # rows are short; counts takes the whole origin, so that both sides still read one exchange
    rows = grams.select("gram", "bucket", F.col("origin.block").alias("block"), (F.col("origin.first") + F.col("at")).alias("place"), "n")
    if total <= HASHED_WORDS * parts:
        counts = counts.hint("shuffle_hash")
    totals = rows.join(counts, ["gram", "bucket"]).where("total > n").select("block", "place", "total")
    with _co_located(spark):
        totals = materialize(totals.mapInArrow(_by_block, _TOTALS), "lm-totals")
    del packed, each, grams, counts, rows
    release(spark)
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score(total, backoff), _SCORE)
    return scored.withColumn("mean", F.try_divide("score", "n_words"))
