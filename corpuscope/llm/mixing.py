"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule is the point frac(k * 0.618...) of the golden-ratio sequence, in 31-bit
integers. It falls into one interval of the sources' cumulative weights, and so belongs to a source;
its rank among that source's slots picks a block. A source's documents, shuffled by hash, stand one
after another as a stream of words that is cut into blocks of equally many words; rank r takes block
r mod n_blocks in its pass r div n_blocks. Ranks and places in streams are prefix sums over chunks
that stay of one size as the input grows, so no task sees a whole source.

Defined results: null text and text without words have size 0 and are never taken. A null source is a
source of its own, last in order. Repeated rows count, and are taken, one by one. Equal sort keys fall
to equal rows only, so reruns agree. An empty table gives an empty mix. Extra columns are passed over.
Sources are few (a row for each fits one task); their documents may be any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD, materialize, new_name

#: Weights given to the sources in order, repeating; total of the mix against all words; times a document may be taken.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words in a block; slots and documents in a chunk of the prefix sums; bins of the unit interval.
BLOCK, CHUNK_SLOTS, CHUNK_DOCS, BINS = 128, 1 << 16, 20_000, 4096
#: The modulus and the step nearest to modulus / golden ratio.
_POINTS, _STEP = 1 << 31, 1_327_217_885


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row_key (the column key if given), doc_id, source, size, order (a hash that shuffles): written once, so that keys stay."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row_key = F.col(key) if key else F.monotonically_increasing_id()
    return materialize(docs.select("doc_id", "source", size.alias("size"), _shuffled().alias("order"), row_key.alias("row_key")), "mixing-sized")


def _shuffled() -> F.Column:
    """A document's place in its source's shuffled stream: a hash of all that tells it from others."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws(":", *parts))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK) -> DataFrame:
    """A row for each source: its size, target, blocks, and its interval [lo, hi) of the schedule; n_slots is the schedule's length.

    Targets go by weight; none exceeds repeats times its source's size, and the excess is shared by
    weight among the rest: all sources below their bound get one level times their weight.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    rows = sums.select("source", "source_size", place.alias("place"), weight.alias("weight"), (F.lit(float(repeats)) * F.col("source_size")).alias("most"))
    by_bound = Window.orderBy(F.col("most") / F.col("weight"), "place")
    whole = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    rows = rows.withColumn("level", (F.col("budget") - F.sum("most").over(by_bound) + F.col("most")) / F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
    open_level = F.min_by(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level")), F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("place"))))
    rows = rows.withColumn("level", open_level.over(whole))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    rows = rows.withColumn("target", target).withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    rows = rows.withColumn("n_wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    total, above = F.sum("n_wanted").over(whole), F.sum("n_wanted").over(Window.orderBy("place"))
    edge = lambda x: F.when(total > 0, F.round(x / total * _POINTS)).otherwise(0).cast("long")
    out = rows.select("place", "source", "source_size", "target", "n_blocks", F.round(total).cast("long").alias("n_slots"), edge(above - F.col("n_wanted")).alias("lo"), edge(above).alias("hi"))
    return materialize(out, "mixing-targets")


def schedule(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """slot, place (of the source), pass, block: the mix in its order. Slots beyond a source's last pass stay empty."""
    n = sources.agg(F.max("n_slots")).first()[0] or 0
    spark = sources.sparkSession
    point = (F.col("slot") % _POINTS * _STEP) % _POINTS
    width = _POINTS // BINS
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("bin", F.floor(F.col("point") / width))
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    held = sources.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    dealt = slots.join(held.select("place", "n_blocks", "lo", "hi", "bin"), "bin").where("point >= lo AND point < hi")
    counts = dealt.groupBy("place", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("place", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("own", own).join(bases, ["place", "chunk"]).withColumn("rank", F.col("base") + F.col("own"))
    return ranked.select("slot", "place", F.floor(F.col("rank") / F.col("n_blocks")).alias("pass"), (F.col("rank") % F.col("n_blocks")).alias("block")).where(F.col("pass") < repeats)


def pieces(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """row_key, place, block, word_from, word_to: the part of each document that lies in each block."""
    n_chunks = max(1, -(-sizes.count() // CHUNK_DOCS))
    lead = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = sizes.where("size > 0").withColumn("chunk", F.floor(lead * n_chunks / F.lit(float(1 << 32))))  # ascending as the hash
    sums = dealt.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(F.col("source").alias("of"), F.col("chunk").alias("in"), F.coalesce(before, F.lit(0)).alias("base"))
    own = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("order", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("own", own).join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in")))
    placed = placed.select("row_key", "size", "source", (F.col("base") + F.col("own")).alias("start"))
    named = sources.select(F.col("source").alias("of"), "place")
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("of")))
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    word_from = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    word_to = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return cut.select("row_key", "place", "block", word_from.alias("word_from"), word_to.alias("word_to"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """slot, pass, doc_id, source, word_from, word_to: which words of which document stand at which slot of the mixed stream."""
    sizes = sized(docs)
    sources = targets(sizes, **how)
    stream = schedule(sources, how.get("repeats", REPEATS)).join(pieces(sizes, sources, how.get("block", BLOCK)), ["place", "block"])
    return stream.join(sizes.select("row_key", "doc_id", "source"), "row_key").select("slot", "pass", "doc_id", "source", "word_from", "word_to")


def _taken(sizes: DataFrame, sources: DataFrame, how: dict) -> DataFrame:
    """row_key, pass, words: how many words each pass takes of each document; those are its first words."""
    slots = schedule(sources, how.get("repeats", REPEATS)).select("place", "block", "pass")
    return slots.join(pieces(sizes, sources, how.get("block", BLOCK)), ["place", "block"]).groupBy("row_key", "pass").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("words"))


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words, repeats counted): a row for each row of docs."""
    sizes = sized(docs)
    sources = targets(sizes, **how)
    taken = _taken(sizes, sources, how).groupBy("row_key").agg(F.sum("words").alias("taken"))
    named = sources.select(F.col("source").alias("of"), "source_size", "target")
    out = sizes.join(taken, "row_key", "left").join(named, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a row for each pass that takes of a document, columns unchanged.

    A document that a pass takes wholly keeps its text; the one at the end of its source's share keeps
    its first words, joined by single spaces, and its n_chars follows.
    """
    names = docs.columns
    row, n_words, whole = (new_name(docs, n) for n in ("row", "words", "whole"))
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-docs")
    sizes = sized(keyed, row)
    sources = targets(sizes, **how)
    taken = _taken(sizes, sources, how).join(sizes.select("row_key", "size"), "row_key")
    taken = taken.select(F.col("row_key").alias(row), F.col("words").alias(n_words), (F.col("words") == F.col("size")).alias(whole))
    spaces = r"[\x20\x09-\x0D]+"
    cut = F.array_join(F.slice(F.filter(F.split("text", spaces), lambda w: w != ""), F.lit(1), F.col(n_words).cast("int")), " ")
    out = keyed.join(taken, row).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(cut))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(whole), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out.select(*names)
