"""From a query log to feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.columns import evaluation_key, feature_vector, log_scaled
from corpuscope.functions.cql import cql_parse, once
from corpuscope.operators import dataset, normalize
from corpuscope.sources.scratch import written

_PARSED = ("positions", "numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining", "alignedPart")


def parsed(rows: DataFrame, query: str, lang: str) -> DataFrame:
    """rows with __p, what the parser says of each; each query is parsed once for each language, however often it occurs. In a stream each row is parsed."""
    return once(rows, {"__q": query, "__lang": lang}, __p=cql_parse("__q", "__lang"))


def evaluate(rows: DataFrame, query: str = "cql", lang: str = "lang", size: str = "corpusSize", subcorpus: str = "subcorpusSize", time: str = "timeProc") -> DataFrame:
    """rows with the evaluation of their queries, and error for those that can't be parsed. Rows without a query go."""
    keep = [c for c in rows.columns if c not in (query, size, subcorpus, time)]
    joined = parsed(rows.where(F.col(query).isNotNull()), query, lang)
    own = [F.col(time).cast("double").alias("procTime"), F.col(query).alias("q"), log_scaled(size).alias("__size"), log_scaled(subcorpus).alias("__sub")]
    out = joined.select(*keep, *own, F.col("__p.error").alias("error"), *[F.col(f"__p.{c}").alias(c) for c in _PARSED])
    return out.withColumnsRenamed({"__size": "corpusSize", "__sub": "namedSubcorpusSize"})


def featurize(log: DataFrame, corpora: DataFrame, correction: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Feature rows, one for each query and corpus size, and their counters (num_processed, num_failed, num_features, dedup_ratio)."""
    counts = normalize.counters(log, corpora)
    rows = normalize.valid_rows(log, corpora, correction).withColumn("id", F.xxhash64("corpus", "query", "timeProc", "corpusSize", "subcorpusSize"))
    rows = evaluate(rows).where("error IS NULL").drop("error")
    keyed = rows.withColumn("uniq_key", evaluation_key("q", "corpusSize"))
    keyed = written(keyed, "evaluated")  # ranges are sampled before rows are dealt to them, and the parser should run once
    unique = dataset.deduplicate(keyed, "uniq_key").withColumn("features", feature_vector())
    size = unique.agg(F.count("*").alias("num_features"))
    stats = counts.join(size).withColumn("dedup_ratio", F.try_divide("num_features", "num_processed"))
    return unique, stats
