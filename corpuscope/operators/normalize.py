"""Repair and filters of query logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.columns import log_key, strip_prefix


def repair_size(log: DataFrame, corpora: DataFrame) -> DataFrame:
    """Sizes that are missing come from the corpora, and lang with them; known is false where there is still none."""
    catalog = corpora.select(F.col("corpus").alias("__corpus"), F.col("size").alias("__size"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = log.join(catalog, F.col("corpus") == F.col("__corpus"), "left")
    size = F.when(F.col("corpusSize") == 0, F.coalesce("__size", F.lit(0))).otherwise(F.col("corpusSize"))
    known = (F.col("corpusSize") != 0) | F.col("__corpus").isNotNull()
    return rows.select(*[size.alias(c) if c == "corpusSize" else F.col(c) for c in log.columns], F.coalesce("lang", F.lit("")).alias("lang"), known.alias("known"))


def prepared(log: DataFrame, corpora: DataFrame, correction: float = 1.0) -> DataFrame:
    """The log with repaired sizes, corrected times of synthetic rows, cql, and ok: false for rows that are rejected."""
    rows = repair_size(log, corpora)
    rows = rows.withColumn("ok", F.col("known") & (F.col("timeProc") > 0)).drop("known")
    time = F.when(F.col("isSynthetic"), F.col("timeProc") * correction).otherwise(F.col("timeProc"))
    return rows.withColumn("timeProc", time).withColumn("cql", strip_prefix("query"))


def valid_rows(log: DataFrame, corpora: DataFrame, correction: float = 1.0) -> DataFrame:
    return prepared(log, corpora, correction).where("ok").drop("ok")


def counters(log: DataFrame, corpora: DataFrame) -> DataFrame:
    """num_processed and num_failed. A row whose query can't be parsed counts as processed."""
    rows = prepared(log, corpora)
    return rows.agg(F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("num_processed"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("num_failed"))


def remove_zero(log: DataFrame) -> DataFrame:
    return log.where("timeProc > 0")


def zero_by_corpus(log: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """Rows without a time by corpus, most first; only of installed corpora, if any are given."""
    counts = log.where("timeProc <= 0").groupBy("corpus").count()
    if installed is not None and not installed.isEmpty():
        counts = counts.join(installed, "corpus", "left_semi")
    return counts.orderBy(F.desc("count"), "corpus")


def missing(log: DataFrame, allowed: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """Rows without a time or a corpus size, the first of each key, with uniq_key."""
    rows = log.where("timeProc = 0 OR corpusSize = 0")
    if allowed:
        rows = rows.where(F.col("corpus").isin(*allowed))
    keyed = rows.withColumn("uniq_key", log_key("corpusSize", "subcorpusSize", "query"))
    firsts = keyed.groupBy("uniq_key").agg(F.min_by(F.struct(*[c for c in keyed.columns if c != "uniq_key"]), order).alias("r"))
    return firsts.select("r.*", "uniq_key")


def batch(rows: DataFrame, offset: int = 0, size: int = 0) -> DataFrame:
    """A batch of rows in the order of their keys; all from offset on with size 0."""
    ordered = rows.orderBy("uniq_key").offset(offset)
    return ordered.limit(size) if size else ordered


def measure(rows: DataFrame, corpora: DataFrame, client: Callable[[str, str], float]) -> DataFrame:
    """Times of the rows that lack one, by asking the server: client(corpus, cql) returns seconds or raises. Rows with a time, without a known size or with an error are left out; the others are marked as synthetic."""
    ready = repair_size(rows, corpora).where("known AND timeProc <= 0").drop("known", "lang").withColumn("cql", strip_prefix("query"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            times = []
            for corpus, cql in zip(pdf["corpus"], pdf["cql"], strict=True):
                try:
                    times.append(float(client(corpus, cql)))
                except Exception:  # the server's answer is an error: the row stays unmeasured
                    times.append(None)
            pdf = pdf.assign(timeProc=times, isSynthetic=True)
            yield pdf[pdf["timeProc"].notna()]

    return ready.mapInPandas(run, ready.schema).drop("cql")


def http_client(base: str, timeout: float = 600.0) -> Callable[[str, str], float]:
    """Asks GET <base>/concordance/<corpus>?q=<cql> and returns the seconds it took; other answers than 200, and none within timeout seconds, are errors."""

    def ask(corpus: str, cql: str) -> float:
        import time
        from urllib.parse import quote, urlencode
        from urllib.request import urlopen

        began = time.monotonic()
        with urlopen(f"{base.rstrip('/')}/concordance/{quote(corpus)}?{urlencode({'q': cql})}", timeout=timeout) as answer:
            answer.read()
            if answer.status != 200:
                raise RuntimeError(f"answer {answer.status}")
        return time.monotonic() - began

    return ask


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
