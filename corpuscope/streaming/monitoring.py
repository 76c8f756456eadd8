"""Streams: query logs as they grow, answers to streamed requests, and reports of votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.plans.serving import evaluate_queries, vote_reports
from corpuscope.sources.logs import log_rows, zeros

REQUESTS = "q string, corpus string, corpusSize long, lang string"


def stream_query_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSONL files as they arrive in a folder, as log rows, by the rules of a log that is read whole."""
    return zeros(log_rows(spark.readStream.text(folder)))


def answer_stream(requests: DataFrame, models, corpora: DataFrame, reports_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Answers streamed requests and appends their reports, by date, to Parquet files. A batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        reports = vote_reports(evaluate_queries(batch, models, corpora)).withColumn("date", F.to_date("time"))
        reports.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(reports_path)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def discard(reports: DataFrame) -> None:
    """The sink for when nothing monitors."""
    reports.write.format("noop").mode("overwrite").save()


def roll_up(reports: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: reports by corpus and time window, for tables and streams."""
    held = reports.withWatermark("time", late) if reports.isStreaming else reports
    return held.groupBy(F.window("time", window), "corpus").agg(F.count("*").alias("n"), F.sum("num_errors").alias("num_errors"), F.sum((F.col("votes_for") > F.col("votes_against")).cast("long")).alias("n_slow"))
