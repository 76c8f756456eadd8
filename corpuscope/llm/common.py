"""What the operators share: the folder for intermediate tables, and reading inputs."""

from __future__ import annotations

import gc
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources.scratch import shared_dir

#: Words in all contracts: what stands between spaces and the characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Tables written by materialize and not dropped yet.
tables: list[str] = []


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        tables.remove(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask Spark's context cleaner to delete shuffle files that no live DataFrame needs any more."""
    for _ in range(2):  # what the first round drops can have held more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Rows and bytes of an Arrow batch, at most (but one row may be longer).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a batch of long texts fits a Python worker; keeps lower bounds set by the user."""
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for key, most in BATCH.items():
        now = re.match(r"(-?[0-9]+)([bkmg]?)", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) * unit[now[2]] <= most:
            spark.conf.set(key, most)


def new_name(df: DataFrame, base: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{base}{i or ''}" for i in range(len(taken) + 1)) if n not in taken)


def place_of(*key: F.Column | str) -> F.Column:
    """Where the hash of a key stands in 2**62 steps: rows below a share of these steps are a sample."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 62))


def share_of(n: int, most: int, least: int | None = None) -> int:
    """The steps below which about most of n rows stand. least: where the first row stands, which always belongs to the sample; so it isn't empty, however large n, and whichever rows are copies of each other."""
    return min(1 << 62, max(1, (most << 62) // max(n, 1), -1 if least is None else least + 1))


def picked(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """A sample of about most of the rows, by the hash of their key; at least those of one key, if there are rows."""
    n, least = rows.agg(F.count("*"), F.min(place_of(*key))).first()
    return rows.where(place_of(*key) < share_of(n, most, least)) if n > most else rows


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex_of(parts) -> F.Column:
    return F.sha2(F.array_join(parts, ","), 256)
