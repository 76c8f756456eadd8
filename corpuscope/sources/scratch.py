"""Tables written on the way, in the folder that driver and executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpuscope-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or, where it is unset and all run on this machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or _own_dir()


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
