"""Global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.sources.scratch import written

#: Bits of Spark's row ids below the number of the partition.
_WITHIN = 33
#: Rows of one task, on average, at most.
TASK_ROWS = 1 << 18


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the rows of df ask for, and at least the session's: so no task gets more rows as tables grow."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in the ascending order of the columns.

    Rows are dealt to ranges of the order, sorted there and written once; df is evaluated three times, to count rows, to
    sample the ranges and to deal. A rank is the place within the range plus the count of the ranges before, which are as many as
    tasks_for says. A good order has no ties; rows of a tie get any of their places, and one tie stays in one range.
    """
    ranged = df.repartitionByRange(tasks_for(df), *order).sortWithinPartitions(*order)
    held = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", _WITHIN).cast("int")
    counts = held.groupBy(part.alias("__part")).count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    bases = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.col("__id").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    joined = held.withColumn("__part", part).join(F.broadcast(bases), "__part")  # a row for each range
    return joined.select(*df.columns, (F.col("__base") + own).alias(name))
