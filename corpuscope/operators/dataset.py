"""From evaluated queries to training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.ranking import with_rank

#: Longer times count as this one.
CAP = 450.0


def deduplicate(rows: DataFrame, key: str, time: str = "procTime", tie: str = "id") -> DataFrame:
    """One row for each key: its fastest, with the time replaced by the group's median.

    The median of up to two is their mean, else the element at ceil(n / 2) from 0 in ascending order. Ranks
    over (key, time, tie) name the places of both rows, so no group is gathered anywhere, and one join fetches them.
    """
    ranked = with_rank(rows, [key, time, tie], "__rank")
    groups = ranked.groupBy(key).agg(F.min("__rank").alias("__first"), F.count("*").alias("__n"), F.avg(time).alias("__mean"))
    at = F.col("__first") + F.when(F.col("__n") > 2, F.ceil(F.col("__n") / 2)).otherwise(0)
    places = F.array(*[F.struct(F.lit(i).alias("role"), place.cast("long").alias("rank")) for i, place in enumerate((F.col("__first"), at))])
    wanted = groups.select("__first", "__n", "__mean", F.explode(places).alias("__p")).select("__first", "__n", "__mean", "__p.role", F.col("__p.rank").alias("__rank"))
    found = wanted.join(ranked, "__rank")
    row = F.struct(*[F.col(c) for c in rows.columns])
    picked = found.groupBy("__first").agg(F.max(F.when(F.col("role") == 1, F.col(time))).alias("__median"), F.first(F.when(F.col("role") == 0, row), ignorenulls=True).alias("__row"), F.first("__n").alias("__n"), F.first("__mean").alias("__mean"))
    median = F.when(F.col("__n") <= 2, F.col("__mean")).otherwise(F.col("__median"))
    return picked.select(*[median.alias(c) if c == time else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def capped(rows: DataFrame, time: str = "procTime", cap: float = CAP) -> DataFrame:
    return rows.withColumn(time, F.least(F.col(time), F.lit(cap)))


def sorted_by_time(rows: DataFrame, time: str = "procTime", tie: str = "id") -> DataFrame:
    """The rows with capped times and rank, their place from 0 by time before the cap."""
    return capped(with_rank(rows, [time, tie]), time)


def knee(ranked: DataFrame, time: str = "procTime") -> DataFrame:
    """threshold, idx, n, slow_percentile: the first point of the sorted times that is farthest from the line between the first and the last. Fewer than two rows have index 100."""
    ends = ranked.agg(F.count("*").alias("n"), F.min_by(time, "rank").cast("double").alias("y1"), F.max_by(time, "rank").cast("double").alias("y2"))
    a, b = F.col("y2") - F.col("y1"), -(F.col("n") - 1).cast("double")
    c = (F.col("n") - 1) * F.col("y1")
    distance = F.abs(a * F.col("rank") + b * F.col(time) + c) / F.sqrt(a * a + b * b)
    points = ranked.select("rank", time).join(ends)  # one row on the right
    points = points.withColumn("d", F.when(F.col("n") > 1, distance).otherwise(0.0))
    best = points.agg(F.max_by(F.struct("rank", time, "n"), F.struct("d", -F.col("rank"))).alias("p"))
    idx = F.when(F.col("p.n") < 2, F.lit(100)).otherwise(F.col("p.rank"))
    return best.where("p IS NOT NULL").select(F.col(f"p.{time}").alias("threshold"), idx.cast("long").alias("idx"), F.col("p.n").alias("n"), (F.col("p.rank") / F.col("p.n")).alias("slow_percentile"))


def balanced_sample(ranked: DataFrame, idx: int, n: int, seed: int = 0) -> DataFrame:
    """All rows from rank idx on, and twice as many of the others, drawn with replacement by seeded ranks. Nothing is drawn if idx is 0."""
    positive = ranked.where(F.col("rank") >= idx)
    if idx <= 0:
        return positive
    draws = ranked.sparkSession.range(2 * (n - idx)).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(idx)).alias("rank"))
    return ranked.where(F.col("rank") < idx).join(draws, "rank").select(*ranked.columns).unionByName(positive)


def labelled(rows: DataFrame, threshold: float, time: str = "procTime") -> DataFrame:
    return rows.withColumn("label", (F.col(time) >= threshold).cast("int"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Rows by label, and what a positive weighs against a negative."""
    positive, negative = F.sum(F.col("label")), F.sum(1 - F.col("label"))
    return rows.agg(positive.cast("long").alias("n_positive"), negative.cast("long").alias("n_negative"), F.try_divide(negative, positive).alias("scale_pos_weight"))


def class_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").count()


def feature_ranges(rows: DataFrame) -> DataFrame:
    """pos, low, high of each feature; both include 0."""
    return rows.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.least(F.min("v"), F.lit(0.0)).alias("low"), F.greatest(F.max("v"), F.lit(0.0)).alias("high"))


def normalised(rows: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Features scaled to their ranges; constant ones stay as they are. Missing places, and those without a range, are null.

    Each place has an expression of its own, which Spark compiles; a lambda over the places would be interpreted.
    """
    at = [F.get("features", F.lit(i)).cast("double") for i in range(len(ranges))]
    scaled = F.array(*[v if low == high else (v - F.lit(float(low))) / F.lit(float(high) - float(low)) for v, (low, high) in zip(at, ranges, strict=True)])
    further = F.array_repeat(F.lit(None).cast("double"), F.size("features") - len(ranges))
    return rows.withColumn("features", F.when(F.col("features").isNotNull(), F.concat(scaled, further)))


def ranges_list(ranges: DataFrame) -> list[tuple[float, float]]:
    """The ranges of a fixed number of features as a list."""
    return [(r["low"], r["high"]) for r in ranges.orderBy("pos").collect()]


def replicated(rows: DataFrame, times: int = 4) -> DataFrame:
    return rows.withColumn("__copy", F.explode(F.array(*map(F.lit, range(times))))).drop("__copy")


def split(rows: DataFrame, share: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    first, second = rows.randomSplit([share, 1 - share], seed)
    return first, second


def stratified_split(rows: DataFrame, key: list[str], share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the same share of each label, by the rank of the rows' hash within their label."""
    ranked = with_rank(rows.withColumn("__h", F.xxhash64(F.lit(seed), *key)), ["label", "__h", *key], "__rank")
    groups = ranked.groupBy(F.col("label").alias("__l")).agg(F.min("__rank").alias("__first"), F.count("*").alias("__n"))
    placed = ranked.join(F.broadcast(groups), F.col("label") == F.col("__l")).withColumn("__train", F.col("__rank") - F.col("__first") < F.floor(F.col("__n") * share))  # a row for each label on the right
    return placed.where("__train").select(*rows.columns), placed.where(~F.col("__train")).select(*rows.columns)


def sample_rows(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(k)


def large_corpora(corpora: DataFrame, least: int = 100_000_000) -> DataFrame:
    return corpora.where(F.col("size") > least).orderBy(F.desc("size"), "corpus")


def time_statistics(rows: DataFrame, time: str = "procTime") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def top_by(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= k).drop("__n")
