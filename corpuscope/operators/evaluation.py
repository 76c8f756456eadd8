"""Measures of predictions. One scoring pass serves all thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sweep(steps: int = 50) -> list[float]:
    out, t = [], 0.5
    for _ in range(steps):  # repeated addition, as thresholds must equal those of a loop
        out.append(t)
        t += 0.01
    return out


THRESHOLDS = _sweep()
NAN = float("nan")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def measures(hits: Column, retrieved: Column, relevant: Column) -> list[Column]:
    """precision, recall (NaN without any row to divide by) and f_beta (0 where it has no value)."""
    p, r = _ratio(hits, retrieved), _ratio(hits, relevant)
    some = ~F.isnan(p) & ~F.isnan(r) & (p + r > 0)
    f = F.when(some, 2 * p * r / F.when(some, p + r).otherwise(1.0)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f.alias("f_beta")]


def precision_recall(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = rows.agg(n(truth & predicted).alias("hits"), n(predicted).alias("retrieved"), n(truth).alias("relevant"))
    return sums.select("hits", "retrieved", "relevant", *measures(F.col("hits"), F.col("retrieved"), F.col("relevant")))


def threshold_sweep(rows: DataFrame, score: str, truth: Column, thresholds: list[float] = THRESHOLDS, inclusive: bool = False) -> DataFrame:
    """Measures for each threshold. Rows are counted by the number of thresholds they pass; sums over these counts do the rest, so that no row is repeated for each threshold.

    The score is bound once, outside the loop over thresholds: inside, Spark puts the expression behind the column, such as a whole model, in its place and works it out for each threshold.
    """
    cuts = F.array(*map(F.lit, thresholds))
    passed = F.transform(F.array(score), lambda s: F.size(F.filter(cuts, lambda t: (s >= t) if inclusive else (s > t))))[0]
    counts = rows.select(truth.cast("long").alias("t"), passed.alias("passed")).groupBy("passed").agg(F.sum("t").alias("hits"), F.count("*").alias("n"))
    table = rows.sparkSession.createDataFrame(list(enumerate(thresholds, 1)), "place int, threshold double")
    joined = table.join(counts)  # both have as many rows as thresholds, about
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    at = F.col("passed") >= F.col("place")
    sums = joined.groupBy("threshold").agg(n(F.when(at, F.col("hits"))).alias("hits"), n(F.when(at, F.col("n"))).alias("retrieved"), n(F.col("hits")).alias("relevant"))
    return sums.select("threshold", "hits", "retrieved", "relevant", *measures(F.col("hits"), F.col("retrieved"), F.col("relevant")))


def misclassified(rows: DataFrame, key: str, score: str, time: str, midpoint: float, slow_time: float, thresholds: list[float] = THRESHOLDS, keep: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Errors over a sweep, by key: mean score, repeats, the lowest threshold, and type FN, FP, "" or * for several.

    An error is judged by the model's own comparison and the midpoint; its type by the score reaching the
    threshold and the time reaching slow_time.
    """
    wrong = F.filter(F.array(*map(F.lit, thresholds)), lambda t: ((F.col(score) >= t) if inclusive else (F.col(score) > t)) != (F.col(time) >= midpoint))
    each = rows.select("*", F.explode(wrong).alias("threshold"))
    slow = F.col(time) >= slow_time
    kind = F.when(slow & (F.col(score) < F.col("threshold")), "FN").when(~slow & (F.col(score) >= F.col("threshold")), "FP").otherwise("")
    typed = each.withColumn("type", kind)
    extra = [F.min_by(c, "threshold").alias(c) for c in keep or [] if c != key]
    kinds = F.count_distinct("type")
    out = typed.groupBy(key).agg(F.avg(score).alias("ml_output"), F.count("*").alias("num_repeat"), F.min("threshold").alias("threshold"), F.when(kinds > 1, "*").otherwise(F.min("type")).alias("type"), *extra)
    return out.withColumn("error_size", F.abs(F.col("ml_output") - F.col("threshold")))


def report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("num_repeat"), F.desc("error_size"))


def classification_report(rows: DataFrame, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """precision, recall, f_beta and support for each class that occurs as label or prediction."""
    pairs = rows.groupBy(F.col(label).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).count()
    both = pairs.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("class"), "t", "p", "count")
    n = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    at, to = F.col("t") == F.col("class"), F.col("p") == F.col("class")
    sums = both.groupBy("class").agg(n(at & to).alias("hits"), n(to).alias("retrieved"), n(at).alias("relevant"))
    return sums.select("class", *measures(F.col("hits"), F.col("retrieved"), F.col("relevant")), F.col("relevant").alias("support"))
