"""How plans grow with their input."""

from pathlib import Path

import pytest

from pyspark.sql import functions as F

from corpuscope import models
from corpuscope.operators import dataset, ranking
from corpuscope.plans import learning, records

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ["generated_properties", "generated_queries", "generated_faults"])
def test_only_distinct_queries_are_parsed(spark, name):
    plan = records.Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and plan.rindex("ArrowEvalPython") < plan.index("HashAggregate")


def test_ranges_grow_with_rows(spark, monkeypatch):
    """No range holds more rows as tables grow."""
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    ranked = ranking.with_rank(spark.range(1200).select(F.pmod(F.col("id") * 7, F.lit(1200)).alias("id")), ["id"])
    assert ranked.where("id != rank").count() == 0
    sizes = [r["count"] for r in spark.read.parquet(*ranked.inputFiles()).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 300


def test_learners_pass_over_written_rows(spark):
    """Neither ranks nor the draw of the balanced rows are done again by a learner's passes, or for a further model."""
    seen = []

    class Held(models.Nothing):
        def fit(self, rows):
            seen.append((rows._jdf.queryExecution().executedPlan().toString(), sorted(rows.inputFiles())))
            return self

    rows = spark.range(40).select(F.col("id").cast("string").alias("uniq_key"), (F.col("id") * F.col("id")).cast("double").alias("procTime"), F.array(F.lit(1.0)).alias("features"))
    prepared = learning.prepare(rows.withColumn("id", F.col("uniq_key")))
    for _ in range(2):
        learning.train(prepared, Held())
    assert seen[0] == seen[1] and "Exchange" not in seen[0][0] and "Join" not in seen[0][0]


def test_sweep_asks_the_model_once_a_row(spark):
    """The model stands once in the sweep's plan, and not within the loop over thresholds."""
    rows = spark.range(40).select(F.col("id").cast("string").alias("uniq_key"), F.col("id").cast("string").alias("q"), F.lit(1.0).alias("corpusSize"), (F.col("id") * F.col("id")).cast("double").alias("procTime"), F.array(F.col("id").cast("double")).alias("features"))
    for model in (models.create("rf", trees=2, depth=2), models.create("xg", rounds=2, depth=2)):
        sweep = learning.train(rows, model).sweep
        plan = sweep._jdf.queryExecution().optimizedPlan().toString()
        loop = plan[plan.index("lambdafunction(") : plan.index("AS passed")]
        assert "UDF(" in plan and "UDF(" not in loop and sweep.count() == 50


def test_training_rows_are_dealt_to_tasks(spark, monkeypatch):
    """One file of events doesn't make one task of all feature rows."""
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    rows = records._training(spark, SF)
    n = rows.count()
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= n // 100 and max(sizes) <= 200


def test_features_are_scaled_without_a_lambda(spark):
    """Scaling is compiled, and rows of other lengths keep their nulls."""
    rows = spark.createDataFrame([(0, [3.0, 1.0, 7.0]), (1, None), (2, [5.0]), (3, [None, 2.0, 7.0, 9.0])], "id int, features array<double>")
    out = dataset.normalised(rows, [(1.0, 5.0), (0.0, 2.0), (7.0, 7.0)])
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["features"] for r in out.orderBy("id").collect()] == [[0.5, 0.5, 7.0], None, [1.0, None, None], [None, 1.0, 7.0, None]]
