"""Classifiers of slow queries behind one interface: score(rows with features) adds votes and predicted_class."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import dataset


class Model(ABC):
    kind = ""
    inference_only = False

    def __init__(self, threshold: float = 0.5):
        self.threshold, self.fitted, self.slow_time = threshold, None, 0.0

    def info(self) -> str:
        return f"{self.kind}, threshold {self.threshold:.2f}"

    @abstractmethod
    def fit(self, rows: DataFrame) -> Model:
        """Learns from features and label."""

    def votes(self, rows: DataFrame) -> DataFrame:
        """rows with votes for fast and slow."""
        held = rows.withColumn("__x", array_to_vector("features"))
        out = self.fitted.setFeaturesCol("__x").transform(held)
        drop = [c for c in ("__x", "rawPrediction", "probability", "prediction") if c not in rows.columns]
        return out.withColumn("votes", vector_to_array("probability")).drop(*drop)

    def score(self, rows: DataFrame) -> DataFrame:
        return self.votes(rows).withColumn("predicted_class", (F.col("votes")[1] > self.threshold).cast("int"))

    def save(self, path: str) -> None:
        """Settings, and beside them the fitted model; models that don't learn have settings only."""
        if self.fitted is not None:
            self.fitted.write().overwrite().save(f"{path}/model")
        session = SparkSession.getActiveSession()
        session.createDataFrame([(json.dumps({"kind": self.kind, "threshold": self.threshold, "slow_time": self.slow_time} | self.more()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    def more(self) -> dict:
        return {}


class Forest(Model):
    kind = "rf"

    def __init__(self, threshold: float = 0.5, trees: int = 100, depth: int = 12, seed: int = 0):
        super().__init__(threshold)
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, rows):
        held = rows.withColumn("__x", array_to_vector("features"))
        self.fitted = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(held)
        return self


class Network(Model):
    """50 inputs, hidden layers of 50 and 15, two outputs. MLlib's layers are sigmoid with a softmax output."""

    kind = "nn"

    def __init__(self, threshold: float = 0.5, epochs: int = 800, copies: int = 4, seed: int = 0):
        super().__init__(threshold)
        self.epochs, self.copies, self.seed, self.ranges = epochs, copies, seed, []

    def fit(self, rows):
        self.ranges = dataset.ranges_list(dataset.feature_ranges(rows))
        held = dataset.normalised(dataset.replicated(rows, self.copies), self.ranges)
        train, _ = dataset.split(held, 0.5, self.seed)
        train = train.withColumn("__x", array_to_vector("features"))
        self.fitted = MultilayerPerceptronClassifier(featuresCol="__x", labelCol="label", layers=[50, 50, 15, 2], maxIter=self.epochs, blockSize=50, seed=self.seed).fit(train)
        return self

    def votes(self, rows):
        raw = rows.withColumn("__raw", F.col("features"))
        return super().votes(dataset.normalised(raw, self.ranges)).withColumn("features", F.col("__raw")).drop("__raw")

    def score(self, rows):
        return self.votes(rows).withColumn("predicted_class", (F.col("votes")[1] >= self.threshold).cast("int"))

    def more(self):
        return {"ranges": self.ranges}


class Boosted(Model):
    kind = "xg"

    def __init__(self, threshold: float = 0.5, rounds: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 0):
        super().__init__(threshold)
        self.rounds, self.depth, self.rate, self.seed = rounds, depth, rate, seed

    def fit(self, rows):
        weight = dataset.class_weights(rows).first()["scale_pos_weight"] or 1.0
        held = rows.withColumn("__w", F.when(F.col("label") == 1, weight).otherwise(1.0)).withColumn("__check", F.rand(self.seed) < 0.2).withColumn("__x", array_to_vector("features"))
        self.fitted = GBTClassifier(featuresCol="__x", labelCol="label", weightCol="__w", validationIndicatorCol="__check", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=self.seed).fit(held)
        return self


class AlwaysSlow(Model):
    kind = "ym"

    def fit(self, rows):
        return self

    def score(self, rows):
        return rows.withColumn("votes", F.array(F.lit(0.0), F.lit(1.0))).withColumn("predicted_class", F.lit(1))

    votes = score


class Nothing(Model):
    """For featurizing alone: votes are empty."""

    kind = "zero"
    inference_only = True

    def fit(self, rows):
        return self

    def score(self, rows):
        return rows.withColumn("votes", F.array().cast("array<double>")).withColumn("predicted_class", F.lit(0))


class LinearScore(Model):
    """A fixed linear model of cost as a vote: the logistic function of the cost. It isn't saved as a model; its coefficients have a file of their own."""

    kind = "linear"

    def __init__(self, params: list[float], threshold: float = 0.5):
        super().__init__(threshold)
        self.params = params

    def fit(self, rows):
        return self

    def votes(self, rows):
        total = F.aggregate(F.zip_with("features", F.array(*map(F.lit, self.params)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        slow = 1 / (1 + F.exp(-total))
        return rows.withColumn("votes", F.array(1 - slow, slow))


KINDS = {m.kind: m for m in (Forest, Network, Boosted, AlwaysSlow, Nothing)}
TRAINABLE = ("rf", "nn", "xg")
_FITTED = {"rf": RandomForestClassificationModel, "nn": MultilayerPerceptronClassificationModel, "xg": GBTClassificationModel}


def create(kind: str, threshold: float = 0.5, **how) -> Model:
    if kind not in KINDS:
        raise ValueError(f"there is no model kind {kind!r}; there are {', '.join(KINDS)}")
    return KINDS[kind](threshold, **how)


def load(spark: SparkSession, path: str, threshold: float | None = None) -> Model:
    held = json.loads(spark.read.text(f"{path}/settings").first()[0])
    model = create(held["kind"], held["threshold"] if threshold is None else threshold)
    model.slow_time = held["slow_time"]
    if "ranges" in held:
        model.ranges = [tuple(r) for r in held["ranges"]]
    if held["kind"] in _FITTED:
        model.fitted = _FITTED[held["kind"]].load(f"{path}/model")
    return model


def load_ensemble(spark: SparkSession, members: list[dict]) -> list[tuple[str, Model]]:
    """The enabled members of an ensemble's settings (modelPath, modelType, voteThreshold, disabled), each with the settings' threshold; constant models need no path. A path of another type than the settings say is an error."""
    out = []
    for m in members:
        if m.get("disabled"):
            continue
        kind, path, threshold = m.get("modelType"), m.get("modelPath"), float(m.get("voteThreshold") or 0.0)
        model = load(spark, path, threshold) if path else create(kind, threshold)
        if not path and kind in _FITTED:
            raise ValueError(f"a model of kind {kind!r} needs a modelPath")
        if kind and model.kind != kind:
            raise ValueError(f"{path} holds a model of kind {model.kind!r}, not {kind!r}")
        out.append((path or kind, model))
    return out


def pr_auc(scored: DataFrame) -> float:
    rows = scored.select(F.col("votes")[1].alias("rawPrediction"), F.col("label").cast("double").alias("label"))
    return BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(rows)


def importances(model: Model, k: int = 10) -> list[tuple[str, float]]:
    from corpuscope.functions.columns import PARAM_NAMES

    held = zip(PARAM_NAMES, model.fitted.featureImportances.toArray().tolist(), strict=True)
    return sorted(held, key=lambda x: -x[1])[:k]
