"""From feature rows to a trained model and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.models import Model
from corpuscope.operators import dataset, evaluation
from corpuscope.sources.scratch import written


@dataclass
class Result:
    model: Model
    sweep: DataFrame | None
    misclassified: DataFrame | None
    midpoint: float


def _ranked(rows: DataFrame, tie: str):
    ranked = dataset.sorted_by_time(rows, tie=tie)
    found = dataset.knee(ranked).first()
    if found is None:
        raise ValueError("there are no rows to learn from")
    return ranked, found


@dataclass
class Prepared:
    """Rows with ranks, and the balanced rows around their knee, written once: learners pass over them many times."""

    ranked: DataFrame
    balanced: DataFrame
    threshold: float


def prepare(rows: DataFrame, tie: str = "uniq_key", seed: int = 0) -> Prepared:
    """What any number of models can be trained on."""
    ranked, knee = _ranked(rows, tie)
    balanced = dataset.labelled(dataset.balanced_sample(ranked, knee["idx"], knee["n"], seed), knee["threshold"])
    return Prepared(ranked, written(balanced, "balanced"), knee["threshold"])


def train(rows: DataFrame | Prepared, model: Model, tie: str = "uniq_key", path: str | None = None, seed: int = 0) -> Result:
    """Balances the rows around their knee, unless they are prepared, trains, saves, and reports on all rows. A model that only infers is saved and not reported on."""
    held = rows if isinstance(rows, Prepared) else prepare(rows, tie, seed)
    model.fit(held.balanced)
    model.slow_time = held.threshold
    if path:
        model.save(path)
    if model.inference_only:
        return Result(model, None, None, held.threshold)
    return report(held.ranked, model, held.threshold, tie)


def evaluate(rows: DataFrame, model: Model, tie: str = "uniq_key") -> Result:
    ranked, knee = _ranked(rows, tie)
    return report(ranked, model, knee["threshold"], tie)


def report(rows: DataFrame, model: Model, midpoint: float, key: str) -> Result:
    """Sweep and errors from one scoring pass."""
    scored = model.votes(rows).withColumn("slow_vote", F.col("votes")[1]).drop("votes")
    inclusive = model.kind == "nn"
    sweep = evaluation.threshold_sweep(scored, "slow_vote", F.col("procTime") >= midpoint, inclusive=inclusive)
    wrong = evaluation.misclassified(scored, key, "slow_vote", "procTime", midpoint, model.slow_time, keep=["q", "corpusSize", "procTime"], inclusive=inclusive)
    return Result(model, sweep, evaluation.report_order(wrong), midpoint)
