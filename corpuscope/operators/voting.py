"""Votes of an ensemble, and its reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vote(name: str, votes: Column, predicted_class: Column) -> Column:
    """One model's answer: its name, the votes for fast and slow, and the class."""
    return F.struct(F.lit(name).alias("name"), votes.alias("votes"), predicted_class.cast("int").alias("result"))


def is_slow(votes: Column) -> Column:
    """A strict majority: more models say slow than half of them, rounded down."""
    return F.aggregate(votes, F.lit(0), lambda a, v: a + v["result"]) > F.floor(F.size(votes) / 2)


def votes_for(votes: Column) -> Column:
    return F.size(F.filter(votes, lambda v: v["result"] > 0))


def votes_against(votes: Column) -> Column:
    return F.size(votes) - votes_for(votes)


def certainty(votes: Column) -> Column:
    """The mean vote for fast; NaN without models."""
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v["votes"][0])
    return F.when(F.size(votes) == 0, F.lit(float("nan"))).otherwise(F.try_divide(total, F.size(votes)))
