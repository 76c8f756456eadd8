"""Answers to queries by an ensemble: the same transformation for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.columns import feature_vector, log_scaled, simple_query
from corpuscope.models import Model
from corpuscope.operators import voting
from corpuscope.plans.featurize import parsed

DEFAULT_SIZE = 1_000_000_000


def resolve(requests: DataFrame, corpora: DataFrame) -> DataFrame:
    """requests (q, corpus, corpusSize, lang; null or empty where not given) with size, language, altCorpus, and status with error: 404 for an unknown corpus, 400 for a known one with a size of one's own."""
    catalog = corpora.select(F.col("corpus").alias("__corpus"), F.col("size").alias("__size"), F.col("lang").alias("__lang"), F.col("altCorpus").alias("__alt"))
    given = F.coalesce("corpus", F.lit("")) != ""
    own_size = F.coalesce("corpusSize", F.lit(0)) > 0
    joined = requests.join(catalog, F.col("corpus") == F.col("__corpus"), "left")
    status = F.when(given & F.col("__corpus").isNull(), 404).when(given & own_size, 400).otherwise(200)
    error = F.when(status == 404, "corpus not found").when(status == 400, "a size can't be given for a known corpus")
    size = F.when(given, F.col("__size")).when(own_size, F.col("corpusSize")).otherwise(F.lit(DEFAULT_SIZE))
    lang = F.when(given, F.col("__lang")).otherwise(F.coalesce("lang", F.lit("")))
    kept = [c for c in requests.columns if c not in ("corpusSize", "lang")]
    return joined.select(*kept, size.alias("size"), lang.alias("lang"), F.coalesce("__alt", F.lit("")).alias("altCorpus"), status.alias("status"), error.alias("error"))


def evaluate_queries(requests: DataFrame, models: list[tuple[str, Model]], corpora: DataFrame) -> DataFrame:
    """requests with status, error, votes, isSlowQuery and altCorpus. A query that can't be parsed has status 500."""
    rows = resolve(requests, corpora)
    rows = parsed(rows.withColumn("__text", F.coalesce("q", F.lit(""))), "__text", "lang").drop("__text")
    failed = (F.col("status") == 200) & F.col("__p.error").isNotNull()
    rows = rows.withColumn("error", F.when(failed, F.col("__p.error")).otherwise(F.col("error"))).withColumn("status", F.when(failed, 500).otherwise(F.col("status")))
    names = ("positions", "numGlobConditions", "containsMeet", "containsUnion", "containsWithin", "adhocSubcorpus", "containsContaining", "alignedPart")
    held = rows.withColumns({n: F.col(f"__p.{n}") for n in names} | {"corpusSize": log_scaled("size"), "namedSubcorpusSize": F.lit(0.0)})
    vector = feature_vector()
    held = held.withColumn("features", F.when(F.col("status") == 200, vector).otherwise(F.array_repeat(F.lit(0.0), 50))).drop("__p", *names, "corpusSize", "namedSubcorpusSize")
    answers = []
    for i, (name, model) in enumerate(models):
        held = model.score(held).withColumnsRenamed({"votes": f"__v{i}", "predicted_class": f"__c{i}"})
        answers.append(voting.vote(name, F.col(f"__v{i}"), F.col(f"__c{i}")))
    empty = F.array().cast("array<struct<name:string,votes:array<double>,result:int>>")
    votes = F.when(F.col("status") == 200, F.array(*answers) if answers else empty).otherwise(empty)
    held = held.withColumn("votes", votes)
    slow = F.when(F.col("status") == 200, voting.is_slow(F.col("votes")))
    return held.withColumn("isSlowQuery", slow).drop("features", *[f"__{k}{i}" for i in range(len(models)) for k in "vc"])


def evaluate_simple(requests: DataFrame, models: list[tuple[str, Model]], corpora: DataFrame, strict: bool = True) -> DataFrame:
    """Answers to plain values (attributes, value, corpus, corpusSize, lang): the query that simple_query builds of each, evaluated. strict: as the first implementation builds it, which no grammar accepts, so all answers are errors."""
    return evaluate_queries(requests.withColumn("q", simple_query("attributes", F.col("value"), strict)), models, corpora)


def response(answers: DataFrame) -> DataFrame:
    """The answers as JSON."""
    return answers.withColumn("response", F.when(F.col("status") == 200, F.to_json(F.struct("isSlowQuery", "votes", "altCorpus"))).otherwise(F.to_json(F.struct("error"))))


def vote_reports(answers: DataFrame, time=None) -> DataFrame:
    """A row of monitoring for each answer, errors too."""
    v = F.col("votes")
    error = (F.col("status") != 200).cast("int")
    return answers.select(
        (F.current_timestamp() if time is None else time).alias("time"), voting.votes_for(v).alias("votes_for"), voting.votes_against(v).alias("votes_against"), voting.certainty(v).alias("avg_certainty"), F.coalesce("corpus", F.lit("")).alias("corpus"), error.alias("num_errors")
    )
