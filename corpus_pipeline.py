"""A corpus pipeline: from documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import common, decontaminate, langid, mixing, neardup, registry, tokens
from corpuscope.llm.common import materialize, new_path, read

#: Below this score a document's language counts as undetermined.
MIN_SCORE = 0.2


#: Tables that the stage before has written on its way.
_on_the_way: list[str] = []


def _stage(f):
    """When a stage begins, the one before has been written as a whole, so the tables on its way can go."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_tables(spark, [p for p in _on_the_way if p in common.tables])
        common.release(spark)
        before = set(common.tables)
        out = f(spark, docs, sf_dir)
        _on_the_way[:] = [p for p in common.tables if p not in before]
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.drop_undetermined(docs, model, MIN_SCORE)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_rows(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what reading them gives for each document."""
    out = new_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, out, registry.tokenizer_path(), end_id=2, vocab=49_408)
    return tokens.scan_tokens(spark, out)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_output", token_output)]

#: Trained models, sampling by hashes and a tokenizer have no equivalent in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
