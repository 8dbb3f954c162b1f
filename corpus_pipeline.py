"""Corpus preparation, stage by stage: toxicity, near-duplicates, benchmark leaks, mixing, token shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import common, decontaminate, mixing, simhash, tokens, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_shards", tokens.stage),
]

#: The learned and hashed stages have no SQL form; tests/llm holds them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each result is written and read again before the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
