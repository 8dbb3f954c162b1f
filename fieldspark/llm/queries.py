"""The subpackage's queries and their oracle SQL, by the names the driver uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, mixing, quality, simhash, suffixes, tokens, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_toxicity": toxicity.query,
        "op3_vectors": vectors.query,
        "op4_tokens": tokens.query,
        "op5_licenses": licenses.query,
        "op6_quality": quality.query,
        "op7_chat": chat.query,
        "op8_mixing": mixing.query,
        "op9_decontaminate": decontaminate.query,
        "op10_suffixes": suffixes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {}
