"""Log records: severity filter, consolidation across ranks, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def level(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def severity_filter(logs: DataFrame, threshold: str) -> DataFrame:
    """Records at the threshold or above; FATAL always passes."""
    return logs.where((level(F.col("severity")) >= SEVERITIES.index(threshold)) | (F.col("severity") == "FATAL"))


def consolidate(logs: DataFrame) -> DataFrame:
    """(severity, message, ranks, n_ranks): one row a distinct message, its ranks as maximal runs '0-3,7'.

    Ranks are distinct first; runs come from rank minus its row number, so a
    message that every rank logs costs one row a rank, not one a record.
    """
    one = logs.select("severity", "message", "rank").distinct()
    w = Window.partitionBy("severity", "message").orderBy("rank")
    runs = one.withColumn("g", F.col("rank") - F.row_number().over(w)).groupBy("severity", "message", "g").agg(F.min("rank").alias("a"), F.max("rank").alias("b"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda r: F.when(r.a == r.b, r.a.cast("string")).otherwise(F.concat_ws("-", r.a, r.b)))
    return runs.groupBy("severity", "message").agg(F.array_join(text, ",").alias("ranks"), F.sum(F.col("b") - F.col("a") + 1).alias("n_ranks"))


def format_record(rank: Column, severity: Column, message: Column) -> Column:
    return F.format_string("[RANK:%04d] [%s] %s", rank, severity, message)


def format_trace(frames: list[str], limit: int = 256) -> str:
    """Numbered stack frames, 256 at most."""
    return "\n".join(f"#{i} {f}" for i, f in enumerate(frames[:limit]))
