"""Tumbling windows from the 2026 epoch over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timex


def epoch_window(ts: Column, seconds: int) -> Column:
    """Spark's event-time window, shifted so that windows start at 2026-01-01 rather than at 1970."""
    shift = timex.EPOCH_DAY * 86400 % seconds
    return F.window(ts, f"{seconds} seconds", startTime=f"{shift} seconds")


def tumbling(stream: DataFrame, ts: str, seconds: int, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates of a batch or stream by epoch window and keys; rows later than the watermark are left out of a stream."""
    out = stream.withWatermark(ts, late).groupBy(epoch_window(F.col(ts), seconds).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def bookend_stream(times: DataFrame, snapshots: DataFrame, coverage: timex.Coverage, profile: str = "linear") -> DataFrame:
    """Fields at streamed simulation times (t_ns) against a static snapshot table: a stream-static join, no state."""
    from ..operators.blend import bookend

    return bookend(snapshots, times, coverage, profile)
