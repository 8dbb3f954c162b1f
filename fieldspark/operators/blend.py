"""Blends of two snapshots and time bookends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timex


def linear_blend(left: Column, right: Column, alpha: Column) -> Column:
    """left * (1 - alpha) + right * alpha; alpha is not range-checked and NaN spreads."""
    return left * (F.lit(1.0) - alpha) + right * alpha


def step_blend(left: Column, right: Column, alpha: Column) -> Column:
    """right from alpha 0.5 on, else left; a NaN alpha gives left (Spark orders NaN above all numbers)."""
    return F.when(~F.isnan(alpha) & (alpha >= 0.5), right).otherwise(left)


PROFILES = {"linear": linear_blend, "step": step_blend}


def blend(profile: str, left: Column, right: Column, alpha: Column) -> Column:
    if profile not in PROFILES:
        raise ValueError(f"unknown temporal profile {profile!r}")
    return PROFILES[profile](left, right, alpha)


def blend_fields(left: DataFrame, right: DataFrame, alpha: float, profile: str = "linear") -> DataFrame:
    """(cell_id, value) of two fields over the same cells; differing extents raise."""
    j = left.select("cell_id", F.col("value").alias("l"), F.lit(1).alias("a")).join(right.select("cell_id", F.col("value").alias("r"), F.lit(1).alias("b")), "cell_id", "full")
    same = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("extents differ")).cast("double"))
    return j.select("cell_id", F.coalesce(same, blend(profile, F.col("l"), F.col("r"), F.lit(float(alpha)))).alias("value"))


def bookend(snapshots: DataFrame, times: DataFrame, coverage: timex.Coverage, profile: str = "linear") -> DataFrame:
    """Fields at simulation times from equally spaced snapshots.

    snapshots (t_ns, cell_id, value), times (t_ns).  A time resolves by
    arithmetic to its window's two snapshot times, so an equi-join on those
    replaces an as-of join; the value at a missing right snapshot (the end of
    the coverage) is the left one.
    """
    w = timex.resolve(F.col("sim_ns"), coverage)
    at = times.select(F.col("t_ns").alias("sim_ns")).withColumn("w", w).where("w is not null").select("sim_ns", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), F.col("w.alpha").alias("alpha"))
    lo = snapshots.select(F.col("t_ns").alias("lo"), "cell_id", F.col("value").alias("l"))
    hi = snapshots.select(F.col("t_ns").alias("hi"), "cell_id", F.col("value").alias("r"))
    j = at.join(lo, "lo").join(hi, ["hi", "cell_id"], "left")
    return j.select("sim_ns", "cell_id", blend(profile, F.col("l"), F.coalesce("r", "l"), F.col("alpha")).alias("value"))
