import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.functions import timex
from fieldspark.operators import blend


def values(spark, expr, **lits):
    df = spark.range(1)
    for k, v in lits.items():
        df = df.withColumn(k, F.lit(v).cast("long"))
    return df.select(expr.alias("x")).first()["x"]


def test_civil_days(spark):
    days = spark.range(-100_000, 100_000, 997).select((F.col("id") * timex.DAY).alias("t"))
    out = days.select("t", timex.from_ns("t").alias("d"))
    back = out.select("t", timex.to_ns(F.col("d")).alias("b"), "d").collect()
    for r in back:
        assert r["t"] == r["b"]
        want = dt.date(2026, 1, 1) + dt.timedelta(days=r["t"] // timex.DAY)
        assert (r["d"]["year"], r["d"]["month"], r["d"]["day"]) == (want.year, want.month, want.day)


@pytest.mark.parametrize("calendar", timex.CALENDARS)
def test_round_trip(spark, calendar):
    t = spark.range(2000).select(((F.col("id") - 1000) * 86_399_123_456_789).alias("t"))
    assert t.where(timex.to_ns(timex.from_ns("t", calendar), calendar) != F.col("t")).count() == 0


def test_invalid_dates_raise(spark):
    bad = F.struct(F.lit(2026).alias("year"), F.lit(2).alias("month"), F.lit(29).alias("day"), *[F.lit(0).alias(k) for k in ("hour", "minute", "second", "nanosecond")])
    with pytest.raises(Exception, match="no such date"):
        values(spark, timex.to_ns(bad))
    assert values(spark, timex.to_ns(bad, "cal360")) == (30 + 28) * timex.DAY


def test_add_months_clamps(spark):
    jan31 = 30 * timex.DAY
    assert values(spark, timex.add_months("t", 1), t=jan31) == 58 * timex.DAY
    assert values(spark, timex.add_months("t", 1, "noleap"), t=jan31) == 58 * timex.DAY
    assert values(spark, timex.add_months("t", 1, "cal360"), t=jan31) == 60 * timex.DAY


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        values(spark, F.col("t") + F.lit(1).cast("long"), t=(1 << 63) - 1)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.integers(-(10**17), 10**17), iv=st.integers(1, 10**14))
def test_window_holds_time(spark, t, iv):
    w = values(spark, timex.compute_window("t", iv), t=t)
    assert w["start"] <= t < w["end"] and w["start"] % iv == 0


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.integers(-(10**15), 10**15), ref=st.integers(-(10**15), 10**15), iv=st.integers(1, 10**12))
def test_next_ring(spark, t, ref, iv):
    n = values(spark, timex.interval_alarm_next("t", ref, iv), t=t)
    assert n > t and (n - ref) % iv == 0 and n >= ref and (n - iv <= t or n == ref)


def test_iso(spark):
    parse = lambda s: spark.range(1).select(timex.parse_iso(F.lit(s)).alias("x")).first()["x"]
    assert parse("2026-02-31T01:02:03")["day"] == 31
    assert parse("2026-13-01T00:00:00") is None
    assert parse("2026-01-01T00:00:00Z") is None


def test_sync():
    assert timex.heartbeat([6, 9]) == 3 and timex.sync_period([4, 6]) == 12
    for bad in ([], [0], [3, -1]):
        with pytest.raises(ValueError):
            timex.heartbeat(bad)
    with pytest.raises(OverflowError):
        timex.sync_period([(1 << 62) - 1, (1 << 62) - 3])


def cov(policy, **more):
    return timex.Coverage(0, 730 * timex.DAY, timex.DAY, policy, **more)


def test_alias_policies(spark):
    w = values(spark, timex.resolve("t", cov("clamp_to_edge")), t=800 * timex.DAY)
    assert (w["start"], w["alpha"]) == (729 * timex.DAY, 0.0)
    w = values(spark, timex.resolve("t", cov("clamp_to_edge")), t=-5)
    assert (w["start"], w["alpha"]) == (0, 0.0)
    w = values(spark, timex.resolve("t", cov("clamp_to_edge")), t=36 * 3600 * 10**9)
    assert (w["start"], w["alpha"]) == (timex.DAY, 0.5)
    # 2028-03-01 cycles to 2027-03-01.
    w = values(spark, timex.resolve("t", cov("cycle_last_year")), t=(730 + 60) * timex.DAY)
    assert w["start"] == (365 + 59) * timex.DAY
    w = values(spark, timex.resolve("t", cov("pure_climatology", climatology_year=2026)), t=(365 + 10) * timex.DAY)
    assert w["start"] == 10 * timex.DAY
    # 2028-02-29 in Gregorian time holds the 28th of the data calendar.
    w = values(spark, timex.resolve("t", cov("leap_hold", data_calendar="noleap")), t=(730 + 59) * timex.DAY)
    assert (w["end"] - w["start"], w["alpha"]) == (timex.DAY, 0.0)
    with pytest.raises(ValueError):
        timex.Coverage(0, 10, 3)


def test_blends(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 3.0, 0.25), (1.0, 3.0, 0.5), (1.0, 3.0, nan)], "l double, r double, a double")
    rows = df.select(blend.linear_blend(F.col("l"), F.col("r"), F.col("a")).alias("x"), blend.step_blend(F.col("l"), F.col("r"), F.col("a")).alias("y")).collect()
    assert [r["y"] for r in rows] == [1.0, 3.0, 1.0]
    assert rows[0]["x"] == 1.5 and math.isnan(rows[2]["x"])
    with pytest.raises(ValueError):
        blend.blend("cubic", F.lit(1), F.lit(1), F.lit(0))
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "cell_id long, value double")
    with pytest.raises(Exception, match="extents differ"):
        blend.blend_fields(a, a.where("cell_id = 0"), 0.5).collect()
