"""Nanosecond time arithmetic in three calendars, as Column expressions.

Times are BIGINT nanoseconds since 2026-01-01T00:00 in the calendar at hand;
durations are BIGINT nanoseconds.  Date-times are structs
(year, month, day, hour, minute, second, nanosecond).  All arithmetic stays in
BIGINT: a double loses bits beyond 2**53 and Spark's TIMESTAMP has
microseconds only.  Overflow raises under ANSI mode, Spark's default.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
DAY = NS["d"]
EPOCH_YEAR = 2026
#: Days from 1970-01-01 to 2026-01-01 (Gregorian).
EPOCH_DAY = 20454
CALENDARS = ("gregorian", "noleap", "cal360")
DATE_TIME = T.StructType([T.StructField(n, T.IntegerType()) for n in ("year", "month", "day", "hour", "minute", "second", "nanosecond")])
_CUM = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long") if isinstance(x, int) else F.col(x)


def div(a, b) -> Column:
    """Truncating integer division; division by zero raises."""
    return F.call_function("div", _c(a), _c(b))


def floor_div(a, b) -> Column:
    """Floor division for positive ``b``."""
    a, b = _c(a), _c(b)
    return div(a - F.pmod(a, b), b)


def duration(n, unit: str) -> Column:
    return _c(n).cast("long") * F.lit(NS[unit]).cast("long")


# ------------------------------------------------------------ calendars


def is_leap(year) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(year, month, calendar: str = "gregorian") -> Column:
    y, m = _c(year), _c(month)
    if calendar == "cal360":
        return F.lit(30)
    fixed = F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31)
    return fixed.otherwise(F.when(is_leap(y), 29).otherwise(28) if calendar == "gregorian" else 28)


def days_in_year(year, calendar: str = "gregorian") -> Column:
    if calendar == "cal360":
        return F.lit(360)
    return F.when(is_leap(year), 366).otherwise(365) if calendar == "gregorian" else F.lit(365)


def day_number(year, month, day, calendar: str = "gregorian") -> Column:
    """Days since 2026-01-01 of a date that is valid in the calendar."""
    y, m, d = (_c(x).cast("long") for x in (year, month, day))
    if calendar == "cal360":
        return (y - EPOCH_YEAR) * 360 + (m - 1) * 30 + d - 1
    if calendar == "noleap":
        return (y - EPOCH_YEAR) * 365 + F.element_at(F.array(*map(F.lit, _CUM)), m.cast("int")) + d - 1
    # Years run from March so that the leap day is the last: 153 days in five months.
    y = y - F.when(m <= 2, 1).otherwise(0)
    m = F.pmod(m + 9, F.lit(12))
    return y * 365 + floor_div(y, 4) - floor_div(y, 100) + floor_div(y, 400) + div(m * 153 + 2, 5) + d - 1 - (719468 + EPOCH_DAY)


def valid(dt: Column, calendar: str = "gregorian") -> Column:
    """Whether all fields of the struct are in range in the calendar."""
    f = dt.getField
    ok = f("month").between(1, 12) & f("hour").between(0, 23) & f("minute").between(0, 59) & f("second").between(0, 59) & f("nanosecond").between(0, 999_999_999)
    return ok & (f("day") >= 1) & (f("day") <= days_in_month(f("year"), f("month"), calendar))


def to_ns(dt: Column, calendar: str = "gregorian") -> Column:
    """Time point of a date-time struct; a date that the calendar lacks raises."""
    f = dt.getField
    days = day_number(f("year"), f("month"), f("day"), calendar)
    secs = (f("hour").cast("long") * 60 + f("minute")) * 60 + f("second")
    t = days * DAY + secs * NS["s"] + f("nanosecond")
    return F.when(valid(dt, calendar), t).otherwise(F.raise_error(F.concat(F.lit(f"no such date in {calendar}: "), F.to_json(dt))))


def from_ns(t, calendar: str = "gregorian") -> Column:
    t = _c(t)
    day, rest = floor_div(t, DAY), F.pmod(t, F.lit(DAY))
    if calendar == "cal360":
        y, doy = floor_div(day, 360) + EPOCH_YEAR, F.pmod(day, F.lit(360))
        m, d = div(doy, 30) + 1, doy % 30 + 1
    elif calendar == "noleap":
        y, doy = floor_div(day, 365) + EPOCH_YEAR, F.pmod(day, F.lit(365))
        m = sum((F.when(doy >= c, 1).otherwise(0) for c in _CUM[1:]), F.lit(1))
        d = doy - F.element_at(F.array(*map(F.lit, _CUM)), m) + 1
    else:
        date = F.date_add(F.lit("2026-01-01").cast("date"), day.cast("int"))
        y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    sec = div(rest, NS["s"])
    parts = {"year": y, "month": m, "day": d, "hour": div(sec, 3600), "minute": div(sec, 60) % 60, "second": sec % 60, "nanosecond": rest % NS["s"]}
    return F.struct(*[v.cast("int").alias(k) for k, v in parts.items()])


def add_months(t, months, calendar: str = "gregorian") -> Column:
    """Adds calendar months; the day is clamped to the month's end, the time of day stays."""
    t, n = _c(t), _c(months).cast("long")
    if calendar == "cal360":
        return t + n * (30 * DAY)
    dt = from_ns(t, calendar)
    at = dt.getField("year").cast("long") * 12 + dt.getField("month") - 1 + n
    y, m = floor_div(at, 12), F.pmod(at, F.lit(12)) + 1
    d = F.least(dt.getField("day"), days_in_month(y, m, calendar))
    return day_number(y, m, d, calendar) * DAY + F.pmod(t, F.lit(DAY))


def add_years(t, years, calendar: str = "gregorian") -> Column:
    return add_months(t, _c(years).cast("long") * 12, calendar)


def day_of_week(t) -> Column:
    """ISO: Monday 1 to Sunday 7.  2026-01-01 was a Thursday."""
    return (F.pmod(floor_div(t, DAY) + 3, F.lit(7)) + 1).cast("int")


def day_of_year(t, calendar: str = "gregorian") -> Column:
    y = from_ns(t, calendar).getField("year")
    return (floor_div(t, DAY) - day_number(y, F.lit(1), F.lit(1), calendar) + 1).cast("int")


# ------------------------------------------------------------ ISO 8601

_ISO = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})$"


def parse_iso(text: Column) -> Column:
    """Struct of exactly YYYY-MM-DDThh:mm:ss, null for anything else; month lengths are not checked here."""
    part = [F.regexp_extract(text, _ISO, i + 1) for i in range(6)]
    num = [F.when(p != "", p).cast("int") for p in part]
    ok = text.rlike(_ISO) & num[1].between(1, 12) & num[2].between(1, 31) & num[3].between(0, 23) & num[4].between(0, 59) & num[5].between(0, 59)
    return F.when(ok, F.struct(*[n.alias(f.name) for n, f in zip([*num, F.lit(0)], DATE_TIME.fields, strict=True)]))


def format_iso(dt: Column) -> Column:
    """YYYY-MM-DDThh:mm:ss; nanoseconds are dropped."""
    return F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", *[dt.getField(f.name) for f in DATE_TIME.fields[:6]])


# ------------------------------------------------------------ alarms and windows


def interval_alarm_rings(t, ref, interval) -> Column:
    t, ref = _c(t), _c(ref)
    return (t >= ref) & ((t - ref) % _c(interval) == 0)


def interval_alarm_next(t, ref, interval) -> Column:
    """The first ring strictly after ``t``; the reference time itself if that lies ahead."""
    t, ref, iv = _c(t), _c(ref), _c(interval)
    return F.when(t < ref, ref).otherwise(ref + (div(t - ref, iv) + 1) * iv)


def absolute_alarm_rings(t, at) -> Column:
    return _c(t) == _c(at)


def absolute_alarm_expired(t, at) -> Column:
    return _c(t) > _c(at)


def phase_aligned(t, base, interval) -> Column:
    return interval_alarm_rings(t, base, interval)


def window_contains(t, start, end) -> Column:
    return (_c(t) >= _c(start)) & (_c(t) < _c(end))


def on_boundary(t, interval) -> Column:
    return _c(t) % _c(interval) == 0


def compute_window(t, interval) -> Column:
    """The tumbling window [start, end) from the epoch that holds ``t``; floors for negative times."""
    t, iv = _c(t), _c(interval)
    start = t - F.pmod(t, iv)
    return F.struct(start.alias("start"), (start + iv).alias("end"))


def heartbeat(intervals: list[int]) -> int:
    """Greatest common divisor of the intervals; empty or non-positive intervals raise."""
    if not intervals or min(intervals) <= 0:
        raise ValueError("intervals must be positive")
    return math.gcd(*intervals)


def sync_period(intervals: list[int]) -> int:
    """Least common multiple; beyond 64 bits it raises."""
    heartbeat(intervals)
    n = math.lcm(*intervals)
    if n >= 1 << 63:
        raise OverflowError("sync period exceeds 64 bits")
    return n


def gcd_lcm(df: DataFrame, column: str) -> DataFrame:
    """(gcd_value, lcm_value) of a column of positive integers.

    Only distinct values reach the driver, and of those at most those that
    change the gcd or lcm: each partition folds its own first.
    """

    def fold(batches):
        import pandas as pd

        g, m = 0, 1
        for b in batches:
            for x in b[column].unique():
                g, m = math.gcd(g, int(x)), math.lcm(m, int(x))
        yield pd.DataFrame({"g": [str(g)], "m": [str(m)]})

    rows = df.select(F.col(column).cast("long").alias(column)).distinct().mapInPandas(fold, "g string, m string").collect()
    g = functools.reduce(math.gcd, (int(r["g"]) for r in rows), 0)
    return df.sparkSession.createDataFrame([(g, sync_period([int(r["m"]) for r in rows]))], "gcd_value long, lcm_value long")


# ------------------------------------------------------------ time aliasing


@dataclass(frozen=True)
class Coverage:
    """The span [start, end) that a dataset covers, in windows of ``interval`` ns, and what happens outside it.

    policy: clamp_to_edge, cycle_last_year, pure_climatology or leap_hold.
    """

    start: int
    end: int
    interval: int
    policy: str = "clamp_to_edge"
    climatology_year: int = EPOCH_YEAR
    sim_calendar: str = "gregorian"
    data_calendar: str = "gregorian"

    def __post_init__(self) -> None:
        if self.interval <= 0 or self.start >= self.end or (self.end - self.start) % self.interval:
            raise ValueError("the interval must divide a non-empty coverage")
        if self.policy not in ("clamp_to_edge", "cycle_last_year", "pure_climatology", "leap_hold"):
            raise ValueError(f"unknown policy {self.policy}")


def _window(start: Column, interval: int, alpha: Column) -> Column:
    return F.struct(start.alias("start"), (start + interval).alias("end"), alpha.cast("double").alias("alpha"))


def alpha(t, start, end) -> Column:
    """(t - start) / (end - start) as a double; outside the window it raises."""
    t, a, b = _c(t), _c(start), _c(end)
    return F.when((t >= a) & (t < b), (t - a).cast("double") / (b - a).cast("double")).otherwise(F.raise_error(F.lit("time outside the window")))


def _enclosing(t: Column, cov: Coverage) -> Column:
    """Window of the coverage grid around ``t``; null where none holds it (a cycled time in a partial year)."""
    start = F.lit(cov.start) + div(t - cov.start, cov.interval) * cov.interval
    inside = (t >= cov.start) & (t < cov.end)
    return F.when(inside, _window(start, cov.interval, (t - start).cast("double") / float(cov.interval)))


def _in_year(t: Column, year: Column, calendar: str) -> Column:
    """``t`` moved to another year; 29 February becomes the 28th where the year has none."""
    dt = from_ns(t, calendar)
    d = F.least(dt.getField("day"), days_in_month(year, dt.getField("month"), calendar))
    return day_number(year, dt.getField("month"), d, calendar) * DAY + F.pmod(t, F.lit(DAY))


def resolve(t, cov: Coverage) -> Column:
    """The window (start, end, alpha) of the coverage that stands for simulation time ``t``."""
    t = _c(t).cast("long")
    cal = cov.data_calendar
    first, last = F.lit(cov.start).cast("long"), F.lit(cov.end - cov.interval).cast("long")
    clamped = F.when(t >= cov.end, _window(last, cov.interval, F.lit(0.0))).when(t < cov.start, _window(first, cov.interval, F.lit(0.0)))
    if cov.policy == "clamp_to_edge":
        return F.when(clamped.isNull(), _enclosing(t, cov)).otherwise(clamped)
    if cov.policy == "cycle_last_year":
        late, early = from_ns(F.lit(cov.end - 1), cal).getField("year"), from_ns(F.lit(cov.start), cal).getField("year")
        moved = F.when(t >= cov.end, _in_year(t, late, cal)).when(t < cov.start, _in_year(t, early, cal)).otherwise(t)
        return _enclosing(moved, cov)
    if cov.policy == "pure_climatology":
        year = F.lit(cov.climatology_year)
        moved = _in_year(t, year, cal)
        stop = day_number(year + 1, F.lit(1), F.lit(1), cal) * DAY
        w = _enclosing(moved, cov)
        return F.when(w.getField("end") > stop, F.struct(w.getField("start").alias("start"), stop.alias("end"), ((moved - w.getField("start")).cast("double") / (stop - w.getField("start")).cast("double")).alias("alpha"))).otherwise(w)
    if cov.sim_calendar == "gregorian" and cov.data_calendar == "noleap":
        dt = from_ns(t, "gregorian")
        held = F.struct(
            day_number(dt.getField("year"), F.lit(2), F.lit(28), "noleap") * DAY,
            day_number(dt.getField("year"), F.lit(3), F.lit(1), "noleap") * DAY,
        )
        leap_day = (dt.getField("month") == 2) & (dt.getField("day") == 29)
        hold = F.struct(held.getField("col1").alias("start"), held.getField("col2").alias("end"), F.lit(0.0).alias("alpha"))
        return F.when(leap_day, hold).when(clamped.isNotNull(), clamped).otherwise(_enclosing(t, cov))
    return F.when(clamped.isNull(), _enclosing(t, cov)).otherwise(clamped)


def register_sql(spark) -> None:
    """Session functions for SQL text, as plain expressions (no Python runs in tasks)."""
    spark.sql("create or replace temporary function ts_window_start(t bigint, iv bigint) returns bigint return t - pmod(t, iv)")
    spark.sql("create or replace temporary function ts_alarm_rings(t bigint, ref bigint, iv bigint) returns boolean return t >= ref and (t - ref) % iv = 0")
    spark.sql("create or replace temporary function ts_alarm_next(t bigint, ref bigint, iv bigint) returns bigint return case when t < ref then ref else ref + ((t - ref) div iv + 1) * iv end")
    spark.sql(f"create or replace temporary function ts_days(d date) returns bigint return unix_date(d) - {EPOCH_DAY}")
