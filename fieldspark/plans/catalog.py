"""Registered queries over the test tables, with their oracle SQL.

Floats are rounded on both sides: sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timex
from ..operators import apply as ap
from ..operators import blend as bl
from ..operators import exchange, grids, logs, vertical, weights
from ..operators.grids import Regular

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


# ------------------------------------------------------------ sparse apply

_W = "w0 AS (SELECT l_partkey % 50 AS row, l_suppkey AS col, l_discount AS w FROM lineitem), dst AS (SELECT range AS row FROM range(60))"


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("row"), F.col("l_suppkey").alias("col"), F.col("l_discount").alias("w"))


def _rows(spark: SparkSession, n: int = 60) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row")


@query("spmv_apply", f"WITH {_W} SELECT d.row, round(coalesce(sum(w * s_acctbal), 0), 4) AS value FROM dst d LEFT JOIN (SELECT * FROM w0 JOIN supplier ON col = s_suppkey) x ON d.row = x.row GROUP BY d.row")
def spmv_apply(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))
    return ap.apply(_weights(spark, sf), src, _rows(spark)).select("row", r6("value", 4))


@query("spmv_batch", f"WITH {_W} SELECT d.row, round(coalesce(sum(w * s_acctbal), 0), 4) AS bal, round(coalesce(sum(w * s_nationkey), 0), 4) AS nat FROM dst d LEFT JOIN (SELECT * FROM w0 JOIN supplier ON col = s_suppkey) x ON d.row = x.row GROUP BY d.row")
def spmv_batch(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("double").alias("nat"))
    return ap.apply(_weights(spark, sf), src, _rows(spark)).select("row", r6("bal", 4), r6("nat", 4))


@query(
    "spmv_nan",
    f"WITH {_W}, s AS (SELECT row, sum(w) t, sum(w) FILTER (s_suppkey % 7 <> 0) v, sum(w * s_acctbal) FILTER (s_suppkey % 7 <> 0) x FROM w0 JOIN supplier ON col = s_suppkey GROUP BY row) SELECT d.row, CASE WHEN t <> 0 AND v <> 0 AND v / t >= 0.5 - 1e-6 THEN round(x / v, 6) ELSE 'NaN'::DOUBLE END AS value FROM dst d LEFT JOIN s ON d.row = s.row",
)
def spmv_nan(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("s_suppkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), v.alias("value"))
    return ap.nan_apply(_weights(spark, sf), src, _rows(spark), 0.5).select("row", r6("value"))


@query("spmv_masked", f"WITH {_W} SELECT d.row, round(CASE WHEN d.row % 3 = 0 THEN d.row::DOUBLE ELSE coalesce(sum(w * s_acctbal), 0) END, 4) AS value FROM dst d LEFT JOIN (SELECT * FROM w0 JOIN supplier ON col = s_suppkey) x ON d.row = x.row GROUP BY d.row")
def spmv_masked(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))
    dst = _rows(spark).select("row", (F.col("row") % 3).alias("mask"), F.col("row").cast("double").alias("old"))
    return ap.masked_apply(_weights(spark, sf), src, dst).select("row", r6("value", 4))


@query("spmv_halo", f"WITH {_W}, s AS (SELECT s_suppkey AS col, s_acctbal AS v FROM supplier WHERE s_suppkey < 6 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey >= 6) SELECT d.row, round(coalesce(sum(w * v), 0), 4) AS value FROM dst d LEFT JOIN (SELECT row, w, v FROM w0 JOIN s USING (col)) x ON d.row = x.row GROUP BY d.row")
def spmv_halo(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))
    far = s.where("col >= 6").withColumn("col", F.col("col") - 6)
    return ap.halo_apply(_weights(spark, sf), s.where("col < 6"), far, _rows(spark), 6).select("row", r6("value", 4))


@query("spmv_gathered", f"WITH {_W} SELECT d.row, round(coalesce(sum(w * s_acctbal), 0), 4) AS value FROM dst d LEFT JOIN (SELECT * FROM w0 JOIN supplier ON col = s_suppkey) x ON d.row = x.row GROUP BY d.row")
def spmv_gathered(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))
    return ap.gathered_apply(_weights(spark, sf), lambda cols: src.join(cols, "col", "left_semi"), _rows(spark)).select("row", r6("value", 4))


@query("coo_to_csr", f"WITH {_W}, n AS (SELECT d.row, count(x.row) AS n FROM dst d LEFT JOIN w0 x ON d.row = x.row GROUP BY d.row) SELECT row, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS \"start\", (sum(n) OVER (ORDER BY row))::BIGINT AS \"end\" FROM n")
def coo_to_csr(spark: SparkSession, sf: str) -> DataFrame:
    return ap.to_csr(_weights(spark, sf), 60)[0]


def _src_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    cell = s.select(F.col("s_suppkey").alias("col"), (F.col("s_nationkey") + 1).cast("double").alias("area_a"), (F.col("s_suppkey") % 5 / 4).alias("frac_a"))
    return cell, s.select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))


def _dst_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    cell = p.select(F.col("p_partkey").alias("row"), F.col("p_size").cast("double").alias("area_b"), (F.col("p_partkey") % 5 / 4).alias("frac_b"))
    return cell, p.select(F.col("p_partkey").alias("row"), F.col("p_retailprice").alias("value"))


_SI = "SELECT sum(s_acctbal * (s_nationkey + 1) * (s_suppkey % 5 / 4)) AS i FROM supplier"
_DI = "SELECT sum(CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * p_size ELSE 0 END) AS i FROM part"


@query("src_integral", f"SELECT round(i, 2) AS integral FROM ({_SI})")
def src_integral(spark: SparkSession, sf: str) -> DataFrame:
    return ap.source_integral(*_src_cells(spark, sf)).select(r6("integral", 2))


@query("dst_integral", f"SELECT round(i, 2) AS integral FROM ({_DI})")
def dst_integral(spark: SparkSession, sf: str) -> DataFrame:
    return ap.destination_integral(*_dst_cells(spark, sf)).select(r6("integral", 2))


@query("dst_integral_fracarea", "SELECT round(sum(p_retailprice * p_size * (p_partkey % 5 / 4)), 2) AS integral FROM part")
def dst_integral_fracarea(spark: SparkSession, sf: str) -> DataFrame:
    return ap.destination_integral(*_dst_cells(spark, sf), norm="fracarea").select(r6("integral", 2))


@query("conservation_report", f"SELECT round(a.i, 2) AS src_integral, round(b.i, 2) AS dst_integral, round(abs(b.i - a.i), 2) AS abs_error, round(abs(b.i - a.i) / greatest(abs(a.i), abs(b.i), 2.220446049250313e-16), 6) AS rel_error FROM ({_SI}) a, ({_DI}) b")
def conservation_report(spark: SparkSession, sf: str) -> DataFrame:
    r = ap.conservation_report(ap.source_integral(*_src_cells(spark, sf)), ap.destination_integral(*_dst_cells(spark, sf)))
    return r.select(r6("src_integral", 2), r6("dst_integral", 2), r6("abs_error", 2), r6("rel_error"))


@query("adjust_by_fraction", "SELECT p_partkey AS row, round(CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / (p_partkey % 5 / 4) ELSE p_retailprice END, 6) AS value FROM part")
def adjust_by_fraction(spark: SparkSession, sf: str) -> DataFrame:
    cell, field = _dst_cells(spark, sf)
    return ap.adjust_by_fraction(field, cell).select("row", r6("value"))


_PW = "pw AS (SELECT l_orderkey AS row, l_suppkey AS col, sum(l_discount) AS w FROM lineitem GROUP BY ALL)"


def _order_weights(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_discount").alias("w"))


@query("wet_renormalize", f"WITH {_PW}, wet AS (SELECT pw.* FROM pw JOIN supplier ON col = s_suppkey WHERE s_nationkey % 3 <> 0), t AS (SELECT row, sum(w) t FROM wet GROUP BY row) SELECT row, count(*) AS n, round(sum(CASE WHEN t > 1e-12 AND t < 1 - 1e-9 THEN w / t ELSE w END), 6) AS w FROM wet JOIN t USING (row) GROUP BY row")
def wet_renormalize(spark: SparkSession, sf: str) -> DataFrame:
    mask = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("col"), (F.col("s_nationkey") % 3).alias("mask"))
    out = ap.wet_renormalize(_order_weights(spark, sf), mask)
    return out.groupBy("row").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"))


@query("fracarea_normalize", f"WITH {_PW}, t AS (SELECT row, sum(w) t FROM pw GROUP BY row) SELECT row, col, round(CASE WHEN t > 0 THEN w / t ELSE w END, 6) AS w FROM pw JOIN t USING (row)")
def fracarea_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return ap.fracarea_normalize(_order_weights(spark, sf)).select("row", "col", r6("w"))


@query("frac_accumulate", "SELECT l_suppkey AS col, round(least(sum(l_discount / 100), 1.0), 6) AS frac_a FROM lineitem GROUP BY 1")
def frac_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_discount").alias("overlap"), F.lit(100.0).alias("area_a"), F.lit(10.0).alias("area_b"))
    return ap.fractions(o)[0].select("col", r6("frac_a"))


@query("total_weights", f"WITH {_W} SELECT row, round(sum(w), 4) AS total FROM w0 GROUP BY row")
def total_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ap.total_weights(_weights(spark, sf)).select("row", r6("total", 4))


_CATS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "categorical_fractions",
    f"WITH {_W}, s AS (SELECT s_suppkey AS col, r_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT row, w, c FROM w0 JOIN s USING (col)) SELECT d.row, "
    + ", ".join(f"round(coalesce(sum(w) FILTER (c = '{c}'), 0), 4) AS \"fraction_{c}\"" for c in _CATS)
    + " FROM dst d LEFT JOIN x ON d.row = x.row GROUP BY d.row",
)
def categorical_fractions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    src = s.select(F.col("s_suppkey").alias("col"), F.col("r_name").alias("category"))
    out = ap.categorical_fractions(_weights(spark, sf), src, _rows(spark), _CATS)
    return out.select("row", *[F.round(F.col(f"`fraction_{c}`"), 4).alias(f"fraction_{c}") for c in _CATS])


# ------------------------------------------------------------ blends and time

_H = "h AS (SELECT event_type AS k, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS h, avg(value) AS v FROM events GROUP BY ALL), j AS (SELECT a.k, a.h, a.v AS l, b.v AS r, (a.h % 10) / 10 AS alpha FROM h a JOIN h b ON a.k = b.k AND b.h = a.h + 1)"


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", "value", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("h"))
    h = e.groupBy(F.col("event_type").alias("k"), "h").agg(F.avg("value").alias("v"))
    b = h.select("k", (F.col("h") - 1).alias("h"), F.col("v").alias("r"))
    return h.join(b, ["k", "h"]).select("k", "h", F.col("v").alias("l"), "r", (F.col("h") % 10 / 10).alias("alpha"))


@query("linear_blend", f"WITH {_H} SELECT k, h, round(l * (1 - alpha) + r * alpha, 6) AS value FROM j")
def linear_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf).select("k", "h", F.round(bl.linear_blend(F.col("l"), F.col("r"), F.col("alpha")), 6).alias("value"))


@query("blend_dispatch", f"WITH {_H} SELECT k, h, round(l * (1 - alpha) + r * alpha, 6) AS linear, round(CASE WHEN alpha >= 0.5 THEN r ELSE l END, 6) AS step FROM j")
def blend_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.round(bl.blend(p, F.col("l"), F.col("r"), F.col("alpha")), 6).alias(p) for p in ("linear", "step")]
    return _hours(spark, sf).select("k", "h", *cols)


@query("step_blend", f"WITH {_H} SELECT k, h, round(CASE WHEN alpha >= 0.5 THEN r ELSE l END, 6) AS value FROM j")
def step_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf).select("k", "h", F.round(bl.step_blend(F.col("l"), F.col("r"), F.col("alpha")), 6).alias("value"))


_EPOCH_US = timex.EPOCH_DAY * 86400 * 10**6
_ENS = f"e AS (SELECT event_id, (epoch_us(ts) - {_EPOCH_US}) * 1000 AS t FROM events)"


def _events_ns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value", ((F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH_US) * 1000).alias("t"))


_IV = 6 * 3600 * 10**9


@query("compute_window", f"WITH {_ENS} SELECT event_id, t - ((t % {_IV} + {_IV}) % {_IV}) AS \"start\", t - ((t % {_IV} + {_IV}) % {_IV}) + {_IV} AS \"end\" FROM e")
def compute_window(spark: SparkSession, sf: str) -> DataFrame:
    return _events_ns(spark, sf).select("event_id", timex.compute_window("t", _IV).alias("w")).select("event_id", "w.start", "w.end")


@query("window_agg", f"WITH e AS (SELECT value, (epoch_us(ts) - {_EPOCH_US}) * 1000 AS t FROM events) SELECT t - ((t % {_IV} + {_IV}) % {_IV}) AS \"start\", count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1")
def window_agg(spark: SparkSession, sf: str) -> DataFrame:
    w = _events_ns(spark, sf).withColumn("w", timex.compute_window("t", _IV))
    return w.groupBy(F.col("w.start").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_REF = 10 * 86400 * 10**9
_SEC = f"(t - ((t % {timex.NS['s']} + {timex.NS['s']}) % {timex.NS['s']}))"


@query(
    "alarms",
    f"WITH e0 AS (SELECT event_id, (epoch_us(ts) - {_EPOCH_US}) * 1000 AS t FROM events), e AS (SELECT event_id, {_SEC} AS t FROM e0) SELECT event_id, t % {60 * 10**9} = 0 AS boundary, t >= -{_REF} AND (t + {_REF}) % {7 * 10**9} = 0 AS rings, CASE WHEN t < -{_REF} THEN -{_REF} ELSE -{_REF} + ((t + {_REF}) // {7 * 10**9} + 1) * {7 * 10**9} END AS next_ring, t = -{_REF} AS at_alarm, t > -{_REF} AS expired, t >= 0 AND t % {7 * 10**9} = 0 AS aligned, t >= -{_REF} AND t < 0 AS inside FROM e",
)
def alarms(spark: SparkSession, sf: str) -> DataFrame:
    e = _events_ns(spark, sf).withColumn("t", F.col("t") - F.pmod("t", F.lit(timex.NS["s"])))
    seven = 7 * 10**9
    return e.select(
        "event_id",
        timex.on_boundary("t", 60 * 10**9).alias("boundary"),
        timex.interval_alarm_rings("t", -_REF, seven).alias("rings"),
        timex.interval_alarm_next("t", -_REF, seven).alias("next_ring"),
        timex.absolute_alarm_rings("t", -_REF).alias("at_alarm"),
        timex.absolute_alarm_expired("t", -_REF).alias("expired"),
        timex.phase_aligned("t", 0, seven).alias("aligned"),
        timex.window_contains("t", -_REF, 0).alias("inside"),
    )


def _orders_ns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", ((F.unix_micros(F.col("o_orderdate").cast("timestamp")) - _EPOCH_US) * 1000).alias("t"))


@query(
    "greg_roundtrip",
    f"SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, hour(o_orderdate)::INT AS hour, isodow(o_orderdate)::INT AS dow, dayofyear(o_orderdate)::INT AS doy, day(last_day(o_orderdate::DATE))::INT AS dim, (epoch_us(o_orderdate) - {_EPOCH_US}) * 1000 AS t FROM orders",
)
def greg_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_ns(spark, sf).withColumn("d", timex.from_ns("t"))
    return o.select("o_orderkey", "d.year", "d.month", "d.day", "d.hour", timex.day_of_week("t").alias("dow"), timex.day_of_year("t").alias("doy"), timex.days_in_month("d.year", "d.month").alias("dim"), timex.to_ns(F.col("d")).alias("t"))


@query("add_months_greg", f"SELECT o_orderkey, (epoch_us(o_orderdate + INTERVAL 13 MONTH) - {_EPOCH_US}) * 1000 AS plus, (epoch_us(o_orderdate - INTERVAL 25 MONTH) - {_EPOCH_US}) * 1000 AS minus, (epoch_us(o_orderdate + INTERVAL 3 YEAR) - {_EPOCH_US}) * 1000 AS years FROM orders")
def add_months_greg(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_ns(spark, sf)
    return o.select("o_orderkey", timex.add_months("t", 13).alias("plus"), timex.add_months("t", -25).alias("minus"), timex.add_years("t", 3).alias("years"))


_NOFEB29 = "o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CASE WHEN month(o_orderdate) = 2 THEN least(day(o_orderdate), 28) ELSE least(day(o_orderdate), 30) END AS d FROM orders)"
_CUMSQL = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"


def _orders_date(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"))
    day = F.when(F.month("dt") == 2, F.least(F.dayofmonth("dt"), F.lit(28))).otherwise(F.least(F.dayofmonth("dt"), F.lit(30)))
    zero = {k: F.lit(0) for k in ("hour", "minute", "second", "nanosecond")}
    parts = {"year": F.year("dt"), "month": F.month("dt"), "day": day} | zero
    return o.select("o_orderkey", F.struct(*[v.alias(k) for k, v in parts.items()]).alias("d"))


@query("noleap_convert", f"WITH {_NOFEB29} SELECT o_orderkey, ((y - 2026) * 365 + {_CUMSQL}[m] + d - 1) * {timex.DAY} AS t, y::INT AS year, m::INT AS month, d::INT AS day, ({_CUMSQL}[m] + d)::INT AS doy FROM o")
def noleap_convert(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_date(spark, sf).withColumn("t", timex.to_ns(F.col("d"), "noleap")).withColumn("b", timex.from_ns("t", "noleap"))
    return o.select("o_orderkey", "t", "b.year", "b.month", "b.day", timex.day_of_year("t", "noleap").alias("doy"))


_NLADD = "(SELECT o_orderkey, d, ((y * 12 + m - 1 + {n}) // 12)::BIGINT AS y, ((y * 12 + m - 1 + {n}) % 12 + 1)::BIGINT AS m FROM o)"
_NLDAYS = f"((y - 2026) * 365 + {_CUMSQL}[m] + least(d, [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]) - 1) * {timex.DAY}"


@query("add_months_noleap", f"WITH {_NOFEB29}, a AS {_NLADD.format(n=13)}, b AS {_NLADD.format(n=-25)} SELECT o_orderkey, plus, minus FROM (SELECT o_orderkey, {_NLDAYS} AS plus FROM a) JOIN (SELECT o_orderkey, {_NLDAYS} AS minus FROM b) USING (o_orderkey)")
def add_months_noleap(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_date(spark, sf).withColumn("t", timex.to_ns(F.col("d"), "noleap"))
    return o.select("o_orderkey", timex.add_months("t", 13, "noleap").alias("plus"), timex.add_months("t", -25, "noleap").alias("minus"))


@query("cal360_convert", f"WITH {_NOFEB29} SELECT o_orderkey, ((y - 2026) * 360 + (m - 1) * 30 + d - 1) * {timex.DAY} AS t, y::INT AS year, m::INT AS month, d::INT AS day, ((y - 2026) * 360 + (m - 1) * 30 + d - 1 + 210) * {timex.DAY} AS plus7 FROM o")
def cal360_convert(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_date(spark, sf).withColumn("t", timex.to_ns(F.col("d"), "cal360")).withColumn("b", timex.from_ns("t", "cal360"))
    return o.select("o_orderkey", "t", "b.year", "b.month", "b.day", timex.add_months("t", 7, "cal360").alias("plus7"))


@query("iso_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, true AS same FROM orders")
def iso_format(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders_ns(spark, sf).withColumn("iso", timex.format_iso(timex.from_ns("t")))
    return o.select("o_orderkey", "iso", (timex.to_ns(timex.parse_iso(F.col("iso"))) == F.col("t") - F.pmod("t", F.lit(timex.NS["s"]))).alias("same"))


@query("gcd_lcm", "SELECT list_reduce(list(x), lambda a, b: gcd(a, b))::BIGINT AS gcd_value, list_reduce(list(x), lambda a, b: lcm(a, b))::BIGINT AS lcm_value FROM (SELECT DISTINCT (p_size % 10 + 1) * 6::BIGINT AS x FROM part)")
def gcd_lcm(spark: SparkSession, sf: str) -> DataFrame:
    return timex.gcd_lcm(table(spark, sf, "part").select(((F.col("p_size") % 10 + 1) * 6).alias("x")), "x")


_COV = timex.Coverage(-27 * 365 * timex.DAY, -25 * 365 * timex.DAY, 5 * timex.DAY)
_ORD = f"o AS (SELECT o_orderkey, (epoch_us(o_orderdate) - {_EPOCH_US}) * 1000 AS t FROM orders)"
_ENC = f"({_COV.start} + ((x - {_COV.start}) // {_COV.interval}) * {_COV.interval})"


def _alias(spark: SparkSession, sf: str, policy: str, **more) -> DataFrame:
    cov = timex.Coverage(_COV.start, _COV.end, _COV.interval, policy, **more)
    return _orders_ns(spark, sf).select("o_orderkey", timex.resolve("t", cov).alias("w")).select("o_orderkey", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.round("w.alpha", 6).alias("alpha"))


@query(
    "alias_clamp",
    f"WITH {_ORD}, c AS (SELECT o_orderkey, t, t AS x FROM o) SELECT o_orderkey, CASE WHEN t >= {_COV.end} THEN {_COV.end - _COV.interval} WHEN t < {_COV.start} THEN {_COV.start} ELSE {_ENC} END AS \"start\", CASE WHEN t >= {_COV.end} THEN {_COV.end} WHEN t < {_COV.start} THEN {_COV.start + _COV.interval} ELSE {_ENC} + {_COV.interval} END AS \"end\", round(CASE WHEN t >= {_COV.end} OR t < {_COV.start} THEN 0 ELSE (x - {_ENC}) / {_COV.interval} END, 6) AS alpha FROM c",
)
def alias_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _alias(spark, sf, "clamp_to_edge")


_MOVE = "epoch_us(make_timestamp(y2, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND NOT (y2 % 4 = 0 AND (y2 % 100 <> 0 OR y2 % 400 = 0)) THEN least(day(o_orderdate), 28) ELSE day(o_orderdate) END, hour(o_orderdate), minute(o_orderdate), second(o_orderdate)::DOUBLE))"


def _cycle_sql(year: str) -> str:
    return f"WITH o AS (SELECT o_orderkey, o_orderdate, (epoch_us(o_orderdate) - {_EPOCH_US}) * 1000 AS t FROM orders), y AS (SELECT *, {year} AS y2 FROM o), c AS (SELECT o_orderkey, ({_MOVE} - {_EPOCH_US}) * 1000 AS x FROM y) SELECT o_orderkey, CASE WHEN x >= {_COV.start} AND x < {_COV.end} THEN {_ENC} END AS \"start\", CASE WHEN x >= {_COV.start} AND x < {_COV.end} THEN {_ENC} + {_COV.interval} END AS \"end\", CASE WHEN x >= {_COV.start} AND x < {_COV.end} THEN round((x - {_ENC}) / {_COV.interval}, 6) END AS alpha FROM c"


# The coverage runs from 1999-01-08 to 2001-01-07.
@query("alias_cycle", _cycle_sql(f"CASE WHEN t >= {_COV.end} THEN 2001 WHEN t < {_COV.start} THEN 1999 ELSE year(o_orderdate) END"))
def alias_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return _alias(spark, sf, "cycle_last_year")


_STOP = (11323 - timex.EPOCH_DAY) * timex.DAY  # 2001-01-01


def _clim_sql() -> str:
    base = _cycle_sql("2000").split(" SELECT o_orderkey, CASE")[0]
    return f"{base}, w AS (SELECT o_orderkey, x, {_ENC} AS s FROM c) SELECT o_orderkey, s AS \"start\", least(s + {_COV.interval}, {_STOP}) AS \"end\", round((x - s) / (least(s + {_COV.interval}, {_STOP}) - s), 6) AS alpha FROM w"


@query("alias_clim", _clim_sql())
def alias_clim(spark: SparkSession, sf: str) -> DataFrame:
    return _alias(spark, sf, "pure_climatology", climatology_year=2000)


_LEAP = "month(o_orderdate) = 2 AND day(o_orderdate) = 29"
_FEB28 = f"((year(o_orderdate) - 2026) * 365 + 58) * {timex.DAY}"


@query(
    "alias_leap_hold",
    f"WITH c AS (SELECT o_orderkey, o_orderdate, (epoch_us(o_orderdate) - {_EPOCH_US}) * 1000 AS x FROM orders) SELECT o_orderkey, CASE WHEN {_LEAP} THEN {_FEB28} WHEN x >= {_COV.end} THEN {_COV.end - _COV.interval} WHEN x < {_COV.start} THEN {_COV.start} ELSE {_ENC} END AS \"start\", CASE WHEN {_LEAP} THEN {_FEB28} + {timex.DAY} WHEN x >= {_COV.end} THEN {_COV.end} WHEN x < {_COV.start} THEN {_COV.start + _COV.interval} ELSE {_ENC} + {_COV.interval} END AS \"end\", round(CASE WHEN {_LEAP} OR x >= {_COV.end} OR x < {_COV.start} THEN 0 ELSE (x - {_ENC}) / {_COV.interval} END, 6) AS alpha FROM c",
)
def alias_leap_hold(spark: SparkSession, sf: str) -> DataFrame:
    return _alias(spark, sf, "leap_hold", data_calendar="noleap")


_BK = f"e AS (SELECT KEYCOL AS k, value, (epoch_us(ts) - {_EPOCH_US}) * 1000 AS t FROM events), s AS (SELECT k, t - ((t % {timex.NS['h']} + {timex.NS['h']}) % {timex.NS['h']}) AS h, avg(value) AS v FROM e GROUP BY ALL), b AS (SELECT min(h) AS lo, max(h) AS hi FROM s), i AS (SELECT unnest(range(0, (hi - lo) // {600 * 10**9})) * {600 * 10**9} + lo AS n, lo FROM b), w AS (SELECT n, lo + ((n - lo) // {timex.NS['h']}) * {timex.NS['h']} AS h FROM i) SELECT n AS sim_ns, l.k AS KEYNAME, round(l.v * (1 - (n - w.h) / {timex.NS['h']}) + coalesce(r.v, l.v) * ((n - w.h) / {timex.NS['h']}), 6) AS value FROM w JOIN s l ON l.h = w.h LEFT JOIN s r ON r.h = w.h + {timex.NS['h']} AND r.k = l.k"


def _bookended(spark: SparkSession, sf: str, key: F.Column) -> DataFrame:
    """Hourly means by key as snapshots, blended at ten-minute simulation times."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH_US) * 1000
    e = table(spark, sf, "events").select(key.alias("cell_id"), "value", t.alias("t"))
    hour = timex.NS["h"]
    snap = e.groupBy(timex.compute_window("t", hour).getField("start").alias("t_ns"), "cell_id").agg(F.avg("value").alias("value"))
    lo, hi = snap.agg(F.min("t_ns"), F.max("t_ns")).first()
    times = spark.range(0, (hi - lo) // (600 * 10**9)).select((F.col("id") * (600 * 10**9) + lo).alias("t_ns"))
    return bl.bookend(snap, times, timex.Coverage(lo, hi + hour, hour)).select("sim_ns", "cell_id", r6("value"))


@query("bookend", f"WITH {_BK}".replace("KEYCOL", "user_id % 5").replace("KEYNAME", "cell_id"))
def bookend(spark: SparkSession, sf: str) -> DataFrame:
    return _bookended(spark, sf, F.col("user_id") % 5)


@query("bookend_types", f"WITH {_BK}".replace("KEYCOL", "event_type").replace("KEYNAME", "k"))
def bookend_types(spark: SparkSession, sf: str) -> DataFrame:
    return _bookended(spark, sf, F.col("event_type")).withColumnRenamed("cell_id", "k")


# ------------------------------------------------------------ grids and weights

_SRC, _DST = Regular.world(36, 18), Regular.world(18, 9)
_FINE = Regular.world(40, 25, 4.5)


def _cells_sql(g: Regular) -> str:
    return f"(SELECT range AS cell_id, range % {g.ni} AS i, range // {g.ni} AS j, {g.lon0} + (range % {g.ni}) * {g.dlon}::DOUBLE AS lon_lo, {g.lon0} + (range % {g.ni} + 1) * {g.dlon}::DOUBLE AS lon_hi, {g.lat0} + (range // {g.ni}) * {g.dlat}::DOUBLE AS lat_lo, {g.lat0} + (range // {g.ni} + 1) * {g.dlat}::DOUBLE AS lat_hi FROM range({g.ni * g.nj}))"


_AREA = "radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo)))"


def _overlap_sql(src: Regular, dst: Regular) -> str:
    """Overlaps by comparing all pairs of intervals, source longitudes repeated a turn either way."""
    return f"s AS (SELECT cell_id AS col, lon_lo + k * 360 AS slo, lon_hi + k * 360 AS shi, lat_lo AS tlo, lat_hi AS thi FROM {_cells_sql(src)}, (VALUES (-1), (0), (1)) v(k)), d AS (SELECT *, {_AREA} AS area FROM {_cells_sql(dst)}), o AS (SELECT d.cell_id AS row, col, sum(radians(least(lon_hi, shi) - greatest(lon_lo, slo)) * (sin(radians(least(lat_hi, thi))) - sin(radians(greatest(lat_lo, tlo))))) AS overlap, max(area) AS area FROM d, s WHERE slo < lon_hi - 1e-9 AND shi > lon_lo + 1e-9 AND tlo < lat_hi - 1e-9 AND thi > lat_lo + 1e-9 GROUP BY ALL)"


_FIELD_SQL = f"f AS (SELECT range AS col, coalesce(v, 0) AS v FROM range({_SRC.ni * _SRC.nj}) LEFT JOIN (SELECT l_partkey % {_SRC.ni * _SRC.nj} AS c, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON c = range)"


def _field(spark: SparkSession, sf: str) -> DataFrame:
    n = _SRC.ni * _SRC.nj
    v = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % n).alias("col")).agg(F.sum("l_extendedprice").alias("value"))
    return spark.range(n).withColumnRenamed("id", "col").join(v, "col", "left").select("col", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("grid_regular", f"SELECT cell_id, round(lon_lo, 6) AS lon_lo, round(lon_hi, 6) AS lon_hi, round(lat_lo, 6) AS lat_lo, round(lat_hi, 6) AS lat_hi, round({_AREA}, 9) AS area FROM {_cells_sql(_FINE)}")
def grid_regular(spark: SparkSession, sf: str) -> DataFrame:
    return grids.regular_cells(spark, _FINE).select("cell_id", r6("lon_lo"), r6("lon_hi"), r6("lat_lo"), r6("lat_hi"), r6("area", 9))


@query("cell_edges", "WITH c AS (SELECT range AS idx, range * range / 2 AS center FROM range(20)), w AS (SELECT *, lag(center) OVER (ORDER BY idx) AS b, lead(center) OVER (ORDER BY idx) AS a FROM c) SELECT idx, round(CASE WHEN b IS NULL THEN center - (a - center) / 2 ELSE (b + center) / 2 END, 6) AS lo, round(CASE WHEN a IS NULL THEN center + (center - b) / 2 ELSE (center + a) / 2 END, 6) AS hi FROM w")
def cell_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") / 2).alias("center"))
    return grids.cell_edges(c).select("idx", r6("lo"), r6("hi"))


@query("octahedral_counts", "SELECT j::INT AS j, (20 + 4 * least(j, 23 - j))::BIGINT AS n FROM (SELECT range AS j FROM range(24))")
def octahedral_counts(spark: SparkSession, sf: str) -> DataFrame:
    return grids.named_points(spark, "O12").groupBy("j").agg(F.count("*").alias("n"))


@query("nearest_rect", f"SELECT cell_id AS row, (least(greatest(round((lat_lo - {_SRC.lat0}) / {_SRC.dlat}), 0), {_SRC.nj - 1})::BIGINT * {_SRC.ni} + (round((lon_lo - {_SRC.lon0}) / {_SRC.dlon})::BIGINT % {_SRC.ni} + {_SRC.ni}) % {_SRC.ni}) AS col, 1.0::DOUBLE AS w FROM {_cells_sql(_FINE)}")
def nearest_rect(spark: SparkSession, sf: str) -> DataFrame:
    return weights.nearest_rect(spark, _SRC, _FINE)


_BIL = f"d0 AS (SELECT cell_id AS row, {_SRC.lon0} + ((lon_lo + lon_hi) / 2 - {_SRC.lon0} + 720) % 360 AS x, (lat_lo + lat_hi) / 2 AS y FROM {_cells_sql(_FINE)}), d1 AS (SELECT row, (x - {_SRC.lon0}) / {_SRC.dlon} - 0.5 AS fi, (y - {_SRC.lat0}) / {_SRC.dlat} - 0.5 AS fj FROM d0), d2 AS (SELECT row, floor(fi) AS i0, least(greatest(floor(fj), 0), {_SRC.nj - 2}) AS j0, fi, fj FROM d1), d3 AS (SELECT row, i0, j0, fi - i0 AS tx, least(greatest(fj - j0, 0), 1) AS ty FROM d2), wt AS (SELECT row, j0 + b AS j, i0 + a AS i, (CASE WHEN a = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN b = 1 THEN ty ELSE 1 - ty END) AS w FROM d3, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))"


# Divided by pi, since these weights are short fractions and put exact ties on a rounding edge.
@query("bilinear_rect", f"WITH {_BIL}, {_FIELD_SQL} SELECT row, round(sum(w * v) / pi(), 2) AS over_pi, round(sum(w), 6) AS total FROM wt JOIN f ON col = (j * {_SRC.ni} + (i + {_SRC.ni}) % {_SRC.ni}) GROUP BY row")
def bilinear_rect(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.bilinear_rect(spark, _SRC, _FINE)
    src = _field(spark, sf).withColumn("total", F.lit(1.0))
    return ap.apply(w, src, _rows(spark, _FINE.ni * _FINE.nj)).select("row", F.round(F.col("value") / F.pi(), 2).alias("over_pi"), r6("total"))


@query("bilinear_nonuniform", "WITH xs AS (SELECT range AS i, range * range * 2.0::DOUBLE AS x FROM range(12)), ys AS (SELECT range AS j, range * 10.0::DOUBLE - 40 AS y FROM range(9)), d AS (SELECT range AS row, (range * 37 % 260)::DOUBLE AS dx, (range * 17 % 90 - 45)::DOUBLE AS dy FROM range(500)), b AS (SELECT row, dx, dy, least(greatest((SELECT count(*) FROM xs WHERE x <= dx) - 1, 0), 10) AS i0, least(greatest((SELECT count(*) FROM ys WHERE y <= dy) - 1, 0), 7) AS j0 FROM d), t AS (SELECT row, i0, j0, least(greatest((dx - a.x) / (c.x - a.x), 0), 1) AS tx, least(greatest((dy - e.y) / (g.y - e.y), 0), 1) AS ty FROM b JOIN xs a ON a.i = i0 JOIN xs c ON c.i = i0 + 1 JOIN ys e ON e.j = j0 JOIN ys g ON g.j = j0 + 1) SELECT row, ((j0 + q) * 12 + i0 + p)::BIGINT AS col, round((CASE WHEN p = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN q = 1 THEN ty ELSE 1 - ty END), 9) AS w FROM t, (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q)")
def bilinear_nonuniform(spark: SparkSession, sf: str) -> DataFrame:
    xs = spark.range(12).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") * 2.0).alias("center"))
    ys = spark.range(9).select(F.col("id").alias("idx"), (F.col("id") * 10.0 - 40).alias("center"))
    d = spark.range(500).select(F.col("id").alias("cell_id"), (F.col("id") * 37 % 260).cast("double").alias("clon"), (F.col("id") * 17 % 90 - 45).cast("double").alias("clat"))
    return weights.bilinear_nonuniform(xs, ys, d, 12).select("row", "col", r6("w", 9))


def _regridded(src: Regular, dst: Regular, norm: str) -> str:
    w = "overlap / area" if norm == "dstarea" else "overlap / sum(overlap) OVER (PARTITION BY row)"
    return f"WITH {_overlap_sql(src, dst)}, {_FIELD_SQL}, w AS (SELECT row, col, {w} AS w FROM o) SELECT row, round(sum(w * v), 1) AS value FROM w JOIN f USING (col) GROUP BY row"


@query("conservative_rect", _regridded(_SRC, _DST, "dstarea"))
def conservative_rect(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.conservative_rect(spark, _SRC, _DST)
    return ap.apply(w.select("row", "col", "w"), _field(spark, sf), _rows(spark, _DST.ni * _DST.nj)).select("row", r6("value", 1))


@query("conservative_rect_fine", f"WITH {_overlap_sql(_SRC, _FINE)} SELECT row, col, round(overlap / area, 9) AS w FROM o")
def conservative_rect_fine(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.conservative_rect(spark, _SRC, _FINE)
    return w.groupBy("row", "col").agg(F.round(F.sum("w"), 9).alias("w"))


@query("conservative_fracarea", _regridded(_SRC, _DST, "fracarea"))
def conservative_fracarea(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.conservative_rect(spark, _SRC, _DST, "fracarea")
    return ap.apply(w.select("row", "col", "w"), _field(spark, sf), _rows(spark, _DST.ni * _DST.nj)).select("row", r6("value", 1))


@query("conservation_rect", f"WITH {_overlap_sql(_SRC, _DST)}, {_FIELD_SQL}, r AS (SELECT row, sum(overlap / area * v) AS v, max(area) AS area FROM o JOIN f USING (col) GROUP BY row), a AS (SELECT sum(v * {_AREA}) AS i FROM f JOIN {_cells_sql(_SRC)} ON col = cell_id) SELECT round(i, 1) AS src_integral, round(t, 1) AS dst_integral, round(abs(t - i) / greatest(abs(t), abs(i)), 6) AS rel_error FROM a, (SELECT sum(v * area) AS t FROM r)")
def conservation_rect(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.conservative_rect(spark, _SRC, _DST)
    out = ap.apply(w.select("row", "col", "w"), _field(spark, sf), _rows(spark, _DST.ni * _DST.nj))
    src = grids.regular_cells(spark, _SRC).select(F.col("cell_id").alias("col"), F.col("area").alias("area_a"), F.lit(1.0).alias("frac_a"))
    fb = ap.fractions(w)[1]
    dst = grids.regular_cells(spark, _DST).select(F.col("cell_id").alias("row"), F.col("area").alias("area_b")).join(fb, "row")
    r = ap.conservation_report(ap.source_integral(src, _field(spark, sf)), ap.destination_integral(dst, out))
    return r.select(r6("src_integral", 1), r6("dst_integral", 1), F.round("rel_error", 6).alias("rel_error"))


@query("conservative_nonuniform", "WITH sx AS (SELECT range AS si, range * range * 2.5::DOUBLE AS lo, (range + 1) * (range + 1) * 2.5::DOUBLE AS hi FROM range(12)), dx AS (SELECT range AS di, range * 36.0::DOUBLE AS lo, (range + 1) * 36.0::DOUBLE AS hi FROM range(10)), sy AS (SELECT range AS si, range * 20.0::DOUBLE - 90 AS lo, range * 20.0::DOUBLE - 70 AS hi FROM range(9)), dy AS (SELECT range AS di, range * 30.0::DOUBLE - 90 AS lo, range * 30.0::DOUBLE - 60 AS hi FROM range(6)), x AS (SELECT di, si, radians(least(d.hi, s.hi) - greatest(d.lo, s.lo)) AS p FROM dx d, sx s WHERE s.lo < d.hi AND s.hi > d.lo), y AS (SELECT di, si, sin(radians(least(d.hi, s.hi))) - sin(radians(greatest(d.lo, s.lo))) AS p FROM dy d, sy s WHERE s.lo < d.hi AND s.hi > d.lo) SELECT (y.di * 10 + x.di)::BIGINT AS row, (y.si * 12 + x.si)::BIGINT AS col, round(x.p * y.p / (radians(36) * (sin(radians(dy.hi)) - sin(radians(dy.lo)))), 9) AS w FROM x, y JOIN dy ON dy.di = y.di")
def conservative_nonuniform(spark: SparkSession, sf: str) -> DataFrame:
    ax = lambda n, lo, hi: spark.range(n).select(F.col("id").alias("idx"), lo(F.col("id")).alias("lo"), hi(F.col("id")).alias("hi"))
    sx, dx = ax(12, lambda k: k * k * 2.5, lambda k: (k + 1) * (k + 1) * 2.5), ax(10, lambda k: k * 36.0, lambda k: (k + 1) * 36.0)
    sy, dy = ax(9, lambda k: k * 20.0 - 90, lambda k: k * 20.0 - 70), ax(6, lambda k: k * 30.0 - 90, lambda k: k * 30.0 - 60)
    mid = lambda d: d.withColumn("center", (F.col("lo") + F.col("hi")) / 2)
    dst = grids.rectilinear_cells(mid(dx), mid(dy))
    lon, lat = weights.axis_overlaps(sx, dx, period=360.0), weights.axis_overlaps(sy, dy, spherical_lat=True)
    return weights.conservative_nonuniform(dst, lon, lat, 12).select("row", "col", r6("w", 9))


_PTS = "c AS (SELECT c_custkey AS row, (c_custkey * 137 % 3600) / 10 AS lon, (c_custkey * 61 % 1700) / 10 - 85 AS lat, c_custkey % 4 AS m FROM customer), s AS (SELECT s_suppkey AS col, (s_suppkey * 71 % 3600) / 10 AS lon, (s_suppkey * 29 % 1700) / 10 - 85 AS lat, s_suppkey % 3 AS mask FROM supplier), x AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM s), z AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM c)"


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    dst = table(spark, sf, "customer").select(c.alias("row"), (c * 137 % 3600 / 10).alias("lon"), (c * 61 % 1700 / 10 - 85).alias("lat"), (c % 4).alias("m"))
    src = table(spark, sf, "supplier").select(s.alias("col"), (s * 71 % 3600 / 10).alias("lon"), (s * 29 % 1700 / 10 - 85).alias("lat"), (s % 3).alias("mask"))
    return dst, src


_CHORD = "(z.px - x.px) ** 2 + (z.py - x.py) ** 2 + (z.pz - x.pz) ** 2"


@query("nearest_knn", f"WITH {_PTS} SELECT row, arg_min(col, (round({_CHORD}, 12), col)) AS col, round(min({_CHORD}), 9) AS d2 FROM z, x GROUP BY row")
def nearest_knn(spark: SparkSession, sf: str) -> DataFrame:
    dst, src = _points(spark, sf)
    return weights.knn(dst.select("row", "lon", "lat"), src, 1, digits=12).select("row", "col", r6("d2", 9))


@query("knn_four", f"WITH {_PTS}, k AS (SELECT row, {_CHORD} AS d, row_number() OVER (PARTITION BY row ORDER BY {_CHORD}, col) AS rank FROM z, x) SELECT row, rank::INT AS rank, round(d, 9) AS d2 FROM k WHERE rank <= 4")
def knn_four(spark: SparkSession, sf: str) -> DataFrame:
    dst, src = _points(spark, sf)
    return weights.knn(dst.select("row", "lon", "lat"), src, 4).select("row", "rank", r6("d2", 9))


@query("extrapolate_nearest", f"WITH {_PTS}, e AS (SELECT c.row, min((c.lon - s.lon) ** 2 + (c.lat - s.lat) ** 2) AS d FROM c, s WHERE s.mask <> 0 AND c.m <> 0 GROUP BY c.row) SELECT row, round(d, 6) AS d2 FROM e")
def extrapolate_nearest(spark: SparkSession, sf: str) -> DataFrame:
    dst, src = _points(spark, sf)
    have = dst.where("m = 0").select("row", F.lit(0).cast("long").alias("col"), F.lit(0.5).alias("w"))
    out = weights.extrapolate_nearest(have, dst.select("row", "lon", "lat"), src).where("w = 1.0")
    p = out.join(dst.select("row", "lon", "lat"), "row").join(src.select("col", F.col("lon").alias("x"), F.col("lat").alias("y")), "col")
    return p.select("row", F.round((F.col("lon") - F.col("x")) ** 2 + (F.col("lat") - F.col("y")) ** 2, 6).alias("d2"))


_SITES = "SELECT s_suppkey AS row, round(3 + 2 * (2 + s_suppkey * 37 % 4500 / 100) - 0.5 * (1.2 + s_suppkey * 53 % 60 / 100), 4) AS value FROM supplier"


def _lattice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts on a lattice of 50 columns and suppliers at places inside it."""
    part, supp = table(spark, sf, "part"), table(spark, sf, "supplier")
    src = part.select(F.col("p_partkey").alias("col"), (F.col("p_partkey") % 50).cast("double").alias("lon"), F.expr("cast(p_partkey div 50 as double)").alias("lat"))
    dst = supp.select(F.col("s_suppkey").alias("row"), (2 + F.col("s_suppkey") * 37 % 4500 / 100).alias("lon"), (1.2 + F.col("s_suppkey") * 53 % 60 / 100).alias("lat"))
    return src, dst


def _linear_field(w: DataFrame, src: DataFrame) -> DataFrame:
    value = 3 + 2 * F.col("lon") - 0.5 * F.col("lat")
    return w.join(src, "col").groupBy("row").agg(F.round(F.sum(F.col("w") * value), 4).alias("value"))


@query("bilinear_mesh", _SITES)
def bilinear_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """Every quad that holds the point reproduces a linear field."""
    src, dst = _lattice(spark, sf)
    return _linear_field(weights.bilinear(dst, src), src)


@query("bicubic_mesh", _SITES)
def bicubic_mesh(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = _lattice(spark, sf)
    return _linear_field(weights.bicubic(dst, src), src)


@query("patch_mesh", _SITES)
def patch_mesh(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = _lattice(spark, sf)
    return _linear_field(weights.patch(dst, src), src)


@query("conservative_polygon", f"WITH {_overlap_sql(Regular(12, 6, 0, -60, 5, 5), Regular(8, 4, 2, -52, 6, 6))} SELECT row, count(*) AS n FROM o GROUP BY row")
def conservative_polygon(spark: SparkSession, sf: str) -> DataFrame:
    src = grids.with_ring(grids.regular_cells(spark, Regular(12, 6, 0, -60, 5, 5))).select(F.col("cell_id").alias("col"), "ring")
    dst = grids.with_ring(grids.regular_cells(spark, Regular(8, 4, 2, -52, 6, 6))).select(F.col("cell_id").alias("row"), "ring")
    # Great-circle edges bulge over parallels, so neighbours touch in slivers; those stay under a hundredth of the cell.
    return weights.conservative(src, dst).where("w > 0.01").groupBy("row").agg(F.count("*").alias("n"))


@query("conservative_planar", "WITH s AS (SELECT range AS col, (range % 10) * 3.0::DOUBLE AS x, (range // 10) * 3.0::DOUBLE AS y FROM range(80)), d AS (SELECT range AS row, (range % 6) * 4.5::DOUBLE + 1 AS x, (range // 6) * 4.5::DOUBLE + 1 AS y FROM range(30)) SELECT row, col, round((least(d.x + 4.5, s.x + 3) - greatest(d.x, s.x)) * (least(d.y + 4.5, s.y + 3) - greatest(d.y, s.y)) / 20.25, 6) AS w FROM s, d WHERE s.x < d.x + 4.5 AND s.x + 3 > d.x AND s.y < d.y + 4.5 AND s.y + 3 > d.y")
def conservative_planar(spark: SparkSession, sf: str) -> DataFrame:
    src = grids.with_ring(grids.regular_cells(spark, Regular(10, 8, 0, 0, 3, 3, False))).select(F.col("cell_id").alias("col"), "ring")
    dst = grids.with_ring(grids.regular_cells(spark, Regular(6, 5, 1, 1, 4.5, 4.5, False))).select(F.col("cell_id").alias("row"), "ring")
    return weights.conservative(src, dst, spherical=False).select("row", "col", r6("w"))


@query("adjacency", "WITH c AS (SELECT range AS id, range % 8 AS i, range // 8 AS j FROM range(40)) SELECT a.id AS cell, b.id AS neighbour FROM c a, c b WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return weights.adjacency(grids.with_ring(grids.regular_cells(spark, Regular(8, 5, 0, 0, 1, 1, False))))


_GP = "p AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 19) / 4 AS x, (s_suppkey * 11 % 23) / 4 AS y, (s_suppkey * 5 % 17) / 4 AS z, s_acctbal AS v FROM supplier)"
_GS = "s AS (SELECT a.k, count(*) n, sum((b.x-a.x)*(b.x-a.x)) xx, sum((b.x-a.x)*(b.y-a.y)) xy, sum((b.x-a.x)*(b.z-a.z)) xz, sum((b.y-a.y)*(b.y-a.y)) yy, sum((b.y-a.y)*(b.z-a.z)) yz, sum((b.z-a.z)*(b.z-a.z)) zz, sum((b.x-a.x)*(b.v-a.v)) bx, sum((b.y-a.y)*(b.v-a.v)) by_, sum((b.z-a.z)*(b.v-a.v)) bz FROM p a JOIN p b ON a.k <> b.k AND abs(a.k - b.k) <= 4 GROUP BY a.k)"
_GI = "i AS (SELECT *, yy*zz - yz*yz c11, xz*yz - xy*zz c12, xy*yz - xz*yy c13, xx*zz - xz*xz c22, xy*xz - xx*yz c23, xx*yy - xy*xy c33 FROM s), j AS (SELECT *, xx*c11 + xy*c12 + xz*c13 AS det FROM i)"


@query("gradient", f"WITH {_GP}, {_GS}, {_GI} SELECT k AS cell, round((c11*bx + c12*by_ + c13*bz) / det, 3) AS gx, round((c12*bx + c22*by_ + c23*bz) / det, 3) AS gy, round((c13*bx + c23*by_ + c33*bz) / det, 3) AS gz FROM j")
def gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Least-squares gradients of account balances over scattered points, eight neighbours by key; SQL inverts the normal equations."""
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select(k.alias("cell"), (k * 7 % 19 / 4).alias("x"), (k * 11 % 23 / 4).alias("y"), (k * 5 % 17 / 4).alias("z"), F.col("s_acctbal").alias("value"))
    near = c.select("cell", F.explode(F.array(*[F.col("cell") + d for d in range(-4, 5) if d])).alias("neighbour"))
    return weights.gradient(c, near).select("cell", r6("gx", 3), r6("gy", 3), r6("gz", 3))


@query("vector_rotate", f"WITH {_W}, x AS (SELECT row, w, s_acctbal AS u, s_nationkey AS v, radians(row) - radians(col) AS a FROM w0 JOIN supplier ON col = s_suppkey) SELECT d.row, round(coalesce(sum(w * (cos(a) * u + sin(a) * v)), 0), 4) AS u, round(coalesce(sum(w * (cos(a) * v - sin(a) * u)), 0), 4) AS v FROM dst d LEFT JOIN x ON d.row = x.row GROUP BY d.row")
def vector_rotate(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = 1_000_000
    sa = s.select(F.col("s_suppkey").alias("col"), F.radians(F.col("s_suppkey").cast("double")).alias("alpha"))
    da = _rows(spark).select("row", F.radians(F.col("row").cast("double")).alias("alpha"))
    wu, wv = weights.vector_weights(_weights(spark, sf), sa, da, n)
    stacked = s.select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value")).unionByName(s.select((F.col("s_suppkey") + n).alias("col"), F.col("s_nationkey").cast("double").alias("value")))
    u, v = (ap.apply(w, stacked, _rows(spark)).select("row", F.round("value", 4).alias(c)) for w, c in ((wu, "u"), (wv, "v")))
    return u.join(v, "row")


_SCALED = "floor((({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) * 65535)::BIGINT"


@query("sphere_points", "WITH p AS (SELECT c_custkey AS id, (c_custkey * 137 % 3600) / 10 AS lon, (c_custkey * 61 % 1700) / 10 - 85 AS lat FROM customer) SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z, round(lat, 6) AS lat, round(((lon * 7 - 900) % 360 + 360) % 360, 6) AS wrapped FROM p")
def sphere_points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 137 % 3600 / 10).alias("lon"), (F.col("c_custkey") * 61 % 1700 / 10 - 85).alias("lat"))
    p = p.withColumn("p", grids.xyz(F.col("lon"), F.col("lat"))).withColumn("back", grids.lonlat(F.col("p.x"), F.col("p.y"), F.col("p.z")))
    return p.select("id", *[F.round(F.col(f"p.{c}"), 9).alias(c) for c in "xyz"], F.round("back.lat", 6).alias("lat"), F.round(grids.normalize_lon(F.col("lon") * 7 - 900), 6).alias("wrapped"))


@query("morton_sort", f"WITH p0 AS (SELECT c_custkey AS id, (c_custkey * 137 % 3600) / 10 AS lon, (c_custkey * 61 % 1700) / 10 - 85 AS lat FROM customer), p AS (SELECT id, {_SCALED.format(c='lon')} AS x, {_SCALED.format(c='lat')} AS y FROM p0) SELECT id, (SELECT sum(((x >> b) & 1) << (2 * b)) + sum(((y >> b) & 1) << (2 * b + 1)) FROM range(16) t(b))::BIGINT AS morton FROM p")
def morton_sort(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (k * 137 % 3600 / 10).alias("lon"), (k * 61 % 1700 / 10 - 85).alias("lat"))
    return weights.morton_sort(points).select("id", "morton")


# ------------------------------------------------------------ exchange, logs, hyperslabs


@query("halo_ghost", "WITH c AS (SELECT l_linenumber - 1 AS rank, l_orderkey % 100 AS i, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT rank - 1 AS rank, i + 100 AS i0, v AS value FROM c WHERE i < 2 AND rank >= 1 UNION ALL SELECT rank + 1, i - 100, v FROM c WHERE i >= 98 AND rank + 1 <= (SELECT max(rank) FROM c)")
def halo_ghost(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("rank"), (F.col("l_orderkey") % 100).alias("i0")).agg(F.sum("l_quantity").alias("value"))
    return exchange.halo_ghost(c, [100], 2)


@query("allgather", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS pos, n_regionkey AS rank, n_nationkey AS idx FROM nation")
def allgather(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("rank"), F.col("n_nationkey").alias("idx"))
    return exchange.allgather(n).select("pos", "rank", "idx")


_HX = "v AS (SELECT n_regionkey AS owner, n_nationkey AS local_id, n_nationkey * 1.5 AS value FROM nation), p AS (SELECT c_custkey % 5 AS rank, c_custkey AS slot, c_nationkey % 5 AS owner, c_nationkey AS local_id FROM customer)"


@query("halo_exchange", f"WITH {_HX} SELECT rank, slot, coalesce(value, -1)::DOUBLE AS value FROM p LEFT JOIN v USING (owner, local_id)")
def halo_exchange(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "nation").select(F.col("n_regionkey").alias("rank"), F.col("n_nationkey").alias("local_id"), (F.col("n_nationkey") * 1.5).alias("value"))
    c = table(spark, sf, "customer")
    p = c.select((F.col("c_custkey") % 5).alias("rank"), F.col("c_custkey").alias("slot"), (F.col("c_nationkey") % 5).alias("owner"), F.col("c_nationkey").alias("local_id"))
    return exchange.halo_exchange(v, p).select("rank", "slot", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("prefix_sum", "WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS exclusive_sum FROM n")
def prefix_sum(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return exchange.prefix_sum(n, "k", "n").select("k", "exclusive_sum")


@query("allreduce", "SELECT l_partkey % 100 AS pos, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def allreduce(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rank"), (F.col("l_partkey") % 100).alias("pos"), F.col("l_quantity").alias("value"))
    a, b, c = (exchange.allreduce(v, op).withColumnRenamed("value", n) for op, n in (("sum", "total"), ("min", "low"), ("max", "high")))
    return a.join(b, "pos").join(c, "pos").select("pos", r6("total", 2), "low", "high")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.element_at(F.array(*map(F.lit, logs.SEVERITIES)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select(sev.alias("severity"), F.col("event_type").alias("message"), (F.col("user_id") % 16).cast("int").alias("rank"))


_SEV = "['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][event_id % 6 + 1]"


@query("severity_filter", f"SELECT s AS severity, m AS message, r AS rank, count(*) AS n FROM (SELECT {_SEV} AS s, event_type AS m, (user_id % 16)::INT AS r FROM events) WHERE s IN ('WARN', 'ERROR', 'FATAL') GROUP BY ALL")
def severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return logs.severity_filter(_log(spark, sf), "WARN").groupBy("severity", "message", "rank").agg(F.count("*").alias("n"))


@query(
    "log_consolidate",
    f"WITH l AS (SELECT DISTINCT {_SEV} AS s, event_type || '-' || (user_id % 7) AS m, (user_id % 48)::INT AS r FROM events), g AS (SELECT *, r - row_number() OVER (PARTITION BY s, m ORDER BY r) AS g FROM l), a AS (SELECT s, m, min(r) AS a, max(r) AS b FROM g GROUP BY s, m, g) SELECT s AS severity, m AS message, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranks, sum(b - a + 1)::BIGINT AS n_ranks FROM a GROUP BY s, m",
)
def log_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    sev = F.element_at(F.array(*map(F.lit, logs.SEVERITIES)), (F.col("event_id") % 6 + 1).cast("int"))
    return logs.consolidate(e.select(sev.alias("severity"), F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("message"), (F.col("user_id") % 48).cast("int").alias("rank")))


@query("hyperslab", "SELECT vec_id, p::BIGINT AS pos, embedding[p + 1]::DOUBLE AS value FROM embeddings, range(4, 40, 5) t(p) WHERE vec_id >= 10 AND (vec_id - 10) % 3 = 0 AND vec_id <= 10 + 19 * 3")
def hyperslab(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import fieldstore

    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    box = fieldstore.Box(offsets=(10, 4), extents=(20, 8), strides=(3, 5))
    shape = (1 << 40, 64)
    return fieldstore.hyperslab(e, ["vec_id", "pos"], box, shape).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


def _spline_sql() -> str:
    """Forward elimination and back substitution of the spline's system as recursive queries; levels are a unit apart."""
    y = lambda i: f"embedding[{i}]::DOUBLE"
    sinh = lambda x: f"((exp({x}) - exp(-({x}))) / 2)"
    forward = f"f(vec_id, i, u, d) AS (SELECT vec_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM embeddings UNION ALL SELECT f.vec_id, i + 1, 1 / (4 - u), (3 * ({y('i + 3')} - 2 * {y('i + 2')} + {y('i + 1')}) - d) / (4 - u) FROM f JOIN embeddings e ON e.vec_id = f.vec_id WHERE i < 62)"
    back = "b(vec_id, i, d) AS (SELECT vec_id, 63, 0.0::DOUBLE FROM embeddings UNION ALL SELECT b.vec_id, b.i - 1, f.d - f.u * b.d FROM b JOIN f ON f.vec_id = b.vec_id AND f.i = b.i - 1 WHERE b.i > 0)"
    points = "p(name, k, t) AS (VALUES ('a', 0, 0.0::DOUBLE), ('b', 0, 0.5), ('c', 10, 0.25), ('d', 62, 1.0))"
    at = f"q AS (SELECT e.vec_id, name, t, {y('k + 1')} AS y0, {y('k + 2')} AS y1, l.d AS d0, r.d AS d1 FROM embeddings e, p JOIN b l ON l.i = k JOIN b r ON r.i = k + 1 WHERE l.vec_id = e.vec_id AND r.vec_id = e.vec_id)"
    sh, den = sinh("1"), f"((exp(1) + exp(-1)) / 2 - {sinh('1')})"
    value = f"round(y0 * (1 - t) + y1 * t + ((d0 - (y1 - y0)) * ({sinh('1 - t')} - (1 - t) * {sh}) + (d1 - (y1 - y0)) * ({sinh('t')} - t * {sh})) / {den}, 6)"
    pick = ", ".join(f"max({value}) FILTER (name = '{c}') AS {c}" for c in "abcd")
    return f"WITH RECURSIVE {forward}, {back}, {points}, {at} SELECT vec_id, {pick} FROM q GROUP BY vec_id"


@query("vertical_spline", _spline_sql())
def vertical_spline(spark: SparkSession, sf: str) -> DataFrame:
    """All 64 components as a column of levels, by a spline of tension 1."""
    lev = [float(k) for k in range(64)]
    v = vertical.interpolate(F.col("embedding").cast("array<double>"), lev, [0.0, 0.5, 10.25, 63.0], 1.0)
    out = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return out.select("vec_id", *[F.round(F.get("v", F.lit(k)), 6).alias(c) for k, c in enumerate("abcd")])


_LUNE = "(k * 37 % 360)::DOUBLE AS x, (10 + k % 50)::DOUBLE AS w, k % 2 AS h"


# Meridians and the equator are great circles, so cells from the equator to a pole overlap by shares of longitude.
@query("clip_area", f"WITH d AS (SELECT k, {_LUNE} FROM (SELECT s_suppkey AS k FROM supplier)), s AS (SELECT n_nationkey * 2 + hh AS col, n_nationkey * 14.4::DOUBLE + turn * 360 AS x, hh FROM nation, (VALUES (0), (1)) a(hh), (VALUES (-1), (0), (1)) b(turn)) SELECT k AS row, col::BIGINT AS col, round(sum(least(d.x + w, s.x + 14.4) - greatest(d.x, s.x)) / any_value(w), 6) AS w FROM d JOIN s ON h = hh AND s.x < d.x + w - 1e-9 AND s.x + 14.4 > d.x + 1e-9 GROUP BY k, col")
def clip_area(spark: SparkSession, sf: str) -> DataFrame:
    """Spherical overlaps of cells between equator and pole, clipped as polygons."""
    p = lambda x, y: F.struct(x.cast("double").alias("lon"), F.lit(y).cast("double").alias("lat"))
    north = lambda a, b: F.array(p(a, 0), p(b, 0), p(a, 90))
    south = lambda a, b: F.array(p(b, 0), p(a, 0), p(a, -90))
    lune = lambda h, a, b: F.when(h == 1, south(a, b)).otherwise(north(a, b))
    k = F.col("s_suppkey")
    a = (k * 37 % 360).cast("double")
    dst = table(spark, sf, "supplier").select(k.alias("row"), lune(k % 2, a, a + 10 + k % 50).alias("ring"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    src = n.select((F.col("n") * 2 + F.col("h")).cast("long").alias("col"), lune(F.col("h"), F.col("n") * 14.4, F.col("n") * 14.4 + 14.4).alias("ring"))
    return weights.conservative(src, dst).where("w > 1e-9").select("row", "col", r6("w"))


# ------------------------------------------------------------ meshes


@query("cell_area", f"SELECT cell_id, round(radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo))), 4) AS area FROM {_cells_sql(Regular.world(144, 72))}")
def cell_area(spark: SparkSession, sf: str) -> DataFrame:
    """Polygon areas of small cells, within 1e-4 of the zone formula of their parallels."""
    c = grids.with_ring(grids.regular_cells(spark, Regular.world(144, 72)))
    return c.select("cell_id", F.round(grids.ring_area(F.col("ring")), 4).alias("area"))


@query("planar_area", "SELECT s_suppkey AS cell_id, round((1 + s_suppkey % 7) * (2 + s_suppkey % 5) / 2.0, 6) AS area, round((1 + s_suppkey % 7) / 3.0, 6) AS cx, round((2 + s_suppkey % 5) / 3.0, 6) AS cy FROM supplier")
def planar_area(spark: SparkSession, sf: str) -> DataFrame:
    """Shoelace area and centroid of right triangles."""
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    z = F.lit(0)
    t = table(spark, sf, "supplier").select(k.alias("cell_id"), F.array(p(z, z), p(1 + k % 7, z), p(z, 2 + k % 5)).alias("ring"))
    c = grids.ring_centroid(F.col("ring"), spherical=False)
    return t.select("cell_id", F.round(grids.ring_area(F.col("ring"), spherical=False), 6).alias("area"), F.round(c.getField("lon"), 6).alias("cx"), F.round(c.getField("lat"), 6).alias("cy"))


@query("clean_ring", "SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 3 + s_suppkey % 3 END AS n FROM supplier WHERE s_suppkey % 4 <> 3")
def clean_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Rings padded by repeats and closed by their first vertex; every fourth has two vertices only."""
    k = F.col("s_suppkey")
    n = F.when(k % 4 == 3, 2).otherwise(3 + k % 3)
    at = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when(i < n, i).when(i < 7, n - 1).otherwise(0))
    b = table(spark, sf, "supplier").select(k.alias("cell_id"), F.transform(at, lambda i: i * 1.5).alias("lons"), F.transform(at, lambda i: i * i * 1.0).alias("lats"))
    return grids.bounds_mesh(b).select("cell_id", F.size("ring").cast("long").alias("n"))


@query("ugrid_triangles", "SELECT range AS cell_id, 2::BIGINT AS n FROM range(20)")
def ugrid_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """1-based faces of a 5x4 grid of quads, padded with -1, joined to their nodes and cut into triangles."""
    nodes = spark.range(30).select((F.col("id") + 1).alias("node_id"), (F.col("id") % 6).cast("double").alias("lon"), (F.expr("id div 6")).cast("double").alias("lat"))
    a = F.expr("id div 5") * 6 + F.col("id") % 5 + 1
    faces = spark.range(20).select(F.col("id").alias("cell_id"), F.array(a, a + 1, a + 7, a + 6, F.lit(-1).cast("long")).alias("nodes"))
    mesh = grids.ugrid_mesh(nodes.withColumn("node_id", F.col("node_id") - 1), faces, 1)
    return grids.triangulate(mesh).groupBy("cell_id").agg(F.count("*").alias("n"))


@query("curvilinear_corners", "WITH c AS (SELECT a.range AS i, b.range AS j FROM range(7) a, range(5) b), e AS (SELECT i, j, (greatest(i - 1, 0) + least(i, 5)) / 2.0 AS x, (greatest(j - 1, 0) + least(j, 3)) / 2.0 AS y FROM c) SELECT i, j, round(x * 2 + y, 6) AS lon, round(y * 3, 6) AS lat FROM e")
def curvilinear_corners(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.range(24).select((F.col("id") % 6).alias("i"), (F.expr("id div 6")).alias("j"))
    c = c.select("i", "j", (F.col("i") * 2.0 + F.col("j")).alias("lon"), (F.col("j") * 3.0).alias("lat"))
    return grids.curvilinear_corners(c, 6, 4).select("i", "j", r6("lon"), r6("lat"))


@query("named_grid_sizes", "SELECT * FROM (VALUES ('F8', 512::BIGINT, 480::BIGINT), ('N8', 544, 552), ('O8', 544, 552), ('R8', 465, 465)) t(name, points, cells)")
def named_grid_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Points and cells of named grids: O and N have 4N(N+9) points and as many quads a band as its longer ring has points."""
    out = []
    for name in ("F8", "N8", "O8", "R8"):
        points = grids.named_points(spark, name)
        cells = grids.gaussian_mesh(spark, name) if name[0] != "R" else points
        out.append(points.agg(F.count("*").alias("points")).crossJoin(cells.agg(F.count("*").alias("cells"))).select(F.lit(name).alias("name"), "points", "cells"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("gaussian_reduced_area", "SELECT round(4 * pi(), 9) AS area, 360::BIGINT AS n")
def gaussian_reduced_area(spark: SparkSession, sf: str) -> DataFrame:
    return grids.rule_mesh(spark, "gaussian_reduced", n=6).agg(F.round(F.sum("area"), 9).alias("area"), F.count("*").alias("n"))


@query("degenerate_cells", "SELECT s_suppkey AS cell_id, CASE s_suppkey % 3 WHEN 0 THEN 'few_vertices' WHEN 1 THEN 'zero_area' END AS why FROM supplier")
def degenerate_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    ring = F.when(k % 3 == 0, F.array(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 0.0))).when(k % 3 == 1, F.array(p(0.0, 0.0), p(1.0, 0.0), p(2.0, 0.0))).otherwise(F.array(p(0.0, 0.0), p(1.0, 0.0), p(0.0, 1.0)))
    t = table(spark, sf, "supplier").select(k.alias("cell_id"), ring.alias("ring"))
    return t.select("cell_id", grids.degenerate(F.col("ring"), grids.ring_area(F.col("ring"), spherical=False)).alias("why"))


_CAPS = "c AS (SELECT s_suppkey AS k, cos(radians(s_suppkey * 2.0)) AS x, sin(radians(s_suppkey * 2.0)) AS y, radians(s_suppkey % 5 + 0.5 + 1e-9) AS r FROM supplier)"


@query("cap_filter", f"WITH {_CAPS} SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.k < b.k AND acos(greatest(least(a.x * b.x + a.y * b.y, 1), -1)) <= a.r + b.r")
def cap_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Caps along the equator two degrees apart, with radii of half a degree and more; every pair that meets."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    lon, r = F.radians(F.col("s_suppkey") * 2.0), F.radians(F.col("s_suppkey") % 5 + 0.5 + 1e-9)
    cap = lambda p: s.select(F.col("s_suppkey").alias(p), F.cos(lon).alias(f"{p}x"), F.sin(lon).alias(f"{p}y"), F.lit(0.0).alias(f"{p}z"), r.alias(f"{p}r"))
    return weights.cap_join(cap("a"), cap("b")).where("a < b").select("a", "b")


# ------------------------------------------------------------ more exchange and sources


@query("halo_pattern", "WITH w AS (SELECT DISTINCT l_orderkey % 4 AS rank, l_suppkey % 3 AS owner, l_suppkey AS col FROM lineitem WHERE l_orderkey % 4 <> l_suppkey % 3) SELECT rank, owner, col, row_number() OVER (PARTITION BY rank ORDER BY owner, col) - 1 AS slot FROM w")
def halo_pattern(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    w = li.select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"))
    rows = li.select(F.col("l_orderkey").alias("row")).distinct().withColumn("rank", F.col("row") % 4)
    cols = li.select(F.col("l_suppkey").alias("col")).distinct().withColumn("owner", F.col("col") % 3)
    return exchange.halo_pattern(w, rows, cols).withColumn("slot", F.col("slot").cast("long"))


@query("gather_replicated", "SELECT row_number() OVER (ORDER BY l_linenumber, l_orderkey, l_partkey) - 1 AS pos, l_linenumber AS level, l_orderkey AS j, l_partkey AS i FROM lineitem")
def gather_replicated(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rank"), F.col("l_linenumber").alias("level"), F.col("l_orderkey").alias("j"), F.col("l_partkey").alias("i"))
    return exchange.gather_replicated(b).select("pos", "level", "j", "i")


@query("split_communicator", "SELECT n_regionkey AS color, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey * 7 % 25, n_nationkey) - 1 AS new_rank, n_nationkey AS rank FROM nation")
def split_communicator(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_regionkey").alias("color"), (F.col("n_nationkey") * 7 % 25).alias("key"))
    return exchange.split_communicator(n).withColumn("new_rank", F.col("new_rank").cast("long"))


@query("scrip_egress", f"WITH {_W} SELECT col + 1 AS src_address, row + 1 AS dst_address, round(sum(w), 4) AS remap_matrix FROM w0 GROUP BY ALL")
def scrip_egress(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import fieldstore

    cell = lambda k: spark.range(1).select(F.col("id").alias(k), *[F.lit(0.0).alias(c) for c in ("clon", "clat", "area", "frac")])
    links = fieldstore.scrip_egress(_weights(spark, sf), cell("col"), cell("row"), "conservative")["links"]
    return links.groupBy("src_address", "dst_address").agg(F.round(F.sum("remap_matrix"), 4).alias("remap_matrix"))


@query("vertical_own_levels", "SELECT vec_id, round(a + (b - a) * 0.25, 6) AS low, round(b, 6) AS high FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)")
def vertical_own_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Every column has two levels of its own, 10 apart, rising or falling."""
    up = F.array(F.lit(10.0), F.lit(20.0))
    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))
    turn = lambda a: F.when(F.col("vec_id") % 2 == 0, a).otherwise(F.reverse(a))
    v = vertical.interpolate_own(e.select(F.col("vec_id").alias("col_id"), turn(up).alias("levels"), turn(F.col("v")).alias("vals")), [12.5, 20.0])
    return v.select(F.col("col_id").alias("vec_id"), F.round(F.get("vals", F.lit(0)), 6).alias("low"), F.round(F.get("vals", F.lit(1)), 6).alias("high"))


@query("vertical_two_levels", "SELECT vec_id, k::BIGINT AS level, round(embedding[k + 1]::DOUBLE + (embedding[k + 2]::DOUBLE - embedding[k + 1]::DOUBLE) * 0.25, 6) AS a, round(embedding[k + 2]::DOUBLE, 6) AS b FROM embeddings, range(63) t(k)")
def vertical_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels make a straight line, whatever the spline: every pair of neighbouring components."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level"))
    v = vertical.interpolate(F.slice("e", F.col("level") + 1, 2), [10.0, 20.0], [12.5, 20.0])
    return e.select("vec_id", F.col("level").cast("long").alias("level"), v.alias("v")).select("vec_id", "level", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(1)), 6).alias("b"))


@query("format_record", f"SELECT event_id, printf('[RANK:%04d] [%s] %s', (user_id % 16)::INT, {_SEV}, event_type) AS line FROM events")
def format_record(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.element_at(F.array(*map(F.lit, logs.SEVERITIES)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", logs.format_record((F.col("user_id") % 16).cast("int"), sev, F.col("event_type")).alias("line"))


@query("coastal", "SELECT range AS row, 1.0::DOUBLE AS total FROM range(64)")
def coastal(spark: SparkSession, sf: str) -> DataFrame:
    """Conservative weights with half the source masked: every destination still sums to one."""
    from .regridder import Mesh, Regridder

    g = Regular(8, 8, 0, -20, 5, 5)
    src = grids.with_ring(grids.regular_cells(spark, g)).withColumn("mask", (F.col("i") + F.col("j")) % 2).select("cell_id", "ring", "mask")
    r = Regridder(Mesh(src), Mesh.of_regular(Regular(8, 8, 1, -19, 5, 5)), "conservative", "fracarea").fit(spark)
    return ap.total_weights(r.weights).select("row", F.round("total", 6).alias("total"))
