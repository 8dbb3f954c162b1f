import datetime as dt
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import timex
from fieldspark.operators import exchange, logs
from fieldspark.operators.grids import Regular
from fieldspark.plans import cli
from fieldspark.plans.config import Config, ConfigError
from fieldspark.plans.pipeline import Orchestrator, PipelineConfig, SlotPool, Stream, parse_interval, parse_pipeline, stream_field, topological_order
from fieldspark.sources import netcdf
from fieldspark.sources.fieldstore import Dataset
from fieldspark.streaming.windows import epoch_window, tumbling

TEXT = """
settings: {max_concurrency: 2, deadlock_timeout: 5, shutdown_timeout: 1}
streams:
  - {name: sst, temporal_profile: linear, out_of_bounds_policy: clamp, dataset_path: /x, snapshot_interval: 3600s}
tasks: [{name: a}, {name: b}, {name: c}, {name: d}]
dependencies: [{from: a, to: b}, {from: a, to: c}, {from: b, to: d}, {from: c, to: d}]
"""


def test_config():
    c = Config.from_string("a: {b: [1, 2, {c: x}], f: 1.5, t: true, n: null}")
    assert c.get("a.b.2.c") == "x" and c.get("a.b.0", int) == 1 and c.get("a.f", float) == 1.5 and c.get("a.t", bool) is True
    assert c.find("a.n").kind == "null" and c.find("a.z").kind == "undefined" and len(c.find("a.b")) == 3
    assert c.get_or("a.z", 7) == 7 and c.try_get("a.b", int) is None
    for path, kind, code in (("a..b", str, "invalid_arg"), ("a.z", str, "key_not_found"), ("a.b.9", str, "key_not_found"), ("a.f", int, "type_mismatch"), ("a.b", str, "type_mismatch")):
        with pytest.raises(ConfigError) as e:
            c.get(path, kind)
        assert e.value.code == code
    with pytest.raises(ConfigError):
        Config.from_string("a: [")
    assert Config.from_string("x: [1, 2]").get_list("x", int) == [1, 2]


def test_parse_pipeline():
    p = parse_pipeline(TEXT)
    assert p.tasks == list("abcd") and p.streams[0].interval_ns == 3600 * 10**9 and p.max_concurrency == 2
    assert [parse_interval(x) for x in ("5", "5s", "5S", "5m", "", "-1")] == [5 * 10**9, 5 * 10**9, 5 * 10**9, 0, 0, 0]
    for bad in (TEXT.replace("to: d}]", "to: d}, {from: d, to: a}]"), TEXT.replace("3600s", "1h"), TEXT.replace("{name: d}", "{name: a}"), TEXT.replace("linear", "cubic"), TEXT.replace("from: b, to: d", "from: q, to: d")):
        with pytest.raises(ConfigError):
            parse_pipeline(bad)
    assert topological_order(list("cab"), [("a", "c"), ("b", "c")]) == ["a", "b", "c"]


def test_orchestrator(spark):
    ran, lock = [], threading.Lock()

    def task(name, fail=False):
        def run(s, inputs):
            with lock:
                ran.append(name)
            if fail:
                raise RuntimeError(name)
            return s.range(3).count() + sum(inputs.values())

        return run

    p = parse_pipeline(TEXT)
    r = Orchestrator(spark, p, {t: task(t) for t in p.tasks}).run()
    assert set(r.status.values()) == {"completed"} and ran[0] == "a" and ran[-1] == "d" and r.results["d"] == 3 + 6 + 6
    r = Orchestrator(spark, p, {t: task(t, t == "b") for t in p.tasks}).run()
    assert r.status == {"a": "completed", "b": "failed", "c": "completed", "d": "cancelled"} and str(r.errors["b"]) == "b"
    o = Orchestrator(spark, PipelineConfig(["a", "b"], [("a", "b")]), {"a": lambda s, i: time.sleep(0.5), "b": lambda s, i: 1})
    threading.Timer(0.1, o.shutdown).start()
    assert o.run().status == {"a": "completed", "b": "cancelled"}


def test_slots():
    s = SlotPool(3)
    assert s.allocate(2) and not s.allocate(2) and s.available == 1
    s.release(2)
    s.add(1)
    assert s.remove(9) == 4 and s.total == 0
    with pytest.raises(ValueError):
        s.release(1)


def test_stream_field(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "s"))
    for t in range(3):
        d.write("v", t, spark.range(4).select(F.col("id").alias("i0"), (F.col("id") + 10.0 * t).alias("value")), (4,))
    hour = timex.NS["h"]
    s = Stream("x", "linear", "clamp", str(tmp_path / "s"), hour)
    times = spark.createDataFrame([(hour // 2,), (5 * hour,), (-1,)], "t_ns long")
    got = {(r["sim_ns"], r["cell_id"]): r["value"] for r in stream_field(spark, s, "v", times, 0, 3 * hour).collect()}
    assert got[(hour // 2, 1)] == 6.0 and got[(5 * hour, 0)] == 20.0 and got[(-1, 3)] == 3.0


def test_cli(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "in"))
    d.write("v", 0, spark.range(12 * 6).select(F.col("id").alias("i0"), F.lit(2.5).alias("value")), (72,))
    assert cli.main(["-s", str(tmp_path / "in"), "-g", "12x6", "-t", "8x4", "-o", str(tmp_path / "out"), "-m", "conservative", "--vars", "v"]) == 0
    out = Dataset(spark, str(tmp_path / "out")).read("v", 0)
    assert out.count() == 32 and out.where("abs(value - 2.5) > 1e-9").count() == 0
    assert Regular.world(12, 6).periodic


@pytest.mark.parametrize("method", ["conservative", "bilinear"])
def test_cli_on_files(spark, tmp_path, method):
    """A file whose latitudes fall gives the field of one whose latitudes rise; fill values are left out."""
    lon, lat = np.arange(15.0, 360, 30), np.arange(-75.0, 90, 30)
    t = np.stack([np.full((6, 12), 2.5), lat[:, None] + 0 * lon])
    got = {}
    for name, k in (("up", 1), ("down", -1)):
        variables = {"lat": (["lat"], lat[::k].copy(), {}), "lon": (["lon"], lon, {}), "t": (["time", "lat", "lon"], t[:, ::k].copy(), {}), "rank": (["lat"], lat, {})}
        (tmp_path / f"{name}.nc").write_bytes(netcdf.encode({"time": None, "lat": 6, "lon": 12}, variables))
        out = str(tmp_path / f"{name}-out.nc")
        assert cli.main(["-s", str(tmp_path / f"{name}.nc"), "-t", "8x4", "-o", out, "-m", method]) == 0
        h = netcdf.header(out)
        got[name] = np.stack([netcdf.read_step(out, h, h.variables["t"], k) for k in range(2)])
        assert sorted(h.variables) == ["lat", "lon", "t"]
    assert got["up"].shape == (2, 4, 8) and np.allclose(got["up"][0], 2.5)
    if method == "conservative":
        # Cells of the regular path end on parallels, those of the polygon path on great circles.
        assert np.abs(got["up"] - got["down"]).max() < 3
    holes = np.where(lon < 180, 1.0, -9.0) + 0 * lat[:, None]
    (tmp_path / "holes.nc").write_bytes(netcdf.encode({"lat": 6, "lon": 12}, {"lat": (["lat"], lat, {}), "lon": (["lon"], lon, {}), "t": (["lat", "lon"], holes, {"_FillValue": -9.0})}))
    assert cli.main(["-s", str(tmp_path / "holes.nc"), "-t", str(tmp_path / "up.nc"), "-o", str(tmp_path / "d"), "-m", "conservative", "--skipna"]) == 0
    out = Dataset(spark, str(tmp_path / "d")).read("t", 0)
    assert out.where("i0 % 12 < 6 and abs(value - 1) > 1e-9").count() == 0 and out.where("isnan(value)").count() == 36


def test_streaming_window(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 0, 0, 5), 1.0), (dt.datetime(2026, 1, 1, 0, 0, 8), 2.0), (dt.datetime(2026, 1, 1, 0, 0, 9), 4.0)]
    spark.createDataFrame(rows, "ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    agg = s.withWatermark("ts", "10 seconds").groupBy(epoch_window(F.col("ts"), 7)).agg(F.sum("v").alias("v"))
    q = agg.writeStream.format("memory").queryName("w7").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["window"]["start"]: r["v"] for r in spark.table("w7").collect()}
    assert got == {dt.datetime(2026, 1, 1): 1.0, dt.datetime(2026, 1, 1, 0, 0, 7): 6.0}


def test_exchange_and_logs(spark):
    w = spark.createDataFrame([(0, 0, 1.0), (0, 5, 1.0), (7, 1, 1.0)], "row long, col long, w double")
    rows = spark.createDataFrame([(0, 0), (7, 1)], "row long, rank int")
    cols = spark.createDataFrame([(0, 0), (1, 0), (5, 1)], "col long, owner int")
    got = sorted(map(tuple, exchange.halo_pattern(w, rows, cols).collect()))
    assert got == [(0, 1, 5, 0), (1, 0, 1, 0)]
    req = spark.createDataFrame([(0, 0, 1, 3)], "rank int, slot int, owner int, local_id int")
    vals = spark.createDataFrame([(1, 3, 9.5)], "rank int, local_id int, value double")
    assert exchange.halo_exchange(vals, req).first()["value"] == 9.5
    split = exchange.split_communicator(spark.createDataFrame([(0, 1, 9), (1, 1, 2), (2, 0, 0)], "rank int, color int, key int"))
    assert {r["rank"]: r["new_rank"] for r in split.collect()} == {1: 0, 0: 1, 2: 0}
    with pytest.raises(ValueError):
        exchange.halo_ghost(spark.range(1).select(F.lit(0).alias("rank"), F.lit(0).alias("i0")), [3], 2)
    line = spark.range(1).select(logs.format_record(F.lit(3), F.lit("WARN"), F.lit("x")).alias("s")).first()["s"]
    assert line == "[RANK:0003] [WARN] x" and logs.format_trace(["f", "g"]) == "#0 f\n#1 g"


def test_tumbling_batch_and_sql_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, 0, 5), "a", 1.0), (dt.datetime(2026, 1, 1, 0, 0, 6), "a", 2.0)], "ts timestamp, k string, v double")
    out = tumbling(df, "ts", 7, "1 minute", ["k"], [F.sum("v").alias("total"), F.count("*").alias("n")])
    assert out.columns == ["start", "end", "k", "total", "n"] and out.first()["total"] == 3.0
    timex.register_sql(spark)
    r = spark.sql("select ts_window_start(-1, 10) a, ts_alarm_rings(20, 0, 10) b, ts_alarm_next(20, 0, 10) c, ts_days(date'2026-01-02') d").first()
    assert tuple(r) == (-10, True, 30, 1)
