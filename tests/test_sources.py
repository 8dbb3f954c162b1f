import numpy as np
import pytest

from fieldspark.sources import files, grib, netcdf, zarr


@pytest.fixture(scope="module")
def field(spark):
    grib.register(spark)
    from pyspark.sql import functions as F

    return spark.range(60).select((F.expr("id div 12")).alias("i0"), (F.col("id") % 12).alias("i1"), (F.col("id") * 0.5).alias("value"))


@pytest.mark.parametrize("shards", [None, [4, 6]])
def test_zarr_round_trip(spark, field, tmp_path, shards):
    path = str(tmp_path / "a")
    zarr.write(field, path, [5, 12], [2, 3], shards=shards, attributes={"units": "K"})
    back = spark.read.format("zarr3").load(path)
    assert back.exceptAll(field).count() == 0 and back.count() == 60
    assert back.where("i0 = 3 and i1 >= 9").count() == 3
    assert zarr.Array.open(path).meta["attributes"] == {"units": "K"}
    r = zarr._Reader(zarr.Array.open(path))
    assert len(r.partitions()) == (4 if shards else 12)
    with pytest.raises(ValueError):
        zarr.Array("x", zarr.metadata([4], [3], "float64", [4]))


def test_crc32c():
    assert zarr.crc32c(b"123456789") == 0xE3069283


@pytest.mark.parametrize("record", [True, False])
def test_netcdf(spark, field, tmp_path, record):
    t = np.arange(24, dtype=np.float32).reshape(3, 2, 4)
    lev = np.array([1.0, 2.0])
    raw = netcdf.encode({"time": None if record else 3, "y": 2, "x": 4}, {"t": (["time", "y", "x"], t, {"units": "K", "scale": 2.0}), "lev": (["y"], lev, {})}, {"title": "demo"})
    (tmp_path / "a.nc").write_bytes(raw)
    h = netcdf.header(str(tmp_path / "a.nc"))
    assert h.attributes == {"title": "demo"} and h.variables["t"].attributes == {"units": "K", "scale": [2.0]}
    assert h.describe("t") == {"dtype": "float", "shape": [2, 4], "timesteps": 3}
    df = spark.read.format("netcdf").option("variable", "t").load(str(tmp_path / "a.nc"))
    got = {(r.t_idx, r.i0, r.i1): r.value for r in df.collect()}
    assert got == {(k, j, i): t[k, j, i] for k in range(3) for j in range(2) for i in range(4)}
    assert df.where("t_idx = 2").count() == 8
    assert [r.value for r in spark.read.format("netcdf").option("variable", "lev").load(str(tmp_path / "a.nc")).orderBy("i0").collect()] == [1.0, 2.0]


def test_grib(spark, field, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(280, 10, (5, 8)), rng.normal(0, 1, (5, 8))
    b[1, 2] = np.nan
    (tmp_path / "f.grb").write_bytes(grib.encode(a) + grib.encode(b, category=2) + grib.encode(a + 1))
    recs = grib.index(str(tmp_path / "f.grb"))
    assert [(r.param, r.t_idx, r.level) for r in recs] == [("0.0.0", 0, 2.0), ("0.2.0", 0, 2.0), ("0.0.0", 1, 2.0)]
    df = spark.read.format("grib2").load(str(tmp_path / "f.grb"))
    got = {(r.i0, r.i1): r.value for r in df.where("param = '0.0.0' and t_idx = 1").collect()}
    assert all(abs(got[j, i] - a[j, i] - 1) < 1e-2 for j in range(5) for i in range(8))
    assert df.where("param = '0.2.0' and isnan(value)").count() == 1
    assert grib.lossless_template("JPEG2000") == 40
    with pytest.raises(ValueError):
        grib.lossless_template("simple")
    assert grib.row_major([2, 3], [3, 1]) and grib.row_major([2, 3], [0, 0]) and not grib.row_major([2, 3], [1, 2])


def test_files(tmp_path):
    files.write_bytes(f"file://{tmp_path}/x/y.bin", b"abc")
    assert files.read_bytes(f"{tmp_path}/x/y.bin", 1, 1) == b"b" and files.size(f"{tmp_path}/x/y.bin") == 3
    assert files.listing(f"{tmp_path}/x") == [f"{tmp_path}/x/y.bin"]


def test_weight_blob(spark):
    from fieldspark.sources import weightblob as wb

    m = wb.Matrix(np.array([0.5, 0.25]), np.array([0, 1]), np.array([1, 0]), np.ones(2), np.array([1.0, 0.5]), np.full(2, 3.0), np.full(2, 4.0))
    raw = wb.serialize(m)
    assert len(raw) == 40 + 8 * (3 * 2 + 2 + 2 + 2 + 2)
    back = wb.Matrix.of(*wb.deserialize(raw).tables(spark))
    assert wb.serialize(back) == raw
    for bad in (raw[:-1], b"x" + raw[1:], raw[:20]):
        with pytest.raises(ValueError):
            wb.deserialize(bad)


def test_versions(spark, tmp_path):
    from fieldspark.sources.versions import Versions

    v = Versions(spark, str(tmp_path / "t"))
    for n in (3, 5, 7):
        v.publish(spark.range(n))
    old = v.read(2)
    assert v.read().count() == 7 and old.count() == 5
    v.rotate(2)
    with pytest.raises(LookupError):
        v.read(1)


def test_numbered_grid():
    from fieldspark.operators import grids

    assert grids.numbered_grid("grid4").ni == 720
    with pytest.raises(ValueError):
        grids.numbered_grid("grid130")
