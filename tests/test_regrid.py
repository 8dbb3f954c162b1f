import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geometry as geo
from fieldspark.operators import apply as ap
from fieldspark.operators import exchange, grids, stencil, vertical, weights
from fieldspark.operators.grids import Regular
from fieldspark.plans.regridder import Mesh, Regridder, VectorRegridder, detect_mesh
from fieldspark.sources import fieldstore


def ones(spark, n):
    return spark.range(n).select(F.col("id").alias("col"), F.lit(1.0).alias("value"))


def test_bilinear_quarter_weights(spark):
    """A 4x2 source on [0,40]x[0,20]; 2x1 destination cells sit amid four centers each."""
    w = weights.bilinear_rect(spark, Regular(4, 2, 0, 0, 10, 10), Regular(2, 1, 0, 0, 20, 20)).collect()
    assert len(w) == 8 and all(r["w"] == pytest.approx(0.25) for r in w)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "conservative"])
def test_partition_of_unity(spark, method):
    r = Regridder(Mesh.of_regular(Regular.world(36, 18)), Mesh.of_regular(Regular.world(25, 14, 3.0)), method).fit(spark)
    out = r.transform(ones(spark, 36 * 18)).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).first()
    assert out["n"] == 25 * 14 and out["a"] == pytest.approx(1) and out["b"] == pytest.approx(1)


def test_conservation(spark):
    src, dst = Regular.world(36, 18), Regular.world(25, 14, 3.0)
    w = weights.conservative_rect(spark, src, dst)
    f = spark.range(36 * 18).select(F.col("id").alias("col"), (F.col("id") % 17 + 1.0).alias("value"))
    out = ap.apply(w.select("row", "col", "w"), f, spark.range(25 * 14).withColumnRenamed("id", "row"))
    a = grids.regular_cells(spark, src).join(f, F.col("cell_id") == F.col("col")).agg(F.sum(F.col("value") * F.col("area"))).first()[0]
    b = grids.regular_cells(spark, dst).join(out, F.col("cell_id") == F.col("row")).agg(F.sum(F.col("value") * F.col("area"))).first()[0]
    assert a == pytest.approx(b, rel=1e-12)


def test_fast_path_equals_polygons_on_plane(spark):
    a, b = Regular(6, 5, 0, 0, 2, 2, False), Regular(4, 3, 1, 1, 2.5, 2.5, False)
    fast = {(r["row"], r["col"]): r["w"] for r in weights.conservative_rect(spark, a, b).collect()}
    ring = lambda g, k: grids.with_ring(grids.regular_cells(spark, g)).select(F.col("cell_id").alias(k), "ring")
    slow = {(r["row"], r["col"]): r["w"] for r in weights.conservative(ring(a, "col"), ring(b, "row"), spherical=False).collect()}
    assert fast.keys() == slow.keys()
    assert all(fast[k] == pytest.approx(slow[k], abs=1e-9) for k in fast)


def test_spherical_polygons_cover(spark):
    m = grids.gaussian_mesh(spark, "F4").select(F.col("cell_id").alias("col"), "ring")
    d = grids.with_ring(grids.regular_cells(spark, Regular(12, 4, 0, -40, 30, 20))).select(F.col("cell_id").alias("row"), "ring")
    s = weights.conservative(m, d).groupBy("row").agg(F.sum("w").alias("w")).collect()
    assert len(s) == 48 and all(r["w"] == pytest.approx(1, abs=1e-6) for r in s)


def test_overlap_random_against_area():
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(0, 360, 50), rng.uniform(-80, 80, 50)
    box = lambda dx, dy: geo.to_xyz(lon[:, None] + np.array([-dx, dx, dx, -dx]), lat[:, None] + np.array([-dy, -dy, dy, dy]))
    inner, outer = box(1, 1), box(4, 4)
    assert np.allclose(geo.overlap(inner, outer), geo.area(inner), rtol=1e-9)
    assert np.allclose(geo.overlap(outer, inner), geo.area(inner), rtol=1e-9)
    assert np.allclose(geo.overlap(inner, geo.to_xyz(lon[:, None] + np.array([9, 11, 11, 9]), lat[:, None] + np.array([-1, -1, 1, 1]))), 0)


def test_local_fits_reproduce_polynomials(spark):
    src = spark.range(144).select(F.col("id").alias("col"), (F.col("id") % 12 + F.col("id") % 7 / 50).cast("double").alias("lon"), (F.expr("id div 12") + F.col("id") % 5 / 50).cast("double").alias("lat"))
    dst = spark.createDataFrame([(0, 5.3, 5.7), (1, 6.1, 4.4)], "row long, lon double, lat double")
    f = {"bilinear": lambda x, y: 1 + 0 * x, "patch": lambda x, y: 1 + x - 2 * y + x * y, "bicubic": lambda x, y: 1 + x * y + x**2 - y**2}
    for name, g in f.items():
        w = getattr(weights, name)(dst, src).join(src, "col").withColumn("value", F.col("w") * g(F.col("lon"), F.col("lat")))
        for r in w.groupBy("row").agg(F.sum("value").alias("v")).join(dst, "row").collect():
            assert r["v"] == pytest.approx(g(r["lon"], r["lat"]), rel=1e-5)


def test_nearest_by_rounded_distances(spark):
    """Sources that lie alike around a destination tie, whatever the last bits of their distances."""
    at = lambda c, x, y: (c, c * x % 3600 / 10, c * y % 1700 / 10 - 85)
    src = spark.createDataFrame([at(c, 71, 29) for c in (3312, 5188, 1612, 3488)], "col long, lon double, lat double")
    dst = spark.createDataFrame([at(c, 137, 61) for c in (39950, 48450)], "row long, lon double, lat double")
    for k in (1, 2):
        near = weights.knn(dst, src, k, digits=12).where("rank = 1")
        assert {r["row"]: r["col"] for r in near.collect()} == {39950: 3312, 48450: 1612}


@pytest.mark.parametrize("k", [1, 16])
def test_neighbours_where_one_source_lies_far_off(spark, k):
    """Dense sources must not meet all destinations because the sources' span is wide."""
    rng = np.random.default_rng(3)
    src = np.round(np.concatenate([rng.uniform(0, 1, (20_000, 2)), np.tile([[0.5, 0.5]], (20, 1)), [[1e6, 1e6]]]), 3)
    dst = np.round(np.concatenate([rng.uniform(0, 1, (3000, 2)), [[1e6, 1e6 - 1], [-5e5, 0.0]]]), 3)
    table = lambda p, key: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(-1, None, 0.5)], f"{key} long, lon double, lat double")
    s, d = table(src, "col"), table(dst, "row")
    began = time.time()
    got = weights.knn(d, s, k, spherical=False).select("row", "rank", "col").toPandas()
    took = time.time() - began
    want = []
    for q in dst:
        d2 = (q[0] - src[:, 0]) ** 2 + (q[1] - src[:, 1]) ** 2
        want.append(np.lexsort((np.arange(len(src)), d2))[:k])
    assert got.sort_values(["row", "rank"])["col"].tolist() == np.concatenate(want).tolist()
    assert sorted(set(got["rank"])) == list(range(1, k + 1)) and took < 25


def test_few_neighbours(spark):
    src = spark.createDataFrame([(4, 350.0, 0.0), (2, 20.0, 0.0)], "col long, lon double, lat double")
    dst = spark.createDataFrame([(7, 0.0, 0.0)], "row long, lon double, lat double")
    assert [(r["row"], r["col"], r["rank"]) for r in weights.knn(dst, src, 3).orderBy("rank").collect()] == [(7, 4, 1), (7, 2, 2)]
    assert weights.knn(dst, src.limit(0), 3).count() == weights.knn(dst.limit(0), src, 3).count() == 0
    assert weights.patch(dst, src).agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_nan_apply(spark):
    nan = float("nan")
    w = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)], "row long, col long, w double")
    s = spark.createDataFrame([(0, 4.0), (1, nan)], "col long, value double")
    d = spark.range(3).withColumnRenamed("id", "row")
    at = lambda t: {r["row"]: r["value"] for r in ap.nan_apply(w, s, d, t).collect()}
    assert at(0.5)[0] == 4.0 and math.isnan(at(0.5)[1]) and math.isnan(at(0.5)[2])
    assert math.isnan(at(0.2)[0])


def test_masks(spark):
    src = grids.with_ring(grids.regular_cells(spark, Regular(8, 4, 0, 0, 5, 5))).withColumn("mask", (F.col("i") < 4).cast("int")).select("cell_id", "ring", "mask")
    r = Regridder(Mesh(src), Mesh.of_regular(Regular(8, 4, 0, 0, 5, 5)), "conservative", "dstarea").fit(spark)
    out = r.transform(ones(spark, 32)).collect()
    assert len(out) == 32 and all(x["value"] == pytest.approx(1, abs=1e-6) for x in out)


def test_second_order_keeps_row_sums(spark):
    src = Mesh(grids.with_ring(grids.regular_cells(spark, Regular(10, 6, 0, -15, 5, 5))).select("cell_id", "ring"))
    dst = Mesh(grids.with_ring(grids.regular_cells(spark, Regular(6, 4, 5, -12, 6, 6))).select("cell_id", "ring"))
    r = Regridder(src, dst, "conservative_2nd_order").fit(spark)
    s = r.weights.groupBy("row").agg(F.sum("w").alias("w"), F.min("w").alias("low")).collect()
    assert all(x["w"] == pytest.approx(1, abs=1e-9) and x["low"] >= 0 for x in s)


def test_vectors(spark):
    m = Mesh.of_regular(Regular(6, 4, 0, 0, 10, 10))
    alpha = lambda k, v: spark.range(24).select(F.col("id").alias(k), F.lit(v).alias("alpha"))
    f = spark.range(24).select(F.col("id").alias("col"), F.lit(1.0).alias("u"), F.lit(0.0).alias("v"))
    r = VectorRegridder(m, m, alpha("col", 0.0), alpha("row", math.pi / 2), 24, "nearest").fit(spark)
    x = r.transform(f).first()
    assert x["u"] == pytest.approx(0, abs=1e-12) and x["v"] == pytest.approx(-1)


def test_grids(spark):
    assert grids.named_points(spark, "O8").count() == 4 * 8 * 17
    assert grids.gaussian_mesh(spark, "F4").count() == 7 * 16
    lat = grids.gaussian_latitudes(2)
    assert lat[0] == pytest.approx(59.4444, abs=1e-3) and (np.diff(lat) < 0).all()
    for bad in ("X3", "O0", "F"):
        with pytest.raises(ValueError):
            grids.parse_name(bad)
    g = Regular.world(12, 6)
    assert grids.detect_regular(grids.regular_cells(spark, g)) == g
    assert detect_mesh(grids.regular_cells(spark, g)).regular == g
    total = grids.rule_mesh(spark, "gaussian_reduced", n=4).agg(F.sum("area")).first()[0]
    assert total == pytest.approx(4 * math.pi)
    with pytest.raises(ValueError):
        grids.rule_mesh(spark, "cubed")
    c = grids.with_ring(grids.regular_cells(spark, g))
    assert c.agg(F.sum(grids.ring_area(F.col("ring")))).first()[0] == pytest.approx(4 * math.pi)
    corners = grids.curvilinear_corners(grids.regular_cells(spark, Regular(4, 3, 0, 0, 1, 1)).select("i", "j", F.col("clon").alias("lon"), F.col("clat").alias("lat")), 4, 3)
    inner = corners.where("i = 2 and j = 1").first()
    assert corners.count() == 20 and (inner["lon"], inner["lat"]) == (2.0, 1.0)


def test_projection_round_trip(spark):
    m = grids.projected_mesh(spark, "lcc", 4, 4, -2e5, -2e5, 1e5, 1e5, lat1=30.0, lat2=60.0, lat0=45.0, lon0=10.0)
    c = m.select(grids.ring_centroid(F.col("ring")).alias("c")).agg(F.avg("c.lon").alias("x"), F.avg("c.lat").alias("y")).first()
    assert c["x"] == pytest.approx(10, abs=0.2) and c["y"] == pytest.approx(45, abs=0.2)


def test_vertical(spark):
    df = spark.createDataFrame([(0, [float(k * k) for k in range(11)]), (1, None)], "id long, vals array<double>")
    lev = [float(k) for k in range(11)]
    for tension in (0.0, 2.0):
        out = vertical.VerticalRegridder(lev, [0.0, 2.0, 10.0], tension).transform(df).collect()
        assert out[0]["vals"] == pytest.approx([0, 4, 100]) and out[1]["vals"] is None
    down = df.where("id = 0").select(vertical.interpolate(F.reverse("vals"), lev[::-1], [3.0]).alias("v")).first()
    assert down["v"] == pytest.approx([9])
    with pytest.raises(ValueError):
        vertical.VerticalRegridder([1.0], [1.0])
    own = spark.createDataFrame([(0, [3.0, 2.0, 1.0], [9.0, 4.0, 1.0])], "col_id long, levels array<double>, vals array<double>")
    assert vertical.interpolate_own(own, [2.0]).first()["vals"] == pytest.approx([4])


def test_esmf_and_store(spark, tmp_path):
    w = weights.bilinear_rect(spark, Regular(4, 2, 0, 0, 10, 10), Regular(2, 1, 0, 0, 20, 20))
    fieldstore.write_esmf(w, str(tmp_path / "w"), 8, 2)
    back, na, nb = fieldstore.read_esmf(spark, str(tmp_path / "w"))
    assert (na, nb) == (8, 2) and back.exceptAll(w).count() == 0
    fieldstore.write_esmf_file(w, str(tmp_path / "w.nc"), 8, 2)
    back, na, nb = fieldstore.read_esmf_file(spark, str(tmp_path / "w.nc"))
    assert (na, nb) == (8, 2) and back.exceptAll(w).count() == w.exceptAll(back).count() == 0
    fieldstore.write_esmf_file(w.limit(0), str(tmp_path / "none.nc"), 8, 2)
    assert fieldstore.read_esmf_file(spark, str(tmp_path / "none.nc"))[0].count() == 0
    ds = fieldstore.open_dataset(spark, {"backend": "parquet", "path": str(tmp_path / "d")})
    f = spark.range(24).select((F.expr("id div 6")).alias("i0"), (F.col("id") % 6).alias("i1"), F.col("id").cast("double").alias("value"))
    ds.write("t", 0, f, (4, 6), attributes={"units": "1", "scale": "2.5"})
    ds.write("t", 1, f.withColumn("value", F.col("value") + 100), (4, 6))
    assert ds.describe("t") == {"dtype": "double", "shape": [4, 6], "timesteps": 2}
    assert ds.attribute_text("t", "units") == "1" and ds.attribute_double("t", "scale") == 2.5
    got = ds.read("t", 1, fieldstore.Box((1, 0), (2, 3), (2, 2)))
    assert sorted(r["value"] for r in got.collect()) == [106.0, 108.0, 110.0, 118.0, 120.0, 122.0]
    for box in (fieldstore.Box((0,), (1,)), fieldstore.Box((0, 0), (5, 1)), fieldstore.Box((0, 0), (1, 1), (0, 1))):
        with pytest.raises(fieldstore.InvalidInput):
            ds.read("t", 0, box)
    with pytest.raises(fieldstore.InvalidInput):
        ds.read("t", 2)
    with pytest.raises(fieldstore.InvalidInput):
        fieldstore.DatasetConfig.from_dict({"backend": "parquet", "path": "x", "codec": {"name": "jpeg"}})
    fieldstore.gmsh(grids.with_ring(grids.regular_cells(spark, Regular(2, 2, 0, 0, 1, 1))), str(tmp_path / "m.msh"))
    assert "$Elements\n4\n" in (tmp_path / "m.msh").read_text()


@pytest.mark.parametrize("method,norm", [("nearest", "fracarea"), ("bilinear", "fracarea"), ("conservative", "dstarea"), ("conservative", "fracarea")])
@pytest.mark.parametrize("pair", [0, 1, 2])
def test_stencils_agree_with_weight_tables(spark, method, norm, pair):
    a, b = [(Regular.world(36, 18), Regular.world(40, 25, 4.5)), (Regular.world(36, 18), Regular.world(18, 9)), (Regular(10, 8, 0, 0, 3, 3, False), Regular(6, 5, -2, 1, 4.5, 4.5, False))][pair]
    field = spark.range(a.ni * a.nj).where("id % 11 <> 3").select(F.col("id").alias("col"), (F.col("id") * F.col("id") % 97 / 7).alias("u"), (F.col("id") % 5).alias("v"))
    r = Regridder(Mesh.of_regular(a), Mesh.of_regular(b), method, norm).fit(spark)
    assert stencil.fits(a, b, method, 2)
    want = {x["row"]: (x["u"], x["v"]) for x in ap.apply(r.weights, field, r._rows).collect()}
    got = {x["row"]: (x["u"], x["v"]) for x in r.transform(field).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_axis_overlaps_uneven(spark):
    """Buckets lose no pair and count none twice, on axes whose widths differ a thousandfold."""
    edges = lambda e: [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(e, e[1:], strict=False))]
    src, dst = edges([0, 0.01, 0.02, 5, 5.5, 300, 360]), edges([-20, -19.99, 4, 6, 6.5, 200, 340])
    make = lambda r: spark.createDataFrame(r, "idx long, lo double, hi double")
    for period in (None, 360.0):
        shifts = [0.0] if period is None else [-360.0, 0.0, 360.0]
        want = sorted((d, s, round(min(b, y + k) - max(a, x + k), 9)) for d, a, b in dst for s, x, y in src for k in shifts if min(b, y + k) - max(a, x + k) > 1e-9)
        part = F.degrees("part") if period else F.col("part")
        got = weights.axis_overlaps(make(src), make(dst), period=period).select("di", "si", F.round(part, 9).alias("part")).collect()
        assert sorted(tuple(r) for r in got) == want


def test_positions_by_prefixes(spark):
    rows = [(a, b, c) for a in (2, 0, 1) for b in (1, 0) for c in range(a + b + 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {(r["a"], r["b"], r["c"]): r["pos"] for r in exchange.prefix_sum_positions(df, ["a", "b", "c"]).collect()}
    assert got == {r: k for k, r in enumerate(sorted(rows))}
