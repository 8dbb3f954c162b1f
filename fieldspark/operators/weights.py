"""Interpolation weight tables (row, col, w) as DataFrame plans.

Between regular grids every weight is index arithmetic: one narrow projection
over the destination cells, no join and no shuffle.  Rectilinear axes join
one axis at a time.  Everything else finds candidates by an equi-join on
space buckets, never by a comparison of all pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .grids import Regular, regular_cells, ring_area, xyz
from .neighbours import nearest_lists


def _idx(x: Column) -> Column:
    return F.floor(x).cast("long")


# ------------------------------------------------------------ regular grids


def nearest_rect(spark: SparkSession, src: Regular, dst: Regular) -> DataFrame:
    """Nearest source by rounding lower edges, longitude wrapped over the source's columns, latitude clamped; w = 1."""
    d = regular_cells(spark, dst)
    half_away = lambda x: F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")
    i = F.pmod(half_away((F.col("lon_lo") - src.lon0) / src.dlon), F.lit(src.ni))
    j = F.least(F.greatest(half_away((F.col("lat_lo") - src.lat0) / src.dlat), F.lit(0)), F.lit(src.nj - 1))
    return d.select(F.col("cell_id").alias("row"), (j * src.ni + i).alias("col"), F.lit(1.0).alias("w"))


def bilinear_rect(spark: SparkSession, src: Regular, dst: Regular) -> DataFrame:
    """Four weights around each destination center; beyond the source's outer edges unmapped (tolerance 1e-9).

    Between the outer edge and the outer centers the outer pair extrapolates
    flat.  On a periodic source the first half cell blends with the last column.
    """
    d = regular_cells(spark, dst)
    lon = F.col("clon")
    if src.periodic:
        lon = src.lon0 + F.pmod(lon - src.lon0, F.lit(360.0))
    tol = 1e-9
    d = d.withColumns({"fi": (lon - src.lon0) / src.dlon - 0.5, "fj": (F.col("clat") - src.lat0) / src.dlat - 0.5})
    d = d.where(F.col("fj").between(-0.5 - tol, src.nj - 0.5 + tol))
    if not src.periodic:
        d = d.where(F.col("fi").between(-0.5 - tol, src.ni - 0.5 + tol))
    clip = lambda x, hi: F.greatest(F.least(x, F.lit(hi)), F.lit(0))
    i0 = _idx(F.col("fi")) if src.periodic else clip(_idx(F.col("fi")), max(src.ni - 2, 0))
    d = d.withColumns({"i0": i0, "j0": clip(_idx(F.col("fj")), max(src.nj - 2, 0))})
    unit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    d = d.withColumns({"tx": unit(F.col("fi") - F.col("i0")), "ty": unit(F.col("fj") - F.col("j0"))})
    wrap = (lambda x: F.pmod(x, F.lit(src.ni))) if src.periodic else (lambda x: F.least(x, F.lit(src.ni - 1)))
    i0, i1, j0, j1 = wrap(F.col("i0")), wrap(F.col("i0") + 1), F.col("j0"), F.least(F.col("j0") + 1, F.lit(src.nj - 1))
    return _stencil(d, i0, i1, j0, j1, src.ni)


def _stencil(d: DataFrame, i0: Column, i1: Column, j0: Column, j1: Column, ni: int) -> DataFrame:
    tx, ty = F.col("tx"), F.col("ty")
    four = [(j0 * ni + i0, (1 - tx) * (1 - ty)), (j0 * ni + i1, tx * (1 - ty)), (j1 * ni + i0, (1 - tx) * ty), (j1 * ni + i1, tx * ty)]
    e = F.explode(F.array(*[F.struct(c.cast("long").alias("col"), w.alias("w")) for c, w in four]))
    return d.select(F.col("cell_id").alias("row"), e.alias("e")).select("row", "e.col", "e.w")


def conservative_rect(spark: SparkSession, src: Regular, dst: Regular, norm: str = "dstarea") -> DataFrame:
    """(row, col, w, overlap, area_a, area_b) of first-order conservative weights between regular grids.

    A destination cell's source index ranges follow from its edges, so its
    overlaps are exploded in place.  w = overlap / area_b, or with 'fracarea'
    divided by the covered share.
    """
    d = regular_cells(spark, dst)
    eps = 1e-12
    lo = lambda e, o, s: _idx((F.col(e) - o) / s + eps)
    hi = lambda e, o, s: F.ceil((F.col(e) - o) / s - eps).cast("long") - 1
    d = d.withColumns({"ia": lo("lon_lo", src.lon0, src.dlon), "ib": hi("lon_hi", src.lon0, src.dlon), "ja": lo("lat_lo", src.lat0, src.dlat), "jb": hi("lat_hi", src.lat0, src.dlat)})
    if not src.periodic:
        d = d.withColumns({"ia": F.greatest("ia", F.lit(0)), "ib": F.least("ib", F.lit(src.ni - 1))})
    d = d.withColumns({"ja": F.greatest("ja", F.lit(0)), "jb": F.least("jb", F.lit(src.nj - 1))}).where("ia <= ib and ja <= jb")
    d = d.withColumn("si", F.explode(F.sequence("ia", "ib"))).withColumn("sj", F.explode(F.sequence("ja", "jb")))
    x0, y0 = src.lon0 + F.col("si") * src.dlon, src.lat0 + F.col("sj") * src.dlat
    x1, y1 = src.lon0 + (F.col("si") + 1) * src.dlon, src.lat0 + (F.col("sj") + 1) * src.dlat
    height = (lambda a, b: F.sin(F.radians(b)) - F.sin(F.radians(a))) if src.spherical else (lambda a, b: b - a)
    width = (lambda a, b: F.radians(b - a)) if src.spherical else (lambda a, b: b - a)
    overlap = width(F.greatest("lon_lo", x0), F.least("lon_hi", x1)) * height(F.greatest("lat_lo", y0), F.least("lat_hi", y1))
    col = (F.col("sj") * src.ni + F.pmod(F.col("si"), F.lit(src.ni))).cast("long")
    out = d.select(F.col("cell_id").alias("row"), col.alias("col"), overlap.alias("overlap"), (width(x0, x1) * height(y0, y1)).alias("area_a"), F.col("area").alias("area_b")).where("overlap > 0")
    return _normalized(out, norm)


def _normalized(overlaps: DataFrame, norm: str) -> DataFrame:
    if norm == "dstarea":
        return overlaps.select("row", "col", (F.col("overlap") / F.col("area_b")).alias("w"), "overlap", "area_a", "area_b")
    if norm == "fracarea":
        total = F.sum("overlap").over(Window.partitionBy("row"))
        return overlaps.select("row", "col", (F.col("overlap") / total).alias("w"), "overlap", "area_a", "area_b")
    raise ValueError(f"unknown norm {norm}")


# ------------------------------------------------------------ rectilinear grids


def bilinear_nonuniform(src_lons: DataFrame, src_lats: DataFrame, dst: DataFrame, ni: int) -> DataFrame:
    """Bilinear weights on uneven axes (idx, center); dst (cell_id, clon, clat).  Clamped, no periodic wrap, never unmapped.

    An axis is a short sorted list, so it travels as one array and each cell
    counts the centers at or below it.
    """

    def axis(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "center"))), lambda s: s.center).alias(name))

    d = dst.crossJoin(F.broadcast(axis(src_lons, "xs"))).crossJoin(F.broadcast(axis(src_lats, "ys")))
    below = lambda a, v: F.size(F.filter(a, lambda c: c <= F.col(v))) - 1
    left = lambda a, v: F.greatest(F.least(below(a, v), F.size(a) - 2), F.lit(0))
    d = d.withColumns({"i0": left("xs", "clon"), "j0": left("ys", "clat")})
    at = lambda a, k: F.get(a, k)
    frac = lambda a, k, v: F.coalesce(F.greatest(F.least((F.col(v) - at(a, F.col(k))) / (at(a, F.col(k) + 1) - at(a, F.col(k))), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    d = d.withColumns({"tx": frac("xs", "i0", "clon"), "ty": frac("ys", "j0", "clat")})
    i1, j1 = F.least(F.col("i0") + 1, F.size("xs") - 1), F.least(F.col("j0") + 1, F.size("ys") - 1)
    return _stencil(d, F.col("i0"), i1, F.col("j0"), j1, ni)


def axis_overlaps(src: DataFrame, dst: DataFrame, spherical_lat: bool = False, period: float | None = None) -> DataFrame:
    """(di, si, part): overlap of intervals (idx, lo, hi) of two axes of one dimension; with ``period`` the source repeats around.

    Intervals meet by equality in buckets of their mean width, of which all
    together touch about twice as many as there are intervals, however uneven
    the axes; a pair counts in the bucket where its overlap begins.
    """
    s = src.select(F.col("idx").alias("si"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    if period:
        s = s.withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("si", (F.col("slo") + F.col("k") * period).alias("slo"), (F.col("shi") + F.col("k") * period).alias("shi"))
    d = dst.select(F.col("idx").alias("di"), "lo", "hi")
    mean = d.select("lo", "hi").unionByName(s.select(F.col("slo").alias("lo"), F.col("shi").alias("hi"))).agg(F.avg(F.abs(F.col("hi") - F.col("lo")))).first()[0]
    bucket = lambda c: F.floor(c / (mean or 1.0))
    touched = lambda lo, hi: F.explode(F.sequence(bucket(F.col(lo)), F.greatest(bucket(F.col(lo)), bucket(F.col(hi))))).alias("k")
    j = d.select("*", touched("lo", "hi")).join(s.select("*", touched("slo", "shi")), "k")
    j = j.where((F.col("slo") < F.col("hi")) & (F.col("shi") > F.col("lo")) & (F.col("k") == bucket(F.greatest("lo", "slo"))))
    a, b = F.greatest("lo", "slo"), F.least("hi", "shi")
    part = F.sin(F.radians(b)) - F.sin(F.radians(a)) if spherical_lat else F.radians(b - a) if period else b - a
    return j.select("di", "si", part.alias("part")).where("part > 1e-12")


def conservative_nonuniform(dst: DataFrame, lon: DataFrame, lat: DataFrame, ni_src: int, norm: str = "dstarea") -> DataFrame:
    """Weights from axis overlaps: dst (cell_id, i, j, area) joins the longitude and the latitude overlaps of its indices."""
    j = dst.join(lon.select(F.col("di").alias("i"), F.col("si"), F.col("part").alias("px")), "i").join(lat.select(F.col("di").alias("j"), F.col("si").alias("sj"), F.col("part").alias("py")), "j")
    o = j.select(F.col("cell_id").alias("row"), (F.col("sj") * ni_src + F.col("si")).cast("long").alias("col"), (F.col("px") * F.col("py")).alias("overlap"), F.lit(None).cast("double").alias("area_a"), F.col("area").alias("area_b"))
    return _normalized(o.groupBy("row", "col").agg(F.sum("overlap").alias("overlap"), F.first("area_a").alias("area_a"), F.first("area_b").alias("area_b")), norm)


# ------------------------------------------------------------ nearest neighbours


def knn(dst: DataFrame, src: DataFrame, k: int = 1, spherical: bool = True, digits: int | None = None) -> DataFrame:
    """(row, col, d2, rank): the k nearest sources of each destination, ties to the smaller col.

    With ``digits``, squared distances tie where they are equal rounded to so
    many: sources at equal distances by symmetry differ in the last bits.

    dst (row, lon, lat), src (col, lon, lat), compared leaf by leaf of a tree
    over the sources (``neighbours``).  Points with a null or non-finite
    coordinate have no neighbours and are nobody's.
    """
    lists = nearest_lists(dst, src, k, spherical, digits)
    return lists.select("row", F.posexplode("n").alias("rank", "m")).select("row", "m.col", "m.d2", (F.col("rank") + 1).alias("rank"))


def nearest(dst: DataFrame, src: DataFrame, spherical: bool = True) -> DataFrame:
    """(row, col, w = 1) by chord distance on the sphere or plane distance; ties to the smaller col."""
    return knn(dst, src, 1, spherical).select("row", "col", F.lit(1.0).alias("w"))


def extrapolate_nearest(weights: DataFrame, dst: DataFrame, src: DataFrame) -> DataFrame:
    """Adds, for destinations without weights, their nearest unmasked source in plain lon/lat."""
    bare = dst.join(weights.select("row").distinct(), "row", "left_anti")
    wet = src.where("mask <> 0") if "mask" in src.columns else src
    return weights.select("row", "col", "w").unionByName(nearest(bare, wet, spherical=False))


def coastal(weights: DataFrame, dst: DataFrame, src: DataFrame) -> DataFrame:
    """Masked sources dropped, partial rows scaled to 1, rows left bare filled by their nearest wet source."""
    from .apply import wet_renormalize

    return extrapolate_nearest(wet_renormalize(weights, src.select("col", "mask")), dst, src)


# ------------------------------------------------------------ local fits


def _neighbours(dst: DataFrame, src: DataFrame, k: int) -> DataFrame:
    """(row, lon, lat, n): each destination with its k nearest sources in lon/lat, nearest first."""
    return dst.select("row", "lon", "lat").join(nearest_lists(dst, src, k, spherical=False), "row")


def _local(dst: DataFrame, src: DataFrame, k: int, solve) -> DataFrame:
    """Weights from ``solve(point, neighbour points, squared distances) -> (indices, weights)`` a destination."""

    def run(batches):
        for b in batches:
            rows: list[tuple[int, int, float]] = []
            for r in b.itertuples(index=False):
                p = np.array([(x["x"], x["y"]) for x in r.n])
                d2 = np.array([x["d2"] for x in r.n])
                which, w = solve(np.array([r.lon, r.lat]), p, d2)
                rows += [(r.row, r.n[i]["col"], float(v)) for i, v in zip(which, w, strict=True)]
            yield pd.DataFrame(rows, columns=["row", "col", "w"])

    return _neighbours(dst, src, k).mapInPandas(run, "row long, col long, w double")


def _idw(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(d2))
    return np.arange(k), geo.inverse_distance(d2[:k])


def _bilinear(x: np.ndarray, p: np.ndarray, d2: np.ndarray):
    for q in itertools.combinations(range(len(p)), 4):
        pts = p[list(q)]
        order = np.argsort(np.arctan2(*(pts - pts.mean(0)).T[::-1]))
        w = geo.inverse_bilinear(pts[order], x)
        if w is not None:
            return np.array(q)[order], w
    for q in itertools.combinations(range(len(p)), 3):
        w = geo.barycentric(p[list(q)], x)
        if w is not None:
            return q, w
    return _idw(d2, 4)


def bilinear(dst: DataFrame, src: DataFrame) -> DataFrame:
    """General bilinear: among the 8 nearest centers the first quad, else the first triangle, that holds the point, else 4-point inverse distance."""
    return _local(dst, src, 8, _bilinear)


def _fitted(dst: DataFrame, src: DataFrame, k: int, solve) -> DataFrame:
    """Weights from ``solve(neighbour points (n, m, 2) as offsets, squared distances (n, m)) -> weights (n, m)`` of many destinations at once; NaN is no weight."""

    def run(batches):
        for b in batches:
            n = np.array([len(x) for x in b["n"]])
            for m in np.unique(n):  # differs from k only where there are fewer sources
                part = b[n == m]
                p, d2, col = (np.array([[x[c] for x in r] for r in part["n"]]) for c in ("x", "d2", "col"))
                r = np.stack([p - part["lon"].to_numpy(float)[:, None], np.array([[x["y"] for x in r] for r in part["n"]]) - part["lat"].to_numpy(float)[:, None]], 2)
                w = np.concatenate([solve(r[s : s + 1024], d2[s : s + 1024]) for s in range(0, len(part), 1024)])
                i, j = np.nonzero(~np.isnan(w))
                yield pd.DataFrame({"row": part["row"].to_numpy()[i], "col": col[i, j], "w": w[i, j]})

    return _neighbours(dst, src, k).mapInPandas(run, "row long, col long, w double")


def _powers(r: np.ndarray, powers: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([r[..., 0] ** a * r[..., 1] ** b for a, b in powers], -1)


def _distances(w: np.ndarray, d2: np.ndarray, rows: np.ndarray, k: int) -> None:
    """Inverse distance over the k nearest in the given rows."""
    for i in rows:
        near, v = _idw(d2[i], k)
        w[i, near] = v


def _polynomial(r: np.ndarray, powers: list[tuple[int, int]]) -> np.ndarray:
    """Weights (n, m) that reproduce the powers at offset 0, from the square system or else by least norm; NaN rows where none do."""
    scale = np.abs(r).max((1, 2))
    v = _powers(r / np.where(scale > 0, scale, 1.0)[:, None, None], powers).swapaxes(1, 2)
    n, terms, m = v.shape
    w = np.full((n, m), np.nan)
    if m < terms:
        return w
    e = np.eye(terms)[0]
    good = np.linalg.cond(v) < 1e10 if m == terms else np.zeros(n, bool)
    if good.any():
        w[good] = np.linalg.solve(v[good], np.broadcast_to(e[:, None], (good.sum(), terms, 1)))[..., 0]
    rest = np.flatnonzero(~good)
    least = np.linalg.pinv(v[rest], rcond=np.finfo(float).eps * m)[..., 0]
    exact = np.abs((v[rest] @ least[..., None])[..., 0] - e).max(1) <= 1e-6
    w[rest[exact]] = least[exact]
    w[~np.isfinite(w).all(1)] = np.nan
    return w


def bicubic(dst: DataFrame, src: DataFrame) -> DataFrame:
    """16 nearest centers; weights that reproduce x^i y^j, i, j <= 3 exactly, else i, j <= 2, else inverse distance."""

    def solve(r, d2):
        w = _polynomial(r, [(a, b) for a in range(4) for b in range(4)])
        rest = np.flatnonzero(np.isnan(w).all(1))
        w[rest] = _polynomial(r[rest], [(a, b) for a in range(3) for b in range(3)])
        _distances(w, d2, rest[np.isnan(w[rest]).all(1)], 4)
        return w

    return _fitted(dst, src, 16, solve)


def patch(dst: DataFrame, src: DataFrame) -> DataFrame:
    """16 nearest centers; w = A (A'A)^-1 e for the basis 1, x, y, xy, x2, y2, else inverse distance over all."""
    powers = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)]

    def solve(r, d2):
        n, m = d2.shape
        a, w = _powers(r, powers), np.full((n, m), np.nan)
        good = np.linalg.matrix_rank(a) >= 6 if m >= 6 else np.zeros(n, bool)
        a = a[good]
        w[good] = (a @ np.linalg.inv(a.swapaxes(1, 2) @ a)[..., :1])[..., 0]
        _distances(w, d2, np.flatnonzero(~good), m)
        return w

    return _fitted(dst, src, 16, solve)


# ------------------------------------------------------------ polygon overlap


def _boxed(mesh: DataFrame, key: str, side: float, spherical: bool) -> DataFrame:
    """A row for each bucket that a cell's bounding box (3-D on the sphere, so no dateline) touches."""
    v = F.transform("ring", lambda p: xyz(p.lon, p.lat)) if spherical else F.transform("ring", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    axes = "xyz" if spherical else "xy"
    m = mesh.select(key, "ring", v.alias("v"))
    # An arc bulges beyond its ends; by at most half the squared chord.
    pad = F.lit(0.0)
    if spherical:
        n = F.size("v")
        sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("v", i).alias("a"), F.element_at("v", (i % n + 1).cast("int")).alias("b")))
        pad = F.array_max(F.transform(sides, lambda e: _chord2(e.a, e.b))) / 2
    m = m.withColumn("pad", pad)
    for c in axes:
        vals = F.col(f"v.{c}")
        m = m.withColumn(f"lo{c}", F.array_min(vals) - F.col("pad")).withColumn(f"hi{c}", F.array_max(vals) + F.col("pad"))
    for c in axes:
        m = m.withColumn(f"k{c}", F.explode(F.sequence(F.floor(F.col(f"lo{c}") / side), F.floor(F.col(f"hi{c}") / side))))
    return m.drop("v", "pad")


def _chord2(a: Column, b: Column) -> Column:
    return (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2


def conservative(src: DataFrame, dst: DataFrame, norm: str = "dstarea", spherical: bool = True) -> DataFrame:
    """(row, col, w, overlap, area_a, area_b) between meshes of convex cells: src (col, ring), dst (row, ring).

    Candidates share a bucket and meet in all axes of their bounding boxes; a
    pair that shares several buckets is kept in the least of them.  Clipping
    runs over Arrow batches of candidate pairs.  Cells with fewer than three
    distinct vertices or no area are left out, as are cells with mask 0 where
    a mask column is given.
    """
    axes = "xyz" if spherical else "xy"
    clean = lambda m, key: (m.where("mask <> 0") if "mask" in m.columns else m).where("size(array_distinct(ring)) >= 3").withColumn("area", ring_area(F.col("ring"), spherical)).where("area > 1e-25").select(key, "ring", "area")
    s, d = clean(src, "col"), clean(dst, "row")
    size = s.agg(F.avg("area").alias("a"), F.count("*").alias("n")).first()
    size_d = d.agg(F.avg("area").alias("a")).first()
    side = max(size["a"] or 0.0, size_d["a"] or 0.0) ** 0.5 * 2 or 1.0
    bs = _boxed(s, "col", side, spherical).withColumnRenamed("ring", "sring")
    bd = _boxed(d, "row", side, spherical).withColumnRenamed("ring", "dring")
    ren = {f"{p}{c}": f"s{p}{c}" for c in axes for p in ("lo", "hi")}
    bs = bs.withColumnsRenamed(ren)
    meet = bd.join(bs, [f"k{c}" for c in axes])
    for c in axes:
        meet = meet.where((F.col(f"lo{c}") <= F.col(f"shi{c}")) & (F.col(f"slo{c}") <= F.col(f"hi{c}")))
        meet = meet.where(F.col(f"k{c}") == F.floor(F.greatest(f"lo{c}", f"slo{c}") / side))
    pairs = meet.select("row", "col", "dring", "sring")

    def clip(batches):
        for b in batches:
            if not len(b):
                continue
            rings = []
            for name in ("dring", "sring"):
                v = max(map(len, b[name]))
                xy = np.array([[(p["lon"], p["lat"]) for p in r] + [(r[-1]["lon"], r[-1]["lat"])] * (v - len(r)) for r in b[name]])
                rings.append(geo.to_xyz(xy[..., 0], xy[..., 1]) if spherical else xy)
            out = np.concatenate([(geo.overlap if spherical else geo.planar_overlap)(rings[0][k : k + 512], rings[1][k : k + 512]) for k in range(0, len(b), 512)])
            hit = out > 1e-15
            yield pd.DataFrame({"row": b["row"][hit], "col": b["col"][hit], "overlap": out[hit]})

    o = pairs.mapInPandas(clip, "row long, col long, overlap double")
    o = o.join(s.select("col", F.col("area").alias("area_a")), "col").join(d.select("row", F.col("area").alias("area_b")), "row")
    return _normalized(o, norm)


def adjacency(mesh: DataFrame, key: str = "cell_id") -> DataFrame:
    """(cell, neighbour): cells that share two vertices or more."""
    v = mesh.select(F.col(key).alias("cell"), F.explode(F.transform("ring", lambda p: F.struct(F.round(p.lon % 360, 9).alias("x"), F.round(p.lat, 9).alias("y")))).alias("v"))
    j = v.join(v.select(F.col("cell").alias("neighbour"), "v"), "v").where("cell <> neighbour")
    return j.groupBy("cell", "neighbour").agg(F.count("*").alias("n")).where("n >= 2").select("cell", "neighbour")


def gradient(cells: DataFrame, neighbours: DataFrame, limit: bool = False) -> DataFrame:
    """(cell, gx, gy, gz): least-squares gradient from neighbours; 0 under 3 of them or where the system is singular.

    cells (cell, x, y, z, value).  Normal equations are nine sums a cell,
    solved by Cramer's rule.  ``limit`` scales by the Barth-Jespersen factor
    so that no neighbour's value range is exceeded.
    """
    far = cells.select(F.col("cell").alias("neighbour"), *[F.col(c).alias(f"n{c}") for c in ("x", "y", "z", "value")])
    j = neighbours.join(cells, "cell").join(far, "neighbour")
    d = {c: F.col(f"n{c}") - F.col(c) for c in "xyz"}
    dv = F.col("nvalue") - F.col("value")
    sums = {a + b: F.sum(d[a] * d[b]) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")} | {f"b{c}": F.sum(d[c] * dv) for c in "xyz"}
    s = j.groupBy("cell").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    a, b, c, e, f, i = (F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    det = a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)
    r = [F.col(f"b{k}") for k in "xyz"]
    nx = r[0] * (e * i - f * f) - b * (r[1] * i - f * r[2]) + c * (r[1] * f - e * r[2])
    ny = a * (r[1] * i - f * r[2]) - r[0] * (b * i - f * c) + c * (b * r[2] - r[1] * c)
    nz = a * (e * r[2] - r[1] * f) - b * (b * r[2] - r[1] * c) + r[0] * (b * f - e * c)
    ok = (F.col("n") >= 3) & (F.abs(det) >= 1e-30)
    g = s.select("cell", *[F.when(ok, v / det).otherwise(0.0).alias(k) for k, v in (("gx", nx), ("gy", ny), ("gz", nz))])
    g = cells.select("cell").join(g, "cell", "left").select("cell", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("gx", "gy", "gz")])
    if not limit:
        return g
    j = j.join(g, "cell")
    ranges = j.groupBy("cell", "value").agg(F.max("nvalue").alias("hi"), F.min("nvalue").alias("lo")).select("cell", F.greatest("hi", "value").alias("hi"), F.least("lo", "value").alias("lo"))
    step = d["x"] * F.col("gx") + d["y"] * F.col("gy") + d["z"] * F.col("gz")
    p = j.join(ranges, "cell").withColumn("step", step)
    phi = F.when(F.col("step") > 1e-15, (F.col("hi") - F.col("value")) / F.col("step")).when(F.col("step") < -1e-15, (F.col("lo") - F.col("value")) / F.col("step")).otherwise(1.0)
    phi = p.groupBy("cell").agg(F.greatest(F.least(F.min(phi), F.lit(1.0)), F.lit(0.0)).alias("phi"))
    return g.join(phi, "cell", "left").select("cell", *[(F.col(k) * F.coalesce("phi", F.lit(1.0))).alias(k) for k in ("gx", "gy", "gz")])


def gradient_corrected(first: DataFrame, src_cells: DataFrame, neighbours: DataFrame, dst_points: DataFrame) -> DataFrame:
    """First-order weights times 1 + the offset along the gradients of the coordinate fields, not below 0, rows' sums kept.

    src_cells (cell, x, y, z); dst_points (row, x, y, z).
    """
    g = None
    for c in "xyz":
        one = gradient(src_cells.withColumn("value", F.col(c)), neighbours, limit=True).select(F.col("cell").alias("col"), F.col(f"g{c}").alias(f"h{c}"))
        g = one if g is None else g.join(one, "col")
    s = src_cells.select(F.col("cell").alias("col"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    j = first.join(s, "col").join(g, "col").join(dst_points, "row")
    off = sum(((F.col(c) - F.col(f"s{c}")) * F.col(f"h{c}") for c in "xyz"), F.lit(0.0))
    j = j.withColumn("c", F.col("w") * F.greatest(F.lit(1.0) + off, F.lit(0.0)))
    t = j.groupBy("row").agg(F.sum("w").alias("tw"), F.sum("c").alias("tc"))
    return j.join(t, "row").select("row", "col", F.when(F.col("tc") > 0, F.col("c") * F.col("tw") / F.col("tc")).otherwise(F.col("w")).alias("w"))


def vector_weights(weights: DataFrame, src_alpha: DataFrame, dst_alpha: DataFrame, n_src: int) -> tuple[DataFrame, DataFrame]:
    """(W_u, W_v) over stacked components (u at col, v at col + n_src), rotated by alpha_dst - alpha_src (radians)."""
    j = weights.join(src_alpha.select("col", F.col("alpha").alias("a")), "col").join(dst_alpha.select("row", F.col("alpha").alias("b")), "row")
    j = j.withColumns({"c": F.cos(F.col("b") - F.col("a")), "s": F.sin(F.col("b") - F.col("a"))})

    def part(first: Column, second: Column) -> DataFrame:
        e = F.explode(F.array(F.struct(F.col("col").alias("col"), (F.col("w") * first).alias("w")), F.struct((F.col("col") + n_src).alias("col"), (F.col("w") * second).alias("w"))))
        return j.select("row", e.alias("e")).select("row", "e.col", "e.w")

    return part(F.col("c"), F.col("s")), part(-F.col("s"), F.col("c"))


def cap_filter(pairs: DataFrame) -> DataFrame:
    """Pairs (ax, ay, az, ar, bx, by, bz, br) whose bounding caps meet: angle <= ar + br."""
    dot = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in "xyz"), F.lit(0.0))
    return pairs.where(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))) <= F.col("ar") + F.col("br"))


def cap_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of caps (ax, ay, az, ar, ...) and (bx, by, bz, br, ...) that meet.

    Centers of meeting caps are within the chord of the largest radii, so they
    lie in the same or in touching cubes of that side: an equi-join on cubes.
    """
    widest = (a.agg(F.max("ar")).first()[0] or 0.0) + (b.agg(F.max("br")).first()[0] or 0.0)
    side = max(2 * math.sin(min(widest, math.pi) / 2), 1e-9) * (1 + 1e-9)
    cube = lambda p, o=(0, 0, 0): F.struct(*[(F.floor(F.col(p + c) / side) + F.lit(k)).cast("long").alias(c) for c, k in zip("xyz", o, strict=True)])
    around = F.explode(F.array(*[cube("b", o) for o in itertools.product((-1, 0, 1), repeat=3)]))
    met = a.withColumn("_cube", cube("a")).join(b.withColumn("_cube", around), "_cube").drop("_cube")
    return cap_filter(met)


def longitudes_disjoint(src: DataFrame, dst: DataFrame) -> None:
    """Raises where the grids' longitude ranges are disjoint but would meet after a shift by 360."""
    a, b = (d.agg(F.min("lon").alias("lo"), F.max("lon").alias("hi")).first() for d in (src, dst))
    if a["lo"] is None or b["lo"] is None:
        return
    meets = lambda k: a["lo"] <= b["hi"] + k and b["lo"] + k <= a["hi"]
    if not meets(0) and (meets(360) or meets(-360)):
        raise ValueError("longitude conventions differ: shift one grid by 360 degrees")


def morton(x: Column, y: Column) -> Column:
    """Interleaves two 16-bit integers, x on the even bits."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for s, m in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, s)).bitwiseAND(F.lit(m).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def morton_sort(points: DataFrame) -> DataFrame:
    """Points (lon, lat, ...) with column morton, range-partitioned and sorted by it."""
    b = points.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("lon", "lat") for f in (F.min, F.max)]).first()
    scale = lambda c: F.floor((F.col(c) - b[f"min{c}"]) / ((b[f"max{c}"] - b[f"min{c}"]) or 1.0) * 65535).cast("long")
    out = points.withColumn("morton", morton(scale("lon"), scale("lat")))
    return out.repartitionByRange("morton").sortWithinPartitions("morton")
