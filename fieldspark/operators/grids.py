"""Grids and meshes generated as DataFrames.

A regular grid is a formula over ``spark.range``: no cell list passes through
the driver.  cells: (cell_id, i, j, lon_lo, lon_hi, lat_lo, lat_hi, clon,
clat, area); cell_id = j * ni + i, carried with (i, j) so that no later step
guesses the order.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING = "array<struct<lon: double, lat: double>>"


@dataclass(frozen=True)
class Regular:
    """A regular grid by its lower corner, spacing and size; degrees on the sphere or plane units."""

    ni: int
    nj: int
    lon0: float
    lat0: float
    dlon: float
    dlat: float
    spherical: bool = True

    @classmethod
    def world(cls, ni: int, nj: int, lon0: float = 0.0) -> Regular:
        return cls(ni, nj, lon0, -90.0, 360.0 / ni, 180.0 / nj)

    @property
    def periodic(self) -> bool:
        return self.spherical and abs(self.ni * self.dlon - 360) < 1e-9


def _area(g_spherical: bool, lon_lo: Column, lon_hi: Column, lat_lo: Column, lat_hi: Column) -> Column:
    if g_spherical:
        return F.radians(lon_hi - lon_lo) * (F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))
    return (lon_hi - lon_lo) * (lat_hi - lat_lo)


def regular_cells(spark: SparkSession, g: Regular) -> DataFrame:
    i, j = F.col("cell_id") % g.ni, F.expr(f"cell_id div {g.ni}")
    df = spark.range(g.ni * g.nj).select(F.col("id").alias("cell_id")).withColumns({"i": i, "j": j})
    df = df.withColumns({"lon_lo": g.lon0 + F.col("i") * g.dlon, "lat_lo": g.lat0 + F.col("j") * g.dlat})
    df = df.withColumns({"lon_hi": g.lon0 + (F.col("i") + 1) * g.dlon, "lat_hi": g.lat0 + (F.col("j") + 1) * g.dlat})
    return df.withColumns(
        {
            "clon": g.lon0 + (F.col("i") + 0.5) * g.dlon,
            "clat": g.lat0 + (F.col("j") + 0.5) * g.dlat,
            "area": _area(g.spherical, F.col("lon_lo"), F.col("lon_hi"), F.col("lat_lo"), F.col("lat_hi")),
        }
    )


def with_ring(cells: DataFrame) -> DataFrame:
    """Adds the counter-clockwise corner ring BL, BR, TR, TL."""
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return cells.withColumn("ring", F.array(p("lon_lo", "lat_lo"), p("lon_hi", "lat_lo"), p("lon_hi", "lat_hi"), p("lon_lo", "lat_hi")))


def cell_edges(centers: DataFrame, clamp: bool = False) -> DataFrame:
    """(idx, center, lo, hi): edges midway between ordered centers, half a cell beyond the outer ones.

    A single center gets half a unit each way.  The centers of one axis are a
    short list, so one window over them is the whole cost.
    """
    w = Window.orderBy("idx")
    c, before, after = F.col("center"), F.lag("center").over(w), F.lead("center").over(w)
    gap = F.coalesce(after - c, c - before, F.lit(1.0))
    lo = F.when(before.isNull(), c - gap / 2).otherwise((before + c) / 2)
    hi = F.when(after.isNull(), c + F.coalesce(c - before, F.lit(1.0)) / 2).otherwise((c + after) / 2)
    if clamp:
        lo, hi = (F.greatest(F.least(x, F.lit(90.0)), F.lit(-90.0)) for x in (lo, hi))
    return centers.select("idx", "center", lo.alias("lo"), hi.alias("hi"))


def rectilinear_cells(lons: DataFrame, lats: DataFrame, spherical: bool = True) -> DataFrame:
    """Cells of two axes (idx, center, lo, hi); the product is the grid itself."""
    x = lons.select(F.col("idx").alias("i"), F.col("center").alias("clon"), F.col("lo").alias("lon_lo"), F.col("hi").alias("lon_hi"))
    y = lats.select(F.col("idx").alias("j"), F.col("center").alias("clat"), F.col("lo").alias("lat_lo"), F.col("hi").alias("lat_hi"))
    ni = lons.count()
    df = y.crossJoin(x).withColumn("cell_id", (F.col("j") * ni + F.col("i")).cast("long"))
    return df.withColumn("area", _area(spherical, F.col("lon_lo"), F.col("lon_hi"), F.col("lat_lo"), F.col("lat_hi")))


def curvilinear_corners(centers: DataFrame, ni: int, nj: int, periodic: bool = False, rows: tuple[int, int] | None = None) -> DataFrame:
    """Corner (i, j), 0..ni by 0..nj, as the mean of its four edge-padded neighbouring centers (i, j, lon, lat).

    With ``periodic`` the i axis wraps and longitudes are taken on the side of
    the first neighbour.  ``rows`` keeps a band of corner rows, with identical
    values.
    """
    wrap = lambda k: F.pmod(k, F.lit(ni)) if periodic else F.greatest(F.least(k, F.lit(ni - 1)), F.lit(0))
    clamp = lambda k: F.greatest(F.least(k, F.lit(nj - 1)), F.lit(0))
    spark = centers.sparkSession
    width = ni + 1
    corner = spark.range(width * (nj + 1)).select((F.col("id") % width).alias("ci"), F.expr(f"id div {width}").alias("cj"))
    if rows:
        corner = corner.where(F.col("cj").between(*rows))
    near = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), wrap(F.col("ci") - a).alias("i"), clamp(F.col("cj") - b).alias("j")) for k, (a, b) in enumerate(((1, 1), (0, 1), (1, 0), (0, 0)))]))
    four = corner.withColumn("n", near).select("ci", "cj", "n.k", "n.i", "n.j").join(centers.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "lon", "lat"), ["i", "j"])
    got = four.groupBy("ci", "cj").agg(F.min_by("lon", "k").alias("base"), F.collect_list("lon").alias("lons"), F.avg("lat").alias("lat"))
    lon = F.aggregate("lons", F.lit(0.0), lambda s, x: s + (x - F.round((x - F.col("base")) / 360) * 360 if periodic else x)) / 4
    return got.select(F.col("ci").alias("i"), F.col("cj").alias("j"), lon.alias("lon"), "lat")


def clean_ring(ring: Column) -> Column:
    """A padded or closed vertex ring without repeats of the vertex before and without its closing duplicate; null under 3 vertices."""
    n = F.size(ring)
    distinct = F.filter(ring, lambda v, k: (k == 0) | (v != F.element_at(ring, k)))
    closed = (F.size(distinct) > 1) & (F.element_at(distinct, 1) == F.element_at(distinct, -1))
    out = F.when(closed, F.slice(distinct, 1, F.size(distinct) - 1)).otherwise(distinct)
    return F.when((n >= 3) & (F.size(out) >= 3), out)


def bounds_mesh(bounds: DataFrame, radians: bool = False) -> DataFrame:
    """mesh_cell (cell_id, ring) from vertex bounds (cell_id, lons array, lats array), padding removed."""
    unit = (lambda x: F.degrees(x)) if radians else (lambda x: x)
    ring = F.zip_with("lons", "lats", lambda a, b: F.struct(unit(a).alias("lon"), unit(b).alias("lat")))
    return bounds.select("cell_id", clean_ring(ring).alias("ring")).where("ring is not null")


def ugrid_mesh(nodes: DataFrame, faces: DataFrame, start_index: int = 0) -> DataFrame:
    """mesh_cell (cell_id, ring) of nodes (node_id, lon, lat) and faces (cell_id, nodes array with -1 or null padding)."""
    at = faces.select("cell_id", F.posexplode("nodes").alias("pos", "node")).where("node >= 0").withColumn("node_id", F.col("node") - start_index)
    j = at.join(nodes, "node_id").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("v"))
    return j.select("cell_id", F.transform("v", lambda x: F.struct(x.lon.alias("lon"), x.lat.alias("lat"))).alias("ring"))


def triangulate(mesh: DataFrame) -> DataFrame:
    """Fan triangles (cell_id, tri, ring) of polygons; longitudes in [0, 360)."""
    norm = F.transform("ring", lambda p: F.struct(normalize_lon(p.lon).alias("lon"), p.lat.alias("lat")))
    r = mesh.select("cell_id", norm.alias("r")).where("size(r) >= 3")
    k = F.posexplode(F.transform(F.sequence(F.lit(2), F.size("r") - 1), lambda i: F.array(F.element_at("r", 1), F.element_at("r", i.cast("int")), F.element_at("r", (i + 1).cast("int")))))
    return r.select("cell_id", k.alias("tri", "ring"))


def normalize_lon(lon: Column) -> Column:
    """Into [0, 360); NaN and infinities give 0."""
    bad = F.isnan(lon) | (F.abs(lon) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.pmod(lon, F.lit(360.0)))


# ------------------------------------------------------------ areas and centroids


def xyz(lon: Column, lat: Column) -> Column:
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z"))


def lonlat(x: Column, y: Column, z: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    return F.struct(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("lon"), F.degrees(F.asin(F.greatest(F.least(z / n, F.lit(1.0)), F.lit(-1.0)))).alias("lat"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ring_centroid(ring: Column, spherical: bool = True) -> Column:
    """Mean of the vertices' unit vectors as lon in [0, 360) and lat, or the plain mean on a plane."""
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + f(p)) / F.size(ring)
    if not spherical:
        return F.struct(mean(lambda p: p.lon).alias("lon"), mean(lambda p: p.lat).alias("lat"))
    v = F.transform(ring, lambda p: xyz(p.lon, p.lat))
    part = lambda c: F.aggregate(v.getField(c), F.lit(0.0), lambda s, x: s + x)
    return lonlat(*map(part, "xyz"))


def ring_area(ring: Column, spherical: bool = True) -> Column:
    """Fan from the first vertex: spherical excess by the half-angle formula of Van Oosterom and Strackee, or the shoelace sum."""
    tri = F.sequence(F.lit(2), F.size(ring) - 1)
    at = lambda i: F.element_at(ring, i.cast("int"))
    if not spherical:
        a = F.element_at(ring, 1)
        cross = lambda i: (at(i).lon - a.lon) * (at(i + 1).lat - a.lat) - (at(i + 1).lon - a.lon) * (at(i).lat - a.lat)
        return F.abs(F.aggregate(tri, F.lit(0.0), lambda s, i: s + cross(i)) / 2)
    dot = lambda p, q: p.x * q.x + p.y * q.y + p.z * q.z

    def excess(t: Column) -> Column:
        a, b, c = t.a, t.b, t.c
        triple = a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x)
        return 2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(c, a))

    def total(v: Column) -> Column:
        corners = F.transform(tri, lambda i: F.struct(F.element_at(v, 1).alias("a"), F.element_at(v, i.cast("int")).alias("b"), F.element_at(v, (i + 1).cast("int")).alias("c")))
        return F.abs(F.aggregate(F.transform(corners, excess), F.lit(0.0), lambda s, x: s + x))

    return let(F.transform(ring, lambda p: xyz(p.lon, p.lat)), total)


# ------------------------------------------------------------ named grids


def gaussian_latitudes(n: int) -> np.ndarray:
    """The 2n roots of the Legendre polynomial, as degrees from north to south."""
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(2 * n)[0]))[::-1]


def octahedral_nlon(n: int) -> list[int]:
    """Points a latitude ring: 20 + 4 * min(j, 2n-1-j)."""
    return [20 + 4 * min(j, 2 * n - 1 - j) for j in range(2 * n)]


def parse_name(name: str) -> tuple[str, int]:
    """('O' | 'N' | 'F' | 'R', number) of a named grid such as O48."""
    m = re.fullmatch(r"([ONFR])([1-9]\d*)", name)
    if not m:
        raise ValueError(f"unknown grid name {name!r}")
    return m[1], int(m[2])


def _rings(spark: SparkSession, counts: list[int], lats: np.ndarray) -> DataFrame:
    rows = [(j, int(c), float(y)) for j, (c, y) in enumerate(zip(counts, lats, strict=True))]
    return spark.createDataFrame(rows, "j int, nlon int, lat double")


def named_points(spark: SparkSession, name: str) -> DataFrame:
    """(node_id, j, i, lon, lat) of a named grid, ring by ring from north to south."""
    kind, n = parse_name(name)
    if kind == "R":
        return regular_cells(spark, named_regular(n)).select(F.col("cell_id").alias("node_id"), "j", "i", F.col("clon").alias("lon"), F.col("clat").alias("lat"))
    counts = [4 * n] * (2 * n) if kind == "F" else octahedral_nlon(n)
    rings = _rings(spark, counts, gaussian_latitudes(n))
    base = rings.withColumn("base", F.sum("nlon").over(Window.orderBy("j")) - F.col("nlon"))
    pts = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nlon") - 1)))
    return pts.select((F.col("base") + F.col("i")).cast("long").alias("node_id"), "j", "i", (F.col("i") * 360.0 / F.col("nlon")).alias("lon"), "lat")


def named_regular(n: int) -> Regular:
    ni, nj = 4 * n - 1, 2 * n - 1
    return Regular(ni, nj, -180.0, -90.0, 360.0 / ni, 180.0 / nj)


# Numbered global grids, as columns, rows and spacing in degrees from (-180, -90).
NUMBERED = {3: (360, 181, 1.0), 4: (720, 361, 0.5)}


def numbered_grid(name: str) -> Regular:
    """The regular grid of a name such as grid4; projected numbers without bounds are not known."""
    m = re.fullmatch(r"grid(\d+)", name)
    if not m or int(m[1]) not in NUMBERED:
        raise ValueError(f"unknown grid {name!r}")
    ni, nj, d = NUMBERED[int(m[1])]
    return Regular(ni, nj, -180.0, -90.0, d, d)


def crosses_dateline(ring: Column) -> Column:
    """Whether neighbouring vertices differ by more than 180 degrees of longitude."""
    n = F.size(ring)
    return F.exists(F.sequence(F.lit(1), n), lambda i: F.abs(F.element_at(ring, i).lon - F.element_at(ring, (i % n + 1).cast("int")).lon) > 180)


def unwrap(ring: Column) -> Column:
    """The ring with longitudes moved by 360 to the side of its first vertex."""
    base = F.element_at(ring, 1).lon
    return F.transform(ring, lambda p: F.struct((p.lon - F.round((p.lon - base) / 360) * 360).alias("lon"), p.lat.alias("lat")))


def gaussian_mesh(spark: SparkSession, name: str) -> DataFrame:
    """mesh_cell (cell_id, ring): quads between neighbouring rings; F has 4n a band, O and N as many as the longer ring has points.

    Quad k of a band joins points floor(k * n_ring / quads) and the next of
    each ring, so shorter rings repeat points in proportion.
    """
    kind, n = parse_name(name)
    pts = named_points(spark, name)
    counts = [4 * n] * (2 * n) if kind == "F" else octahedral_nlon(n)
    bands = [(j, max(counts[j], counts[j + 1]), counts[j], counts[j + 1]) for j in range(2 * n - 1)]
    b = spark.createDataFrame(bands, "j int, quads int, up int, down int")
    b = b.withColumn("base", F.sum("quads").over(Window.orderBy("j")) - F.col("quads")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("quads") - 1)))
    # Ring order: lower left, lower right, upper right, upper left; counter-clockwise seen from outside.
    pick = lambda dj, dk, size: F.struct((F.col("j") + dj).alias("j"), (F.expr(f"((k + {dk}) * {size}) div quads") % F.col(size)).cast("int").alias("i"))
    corners = F.posexplode(F.array(pick(1, 0, "down"), pick(1, 1, "down"), pick(0, 1, "up"), pick(0, 0, "up")))
    v = b.select((F.col("base") + F.col("k")).cast("long").alias("cell_id"), corners.alias("pos", "c")).select("cell_id", "pos", "c.j", "c.i")
    j = v.join(pts.select("j", "i", "lon", "lat"), ["j", "i"]).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("v"))
    return j.select("cell_id", F.transform("v", lambda x: F.struct(x.lon.alias("lon"), x.lat.alias("lat"))).alias("ring"))


def rule_mesh(spark: SparkSession, kind: str, **p) -> DataFrame:
    """Cells of a rule: regular_latlon(resolution[, bounds]), gaussian_regular(n), gaussian_reduced(n), projected(...)."""
    if kind == "regular_latlon":
        lon0, lat0, lon1, lat1 = p.get("bounds", (0.0, -90.0, 360.0, 90.0))
        r = p["resolution"]
        return regular_cells(spark, Regular(math.floor((lon1 - lon0) / r), math.floor((lat1 - lat0) / r), lon0, lat0, r, r))
    if kind in ("gaussian_regular", "gaussian_reduced"):
        n = p["n"]
        lats = gaussian_latitudes(n)
        edges = np.r_[90.0, (lats[1:] + lats[:-1]) / 2, -90.0]
        counts = [4 * n] * (2 * n) if kind == "gaussian_regular" else octahedral_nlon(n)
        rows = [(j, counts[j], float(edges[j + 1]), float(edges[j]), float(lats[j])) for j in range(2 * n)]
        b = spark.createDataFrame(rows, "j int, nlon int, lat_lo double, lat_hi double, clat double")
        b = b.withColumn("base", F.sum("nlon").over(Window.orderBy("j")) - F.col("nlon")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nlon") - 1)))
        d = 360.0 / F.col("nlon")
        b = b.withColumns({"cell_id": (F.col("base") + F.col("i")).cast("long"), "lon_lo": F.col("i") * d, "lon_hi": (F.col("i") + 1) * d, "clon": (F.col("i") + 0.5) * d})
        return b.withColumn("area", _area(True, F.col("lon_lo"), F.col("lon_hi"), F.col("lat_lo"), F.col("lat_hi"))).select("cell_id", "i", "j", "lon_lo", "lon_hi", "lat_lo", "lat_hi", "clon", "clat", "area")
    if kind == "projected":
        return projected_mesh(spark, **p)
    raise ValueError(f"unknown rule {kind!r}")


def lambert_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, radius: float = 6_371_229.0) -> Column:
    """(lon, lat) of Lambert conformal conic coordinates on a sphere."""
    f1, f2, f0 = map(math.radians, (lat1, lat2, lat0))
    t = lambda a: math.tan(math.pi / 4 + a / 2)
    n = math.sin(f1) if abs(lat1 - lat2) < 1e-9 else math.log(math.cos(f1) / math.cos(f2)) / math.log(t(f2) / t(f1))
    f = math.cos(f1) * t(f1) ** n / n
    rho0 = radius * f / t(f0) ** n
    rho = math.copysign(1, n) * F.sqrt(x * x + (rho0 - y) ** 2)
    s = math.copysign(1, n)
    theta = F.atan2(s * x, s * (rho0 - y))
    lat = F.degrees(2 * F.atan(F.pow(radius * f / rho, F.lit(1 / n)))) - 90
    return F.struct((F.degrees(theta) / n + lon0).alias("lon"), lat.alias("lat"))


def stereographic_inverse(x: Column, y: Column, lat_ts: float, lon0: float, north: bool = True, radius: float = 6_371_229.0) -> Column:
    """(lon, lat) of polar stereographic coordinates on a sphere, true at ``lat_ts``."""
    s = 1 if north else -1
    scale = radius * (1 + math.sin(math.radians(abs(lat_ts))))
    lat = s * (90 - F.degrees(2 * F.atan(F.sqrt(x * x + y * y) / scale)))
    return F.struct((F.degrees(F.atan2(x, -s * y)) + lon0).alias("lon"), lat.alias("lat"))


def projected_mesh(spark: SparkSession, projection: str, ni: int, nj: int, x0: float, y0: float, dx: float, dy: float, **params) -> DataFrame:
    """mesh_cell (cell_id, i, j, ring) of a regular grid in projection coordinates: 'lcc' or 'stere'."""
    inverse = {"lcc": lambert_inverse, "stere": stereographic_inverse}
    if projection not in inverse:
        raise ValueError(f"unknown projection {projection!r}")
    plane = with_ring(regular_cells(spark, Regular(ni, nj, x0, y0, dx, dy, spherical=False)))
    return plane.select("cell_id", "i", "j", F.transform("ring", lambda p: inverse[projection](p.lon, p.lat, **params)).alias("ring"))


# ------------------------------------------------------------ detection


def detect_regular(cells: DataFrame, tol: float = 1e-10) -> Regular | None:
    """The regular grid that cells (lon_lo, lon_hi, lat_lo, lat_hi) form, if their edges are evenly spaced and fill it.

    Distinct edges number ni + nj, the square root of the cells.
    """
    axes = []
    for lo, hi in (("lon_lo", "lon_hi"), ("lat_lo", "lat_hi")):
        edge = cells.select(F.round(F.col(lo), 9).alias("e")).union(cells.select(F.round(F.col(hi), 9))).distinct()
        step = edge.select("e", (F.lead("e").over(Window.orderBy("e")) - F.col("e")).alias("d"))
        axes.append(step.agg(F.min("e"), F.count("*"), F.min("d"), F.max("d"), F.avg("d")).first())
    (x0, nx, dx0, dx1, dx), (y0, ny, dy0, dy1, dy) = axes
    if nx < 2 or ny < 2 or cells.count() != (nx - 1) * (ny - 1) or dx1 - dx0 > max(tol * dx, 1e-8) or dy1 - dy0 > max(tol * dy, 1e-8):
        return None
    return Regular(nx - 1, ny - 1, x0, y0, dx, dy)


def is_rectilinear(cells: DataFrame) -> bool:
    """Whether the cells are the full product of their distinct longitude and latitude intervals."""
    a = cells.select(F.countDistinct("lon_lo", "lon_hi").alias("x"), F.countDistinct("lat_lo", "lat_hi").alias("y"), F.count("*").alias("n")).first()
    return a["x"] * a["y"] == a["n"]


def degenerate(ring: Column, area: Column) -> Column:
    """Why a cell is degenerate, in this order: few_vertices, zero_area; null if it is not."""
    return F.when(F.size(F.array_distinct(ring)) < 3, "few_vertices").when(area < 1e-25, "zero_area")
