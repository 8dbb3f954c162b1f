"""The regridding interface: fit weights once, apply them to many fields.

Method choice is a plan decision made before any job: regular pairs take index
arithmetic (without a weight table where the source is small enough to be
broadcast), rectilinear ones one axis at a time, all else a candidate join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as ap
from ..operators import grids, stencil, weights
from ..operators.grids import Regular
from ..sources import fieldstore

METHODS = ("nearest", "bilinear", "bicubic", "patch", "conservative", "conservative_2nd_order")


@dataclass(frozen=True)
class Mesh:
    """A mesh of cells (cell_id, ring[, mask]); a regular grid keeps its formula."""

    cells: DataFrame | None
    regular: Regular | None = None
    spherical: bool = True
    masked: bool = False

    @classmethod
    def of_regular(cls, g: Regular) -> Mesh:
        return cls(None, g, g.spherical)

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell_id, ring, lon, lat, area[, mask])."""
        if self.cells is None:
            c = grids.with_ring(grids.regular_cells(spark, self.regular))
            return c.select("cell_id", "ring", F.col("clon").alias("lon"), F.col("clat").alias("lat"), "area")
        m = self.cells.withColumn("c", grids.ring_centroid(F.col("ring"), self.spherical))
        extra = ["mask"] if "mask" in self.cells.columns else []
        return m.select("cell_id", "ring", "c.lon", "c.lat", grids.ring_area(F.col("ring"), self.spherical).alias("area"), *extra)


class Regridder:
    """``Regridder(src, dst, method).fit(spark)`` then ``transform(field)``."""

    def __init__(self, src: Mesh, dst: Mesh, method: str = "bilinear", norm: str = "fracarea", skipna: bool = False, na_thres: float = 1.0):
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; there are {METHODS}")
        if norm not in ("dstarea", "fracarea"):
            raise ValueError(f"unknown norm {norm!r}")
        if src.spherical != dst.spherical:
            raise ValueError("source and destination differ in coordinate system")
        self.src, self.dst, self.method, self.norm, self.skipna, self.na_thres = src, dst, method, norm, skipna, na_thres
        self.weights: DataFrame | None = None
        self._fitted: DataFrame | None = None  # our own weights, which need no table where a stencil serves

    def fit(self, spark: SparkSession) -> Regridder:
        w = self._weights(spark).select("row", "col", "w")
        if self.src.masked or "mask" in (self.src.cells.columns if self.src.cells is not None else []):
            s, d = self.src.table(spark), self.dst.table(spark)
            w = weights.coastal(w.persist(), d.select(F.col("cell_id").alias("row"), "lon", "lat"), s.select(F.col("cell_id").alias("col"), "lon", "lat", "mask"))
        self.weights = self._fitted = w.select("row", "col", "w").persist()
        self._rows = self.dst.table(spark).select(F.col("cell_id").alias("row"))
        return self

    def _weights(self, spark: SparkSession) -> DataFrame:
        a, b = self.src.regular, self.dst.regular
        if a and b and self.method == "nearest":
            return weights.nearest_rect(spark, a, b)
        if a and b and self.method == "bilinear":
            return weights.bilinear_rect(spark, a, b)
        if a and b and self.method == "conservative":
            return weights.conservative_rect(spark, a, b, self.norm)
        s, d = self.src.table(spark), self.dst.table(spark)
        sp, dp = s.select(F.col("cell_id").alias("col"), "lon", "lat"), d.select(F.col("cell_id").alias("row"), "lon", "lat")
        if self.src.spherical:
            weights.longitudes_disjoint(sp, dp)
        if self.method == "nearest":
            return weights.nearest(dp, sp, self.src.spherical)
        if self.method in ("bilinear", "bicubic", "patch"):
            return getattr(weights, self.method)(dp, sp)
        extra = lambda t: [c for c in ("mask",) if c in t.columns]
        sc = s.select(F.col("cell_id").alias("col"), "ring", *extra(s))
        dc = d.select(F.col("cell_id").alias("row"), "ring", *extra(d))
        first = weights.conservative(sc, dc, self.norm, self.src.spherical)
        if self.method == "conservative" or not self.src.spherical:
            return first
        xyz = lambda t, key: t.select(F.col("cell_id").alias(key), grids.xyz(F.col("lon"), F.col("lat")).alias("p")).select(key, "p.x", "p.y", "p.z")
        return weights.gradient_corrected(first, xyz(s, "cell"), weights.adjacency(s), xyz(d, "row"))

    def transform(self, field: DataFrame) -> DataFrame:
        """(row, value columns) of a field (col, value columns)."""
        if self.weights is None:
            raise ValueError("fit first")
        if self.skipna:
            return ap.nan_apply(self.weights, field, self._rows, self.na_thres)
        a, b, values = self.src.regular, self.dst.regular, len(field.columns) - 1
        if a and b and not self.src.masked and self.weights is self._fitted and stencil.fits(a, b, self.method, values):
            return stencil.regrid(field.sparkSession, a, b, self.method, field, self.norm)
        return ap.apply(self.weights, field, self._rows)

    def __call__(self, field: DataFrame) -> DataFrame:
        if self.weights is None:
            self.fit(field.sparkSession)
        return self.transform(field)

    def regrid_categorical(self, field: DataFrame, categories: list | None = None) -> DataFrame:
        """fraction_<category> columns of a field (col, category)."""
        return ap.categorical_fractions(self.weights, field, self._rows, ap.categories(field) if categories is None else categories)

    def to_esmf(self, path: str) -> None:
        n = lambda m: m.table(self.weights.sparkSession).count()
        fieldstore.write_esmf(self.weights, path, n(self.src), n(self.dst))

    @classmethod
    def from_esmf(cls, spark: SparkSession, path: str, src: Mesh, dst: Mesh, **more) -> Regridder:
        r = cls(src, dst, **more)
        r.weights, _, n_b = fieldstore.read_esmf(spark, path)
        r._rows = spark.range(n_b).withColumnRenamed("id", "row")
        return r

    def to_file(self, path: str) -> None:
        """The weights as Parquet, to be fitted once and used by many sessions."""
        self.weights.write.mode("overwrite").parquet(path)


class VectorRegridder:
    """Regrids vector fields (col, u, v) with rotation angles; methods other than nearest act as bilinear."""

    def __init__(self, src: Mesh, dst: Mesh, src_alpha: DataFrame, dst_alpha: DataFrame, n_src: int, method: str = "bilinear"):
        self.scalar = Regridder(src, dst, method if method == "nearest" else "bilinear")
        self.src_alpha, self.dst_alpha, self.n_src = src_alpha, dst_alpha, n_src

    def fit(self, spark: SparkSession) -> VectorRegridder:
        w = self.scalar.fit(spark).weights
        self.w_u, self.w_v = weights.vector_weights(w, self.src_alpha, self.dst_alpha, self.n_src)
        return self

    def transform(self, field: DataFrame) -> DataFrame:
        both = field.select("col", F.col("u").alias("value")).unionByName(field.select((F.col("col") + self.n_src).alias("col"), F.col("v").alias("value")))
        u, v = (ap.apply(w, both, self.scalar._rows).withColumnRenamed("value", c) for w, c in ((self.w_u, "u"), (self.w_v, "v")))
        return u.join(v, "row")


def detect_mesh(df: DataFrame, spherical: bool = True) -> Mesh:
    """A mesh from a table's columns: cell edges (regular if evenly spaced), vertex bounds, or rings."""
    cols = set(df.columns)
    if {"lon_lo", "lon_hi", "lat_lo", "lat_hi"} <= cols:
        g = grids.detect_regular(df)
        if g:
            return Mesh.of_regular(Regular(g.ni, g.nj, g.lon0, g.lat0, g.dlon, g.dlat, spherical))
        return Mesh(grids.with_ring(df).select("cell_id", "ring"), None, spherical)
    if {"lons", "lats"} <= cols:
        return Mesh(grids.bounds_mesh(df), None, spherical)
    if "ring" in cols:
        return Mesh(df, None, spherical)
    raise ValueError(f"no grid in columns {sorted(cols)}")
