"""Regridding between regular grids without a weight table.

A destination cell's sources and weights are index arithmetic, and a regular
pair needs a fixed number of them a cell.  With a source field of a checked
size each is one lookup in a broadcast hash table, so the regridded field is
one narrow stage: no shuffle, no aggregation.  ``fits`` is the check; beyond
it the weight table of ``weights`` and ``apply`` serve, which shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import Regular, regular_cells

#: Source values that are broadcast at most, and lookups a cell at most.
CELLS = 1 << 22
LOOKUPS = 16


def _per_axis(src: float, dst: float) -> int:
    """Source intervals that one destination interval can meet."""
    return int(math.ceil(dst / src - 1e-9)) + 1


def fits(src: Regular, dst: Regular, method: str, values: int = 1) -> bool:
    if src.ni * src.nj * values > CELLS:
        return False
    if method == "conservative":
        return _per_axis(src.dlon, dst.dlon) * _per_axis(src.dlat, dst.dlat) <= LOOKUPS
    return method in ("nearest", "bilinear")


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def _nearest(d: DataFrame, src: Regular) -> list[tuple[Column, Column]]:
    away = lambda x: F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")
    i = F.pmod(away((F.col("lon_lo") - src.lon0) / src.dlon), F.lit(src.ni))
    j = _clip(away((F.col("lat_lo") - src.lat0) / src.dlat), 0, src.nj - 1)
    return [(j * src.ni + i, F.lit(1.0))]


def _bilinear(src: Regular) -> list[tuple[Column, Column]]:
    tol, fi, fj = 1e-9, F.col("fi"), F.col("fj")
    inside = fj.between(-0.5 - tol, src.nj - 0.5 + tol)
    if not src.periodic:
        inside &= fi.between(-0.5 - tol, src.ni - 0.5 + tol)
    i0 = _whole(fi) if src.periodic else _clip(_whole(fi), 0, max(src.ni - 2, 0))
    j0 = _clip(_whole(fj), 0, max(src.nj - 2, 0))
    tx, ty = _clip(fi - i0, 0.0, 1.0), _clip(fj - j0, 0.0, 1.0)
    wrap = (lambda x: F.pmod(x, F.lit(src.ni))) if src.periodic else (lambda x: F.least(x, F.lit(src.ni - 1)))
    rows, cols = ((j0, 1 - ty), (F.least(j0 + 1, F.lit(src.nj - 1)), ty)), ((wrap(i0), 1 - tx), (wrap(i0 + 1), tx))
    return [(F.when(inside, j * src.ni + i), a * b) for j, a in rows for i, b in cols]


def _overlaps(src: Regular, dst: Regular) -> tuple[dict[str, Column], list[tuple[Column, Column]]]:
    """Named columns of the overlaps along each axis, and the pairs made of them; weights are areas yet."""
    eps, named, axes = 1e-12, {}, []
    for c, o, s, n, m, period in (("lon", src.lon0, src.dlon, src.ni, _per_axis(src.dlon, dst.dlon), src.periodic), ("lat", src.lat0, src.dlat, src.nj, _per_axis(src.dlat, dst.dlat), False)):
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        first, last = _whole((lo - o) / s + eps), F.ceil((hi - o) / s - eps).cast("long") - 1
        if not period:
            first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        named |= {f"{c}_a": first, f"{c}_b": last}
        terms = []
        for k in range(m):
            at = F.col(f"{c}_a") + k
            a, b = F.greatest(lo, o + at * s), F.least(hi, o + (at + 1) * s)
            size = b - a if not src.spherical else F.radians(b - a) if c == "lon" else F.sin(F.radians(b)) - F.sin(F.radians(a))
            named[f"{c}_{k}"] = F.when((at <= F.col(f"{c}_b")) & (b > a), size)
            terms.append((F.pmod(at, F.lit(n)) if period else at, F.col(f"{c}_{k}")))
        axes.append(terms)
    return named, [(j * src.ni + i, a * b) for i, a in axes[0] for j, b in axes[1]]


def regrid(spark: SparkSession, src: Regular, dst: Regular, method: str, field: DataFrame, norm: str = "fracarea") -> DataFrame:
    """(row, value columns) of a field (col, value columns) with one row for a source cell; cells without sources get 0."""
    values = [c for c in field.columns if c != "col"]
    d = regular_cells(spark, dst)
    if method == "nearest":
        pairs = _nearest(d, src)
    elif method == "bilinear":
        lon = F.col("clon")
        if src.periodic:
            lon = src.lon0 + F.pmod(lon - src.lon0, F.lit(360.0))
        d = d.withColumns({"fi": (lon - src.lon0) / src.dlon - 0.5, "fj": (F.col("clat") - src.lat0) / src.dlat - 0.5})
        pairs = _bilinear(src)
    else:
        named, pairs = _overlaps(src, dst)
        for c, x in named.items():
            d = d.withColumn(c, x)
        whole = F.col("area") if norm == "dstarea" else sum((F.coalesce(w, F.lit(0.0)) for _, w in pairs), F.lit(0.0))
        d = d.withColumn("whole", whole)
        pairs = [(F.when(w > 0, c), w / F.col("whole")) for c, w in pairs]
    cols = [F.col("cell_id").alias("row")]
    for k, (c, w) in enumerate(pairs):
        cols += [c.cast("long").alias(f"_c{k}"), w.alias(f"_w{k}")]
    out = d.select(*cols)
    for k in range(len(pairs)):
        near = field.select(F.col("col").cast("long").alias(f"_c{k}"), *[F.col(v).cast("double").alias(f"_v{k}_{i}") for i, v in enumerate(values)])
        out = out.join(F.broadcast(near), f"_c{k}", "left")
    total = lambda i: sum((F.coalesce(F.col(f"_w{k}") * F.col(f"_v{k}_{i}"), F.lit(0.0)) for k in range(len(pairs))), F.lit(0.0))
    return out.select("row", *[total(i).alias(v) for i, v in enumerate(values)])
