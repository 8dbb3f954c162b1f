"""Sparse weighted apply and conservation over weight tables.

weights (row, col, w), source field (col, value columns), destination cells
(row).  The weights are the large side; a source field joins on ``col`` and
one aggregation by ``row`` serves all variables, with partial sums before its
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _summed(terms: DataFrame, dst: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums of ``sums`` by row for exactly the rows of ``dst``.

    Destination rows enter the aggregation as zeros beside the terms, so rows
    without weights need no join: one shuffle of partial sums serves all.
    """
    names = list(sums)
    some = terms.select("row", *[c.cast("double").alias(n) for n, c in sums.items()], F.lit(0).alias("_own"))
    none = dst.select("row", *[F.lit(0.0).alias(n) for n in names], F.lit(1).alias("_own"))
    out = some.unionByName(none).groupBy("row").agg(*[F.sum(n).alias(n) for n in names], F.max("_own").alias("_own"))
    return out.where("_own = 1").drop("_own")


def apply(weights: DataFrame, src: DataFrame, dst: DataFrame, values: list[str] | None = None) -> DataFrame:
    """dst[row] = sum of w * src[col] for each value column; rows without weights get 0."""
    values = values or [c for c in src.columns if c != "col"]
    return _summed(weights.join(src, "col"), dst, {v: F.col("w") * F.col(v) for v in values})


def nan_apply(weights: DataFrame, src: DataFrame, dst: DataFrame, na_thres: float = 1.0, values: list[str] | None = None) -> DataFrame:
    """Apply over values that are not NaN, divided by the valid weight.

    A row counts if its valid share is 1 - na_thres or more, so ``na_thres`` is
    the missing share tolerated.  Rows that do not, and rows without weight,
    are NaN.  Null values count as NaN.
    """
    values = values or [c for c in src.columns if c != "col"]
    sums = {"_total": F.col("w")}
    for v in values:
        ok = F.col(v).isNotNull() & ~F.isnan(v)
        sums |= {v: F.when(ok, F.col("w") * F.col(v)).otherwise(0.0), f"_w_{v}": F.when(ok, F.col("w")).otherwise(0.0)}
    got = _summed(weights.join(src, "col"), dst, sums)
    out = []
    for v in values:
        w, total = F.col(f"_w_{v}"), F.col("_total")
        kept = (total != 0) & (w != 0) & (w / total >= 1 - na_thres - 1e-6)
        out.append(F.when(kept, F.col(v) / w).otherwise(F.lit(float("nan"))).alias(v))
    return got.select("row", *out)


def masked_apply(weights: DataFrame, src: DataFrame, dst: DataFrame, value: str = "value") -> DataFrame:
    """Apply where ``dst.mask`` is not 0; masked rows keep their ``old`` value."""
    sums = weights.join(src, "col").groupBy("row").agg(F.sum(F.col("w") * F.col(value)).alias("_new"))
    return dst.join(sums, "row", "left").select("row", F.when(F.col("mask") == 0, F.col("old")).otherwise(F.coalesce("_new", F.lit(0.0))).alias(value))


def halo_apply(weights: DataFrame, local: DataFrame, halo: DataFrame, dst: DataFrame, n_local: int) -> DataFrame:
    """Apply over owned values (col < n_local) and gathered ones (col - n_local indexes the halo)."""
    far = halo.select((F.col("col") + n_local).alias("col"), *[c for c in local.columns if c != "col"])
    return apply(weights, local.unionByName(far), dst)


def gathered_apply(weights: DataFrame, gather, dst: DataFrame) -> DataFrame:
    """Apply over what ``gather(cols)`` returns as (col, value) for the needed columns; it is called once."""
    return apply(weights, gather(weights.select("col").distinct()), dst)


def to_csr(weights: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(row_ptr: row, start, end; entries: row, col, w sorted by row, col); duplicates stay.

    Offsets are sums over per-row counts, taken within ranges of rows first so
    that no task sees all rows.
    """
    spark = weights.sparkSession
    size = 1 << 14
    n = weights.groupBy("row").agg(F.count("*").alias("n"))
    every = spark.range(n_rows).withColumnRenamed("id", "row").join(n, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("row") / size).alias("part"))
    per = every.groupBy("part").agg(F.sum("n").alias("sum"))
    base = per.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("base"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("row"))
    ptr = every.withColumn("upto", upto).join(base, "part").select("row", (F.col("base") + F.col("upto") - F.col("n")).alias("start"), (F.col("base") + F.col("upto")).alias("end"))
    return ptr, weights.repartitionByRange("row", "col").sortWithinPartitions("row", "col")


def source_integral(src_cell: DataFrame, field: DataFrame) -> DataFrame:
    """Sum of value * area_a * frac_a."""
    return src_cell.join(field, "col").agg(F.sum(F.col("value") * F.col("area_a") * F.col("frac_a")).alias("integral"))


def destination_integral(dst_cell: DataFrame, field: DataFrame, norm: str = "dstarea") -> DataFrame:
    """dstarea: sum of value * area_b where frac_b is not 0; fracarea: sum of value * area_b * frac_b."""
    j = dst_cell.join(field, "row")
    if norm == "dstarea":
        return j.agg(F.sum(F.when(F.col("frac_b") != 0, F.col("value") * F.col("area_b")).otherwise(0.0)).alias("integral"))
    if norm == "fracarea":
        return j.agg(F.sum(F.col("value") * F.col("area_b") * F.col("frac_b")).alias("integral"))
    raise ValueError(f"unknown norm {norm}")


def conservation_report(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(src_integral, dst_integral, abs_error, rel_error) of two one-row integrals."""
    a, b = src.select(F.col("integral").alias("src_integral")), dst.select(F.col("integral").alias("dst_integral"))
    err = F.abs(F.col("dst_integral") - F.col("src_integral"))
    scale = F.greatest(F.abs("src_integral"), F.abs("dst_integral"), F.lit(EPS))
    return a.crossJoin(b).select("src_integral", "dst_integral", err.alias("abs_error"), (err / scale).alias("rel_error"))


def adjust_by_fraction(field: DataFrame, dst_cell: DataFrame) -> DataFrame:
    """value / frac_b where frac_b is not 0."""
    f = F.col("frac_b")
    return field.join(dst_cell.select("row", "frac_b"), "row").select("row", F.when(f != 0, F.col("value") / f).otherwise(F.col("value")).alias("value"))


def wet_renormalize(weights: DataFrame, src_mask: DataFrame) -> DataFrame:
    """Weights without masked source cells; a row that keeps a part of its weight is scaled to 1."""
    wet = weights.join(src_mask.where("mask <> 0").select("col"), "col", "left_semi")
    total = wet.groupBy("row").agg(F.sum("w").alias("_t"))
    t = F.col("_t")
    return wet.join(total, "row").select("row", "col", F.when((t > 0) & (t < 1), F.col("w") / t).otherwise(F.col("w")).alias("w"))


def fracarea_normalize(weights: DataFrame) -> DataFrame:
    """Each row's weights divided by their sum where that is positive."""
    total = weights.groupBy("row").agg(F.sum("w").alias("_t"))
    return weights.join(total, "row").select("row", "col", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(F.col("w")).alias("w"))


def fractions(overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(col, frac_a) and (row, frac_b) of overlaps (row, col, overlap, area_a, area_b), clamped to 1."""
    a = overlaps.groupBy("col").agg(F.least(F.sum(F.col("overlap") / F.col("area_a")), F.lit(1.0)).alias("frac_a"))
    b = overlaps.groupBy("row").agg(F.least(F.sum(F.col("overlap") / F.col("area_b")), F.lit(1.0)).alias("frac_b"))
    return a, b


def total_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("row").agg(F.sum("w").alias("total"))


def categorical_fractions(weights: DataFrame, src: DataFrame, dst: DataFrame, categories: list) -> DataFrame:
    """One column fraction_<category> a category: the weight of the cells that hold it."""
    cols = {f"fraction_{c}": F.when(F.col("category") == c, F.col("w")).otherwise(0.0) for c in categories}
    return _summed(weights.join(src, "col"), dst, cols)


def categories(src: DataFrame, limit: int = 10_000) -> list:
    """Distinct categories that are neither null nor NaN; more than ``limit`` raise (each becomes a column)."""
    kind = dict(src.dtypes)["category"]
    ok = F.col("category").isNotNull() & (~F.isnan("category") if kind in ("double", "float") else F.lit(True))
    found = [r[0] for r in src.where(ok).select("category").distinct().orderBy("category").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories")
    return found
