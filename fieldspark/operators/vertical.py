"""Vertical interpolation of columns by tension splines, and 3-D regridding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .apply import apply

MAX_LEVELS = 256


def _checked(levels: list[float], targets: list[float], tension: float) -> None:
    if not 2 <= len(levels) <= MAX_LEVELS:
        raise ValueError(f"source levels must number 2 to {MAX_LEVELS}")
    if not targets:
        raise ValueError("no target levels")
    if tension < 0:
        raise ValueError("tension must not be negative")


def interpolate(values: Column, levels: list[float], targets: list[float], tension: float = 0.0) -> Column:
    """ARRAY<DOUBLE> at ``targets`` from columns over shared ``levels`` (ascending or descending); a null column stays null."""
    _checked(levels, targets, tension)
    x = np.array(levels, float)
    flip = x[0] > x[-1]

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        out = np.full(len(v), None, object)
        ok = v.notna().to_numpy()
        if ok.any():
            y = np.stack([np.asarray(r, float) for r in v[ok]])
            if y.shape[1] != len(x):
                raise ValueError("a column's values and the source levels differ in number")
            xs, ys = (x[::-1], y[:, ::-1]) if flip else (x, y)
            xs = np.broadcast_to(xs, ys.shape)
            at = np.broadcast_to(np.array(targets, float), (len(ys), len(targets)))
            got = geo.spline_values(xs, ys, geo.spline_slopes(xs, ys), at, tension)
            for i, row in zip(np.flatnonzero(ok), got, strict=True):
                out[i] = row
        return pd.Series(out)

    return run(values)


def interpolate_own(df: DataFrame, targets: list[float], tension: float = 0.0) -> DataFrame:
    """(col_id, vals) of columns (col_id, levels, vals), each over levels of its own."""

    def run(batches):
        for b in batches:
            out = []
            for lv, v in zip(b["levels"], b["vals"], strict=True):
                _checked(list(lv), targets, tension)
                x, y = np.asarray(lv, float)[None], np.asarray(v, float)[None]
                if x[0, 0] > x[0, -1]:
                    x, y = x[:, ::-1], y[:, ::-1]
                out.append(geo.spline_values(x, y, geo.spline_slopes(x, y), np.array([targets], float), tension)[0])
            yield pd.DataFrame({"col_id": b["col_id"], "vals": out})

    return df.select("col_id", "levels", "vals").mapInPandas(run, "col_id long, vals array<double>")


class VerticalRegridder:
    """Interpolates array columns of a DataFrame from one set of levels to another."""

    def __init__(self, levels: list[float], targets: list[float], tension: float = 0.0):
        _checked(levels, targets, tension)
        self.levels, self.targets, self.tension = levels, targets, tension

    def transform(self, df: DataFrame, column: str = "vals") -> DataFrame:
        return df.withColumn(column, interpolate(F.col(column), self.levels, self.targets, self.tension))


def regrid_3d(weights: DataFrame, field: DataFrame, dst: DataFrame, levels: list[float], targets: list[float], tension: float = 2.0) -> DataFrame:
    """(row, vals): field (col, lev, value) regridded level by level in one aggregation, then interpolated along the column."""
    n = len(levels)
    wide = field.groupBy("col").agg(*[F.max(F.when(F.col("lev") == k, F.col("value"))).alias(f"l{k}") for k in range(n)])
    flat = apply(weights, wide, dst)
    return flat.select("row", interpolate(F.array(*[f"l{k}" for k in range(n)]), levels, targets, tension).alias("vals"))
