"""Regrids variables of a dataset or a NetCDF file: python -m fieldspark.plans.cli -s SRC -t NIxNJ -o OUT ...

A source that ends in .nc brings its grid in its lon and lat axes, and so does
a target file.  An output that ends in .nc is one file, put together on the
driver; a dataset folder has no such bound.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids
from ..operators.grids import Regular
from ..sources import files, netcdf
from ..sources.fieldstore import Dataset, InvalidInput
from .regridder import METHODS, Mesh, Regridder, detect_mesh

AXES = {"lon": ("lon", "longitude", "x"), "lat": ("lat", "latitude", "y")}


@dataclass(frozen=True)
class Grid:
    """A mesh with the centers of its axes; cells go along lon first."""

    mesh: Mesh
    lon: np.ndarray
    lat: np.ndarray

    @classmethod
    def world(cls, text: str) -> Grid:
        g = Regular.world(*map(int, text.split("x")))
        return cls(Mesh.of_regular(g), g.lon0 + (np.arange(g.ni) + 0.5) * g.dlon, g.lat0 + (np.arange(g.nj) + 0.5) * g.dlat)

    @classmethod
    def of_file(cls, spark: SparkSession, path: str) -> Grid:
        """The grid of a file's axes; edges lie midway between centers and end at the poles."""
        h = netcdf.header(path)
        found = {a: next((h.variables[n] for n in names if n in h.variables and len(h.variables[n].dims) == 1), None) for a, names in AXES.items()}
        if None in found.values():
            raise InvalidInput(f"{path} has no lon and lat axes")
        lon, lat = (netcdf.read_step(path, h, found[a], None).astype(float) for a in ("lon", "lat"))
        edges = lambda v, clamp: grids.cell_edges(spark.createDataFrame([(k, float(c)) for k, c in enumerate(v)], "idx long, center double"), clamp)
        rising = lambda d: d.select("idx", "center", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        cells = grids.rectilinear_cells(rising(edges(lon, False)), rising(edges(lat, True)))
        if (np.diff(lon) > 0).all() and (np.diff(lat) > 0).all():
            return cls(detect_mesh(cells), lon, lat)
        return cls(Mesh(grids.with_ring(cells).select("cell_id", "ring")), lon, lat)

    @property
    def shape(self) -> list[int]:
        return [len(self.lat), len(self.lon)]


Steps = list[tuple[int, Callable[[], DataFrame]]]


def _from_file(spark: SparkSession, path: str, grid: Grid, only: list[str] | None) -> dict[str, Steps]:
    """Each variable's timesteps as fields (col, value); all variables on the grid unless named.  Fill values become NaN."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(netcdf.NetcdfSource)
    h = netcdf.header(path)
    names = only or [v for v in h.variables if h.describe(v)["shape"] == grid.shape]

    def field(v: str, t: int) -> DataFrame:
        df = spark.read.format("netcdf").option("variable", v).load(path).where(F.col("t_idx") == t)
        value = F.col("value").cast("double")
        for fill in ("_FillValue", "missing_value"):
            if fill in h.variables[v].attributes:
                value = F.when(value == float(np.atleast_1d(h.variables[v].attributes[fill])[0]), float("nan")).otherwise(value)
        return df.select((F.col("i0") * len(grid.lon) + F.col("i1")).alias("col"), value.alias("value"))

    out = {}
    for v in names:
        if v not in h.variables or h.describe(v)["shape"] != grid.shape:
            raise InvalidInput(f"no variable {v!r} on the grid")
        out[v] = [(t, lambda v=v, t=t: field(v, t)) for t in range(h.describe(v)["timesteps"])]
    return out


def _from_dataset(d: Dataset, names: list[str]) -> dict[str, Steps]:
    return {v: [(t, lambda v=v, t=t: d.read(v, t).select(F.col("i0").alias("col"), "value")) for t in range(d.describe(v)["timesteps"])] for v in names}


def _to_file(path: str, grid: Grid, r: Regridder, fields: dict[str, Steps]) -> None:
    variables: dict[str, tuple[list[str], np.ndarray, dict]] = {"lat": (["lat"], grid.lat, {"units": "degrees_north"}), "lon": (["lon"], grid.lon, {"units": "degrees_east"})}
    most = max(len(steps) for steps in fields.values())
    for v, steps in fields.items():
        a = np.full((most, *grid.shape), np.nan)
        for t, f in steps:
            a[t] = r.transform(f()).select("row", "value").orderBy("row").toArrow().column("value").to_numpy().reshape(grid.shape)
        variables[v] = (["time", "lat", "lon"], a, {})
    files.write_bytes(path, netcdf.encode({"time": most, "lat": len(grid.lat), "lon": len(grid.lon)}, variables))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-s", "--source", required=True, help="dataset folder or NetCDF file")
    p.add_argument("-g", "--source-grid", help="NIxNJ of the source's global grid; a NetCDF file has its own")
    p.add_argument("-t", "--target-grid", required=True, help="NIxNJ of the target's global grid, or a NetCDF file with lon and lat")
    p.add_argument("-o", "--output", required=True, help="dataset folder or NetCDF file to write")
    p.add_argument("-m", "--method", choices=METHODS, default="bilinear")
    p.add_argument("--norm", choices=("dstarea", "fracarea"), default="fracarea")
    p.add_argument("--skipna", action="store_true")
    p.add_argument("--na-thres", type=float, default=1.0, help="missing share tolerated")
    p.add_argument("--vars", nargs="+", help="variables; a NetCDF file has all on its grid by default")
    a = p.parse_args(argv)
    is_file = lambda name: name.endswith(".nc")
    if not is_file(a.source) and not (a.source_grid and a.vars):
        p.error("a dataset folder needs --source-grid and --vars")
    spark = SparkSession.builder.getOrCreate()
    src = Grid.world(a.source_grid) if a.source_grid else Grid.of_file(spark, a.source)
    dst = Grid.of_file(spark, a.target_grid) if is_file(a.target_grid) else Grid.world(a.target_grid)
    fields = _from_file(spark, a.source, src, a.vars) if is_file(a.source) else _from_dataset(Dataset(spark, a.source), a.vars)
    if not fields:
        p.error("the source has no variable on its grid")
    r = Regridder(src.mesh, dst.mesh, a.method, a.norm, a.skipna, a.na_thres).fit(spark)
    if is_file(a.output):
        _to_file(a.output, dst, r, fields)
        return 0
    out = Dataset(spark, a.output)
    for v, steps in fields.items():
        for t, f in steps:
            out.write(v, t, r.transform(f()).withColumnRenamed("row", "i0"), (len(dst.lon) * len(dst.lat),))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
