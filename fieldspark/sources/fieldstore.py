"""Datasets of named variables: Parquet field tables with a metadata table.

A dataset folder holds ``data`` (var, t_idx, lev, cell_id, value), partitioned
by var and t_idx so that a timestep's read touches its files only, and
``meta`` (var, key, value): one small row set that describe and attribute
lookups read instead of the data.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, netcdf

READ = 1 << 20


class InvalidInput(ValueError):
    """A request outside the dataset: unknown variable, timestep or box."""


@dataclass(frozen=True)
class Box:
    """A hyperslab: start, number of elements and step of each dimension."""

    offsets: Sequence[int]
    extents: Sequence[int]
    strides: Sequence[int] | None = None

    def check(self, shape: Sequence[int]) -> Box:
        strides = self.strides or (1,) * len(self.offsets)
        if not len(self.offsets) == len(self.extents) == len(strides) == len(shape):
            raise InvalidInput("box and variable differ in rank")
        for o, e, s, n in zip(self.offsets, self.extents, strides, shape, strict=True):
            if s < 1 or o < 0 or e < 1 or o + (e - 1) * s >= n:
                raise InvalidInput(f"box [{o}, +{e} x {s}] leaves extent {n}")
        return Box(self.offsets, self.extents, strides)


def hyperslab(df: DataFrame, dims: list[str], box: Box, shape: Sequence[int]) -> DataFrame:
    """Rows whose index columns lie on the box; plain comparisons, so ranges reach the Parquet scan."""
    box = box.check(shape)
    for c, o, e, s in zip(dims, box.offsets, box.extents, box.strides, strict=True):
        df = df.where(F.col(c).between(o, o + (e - 1) * s))
        if s > 1:
            df = df.where((F.col(c) - o) % s == 0)
    return df


def parse_attribute(name: str, text: str) -> str | float:
    """A number if the whole text is one; ``units`` stays text."""
    if name == "units":
        return text
    try:
        return float(text)
    except ValueError:
        return text


class Dataset:
    """A dataset of the native store; ``open_dataset`` picks the driver by the configuration's backend."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- metadata

    def _meta(self, var: str) -> dict[str, str]:
        rows = self.spark.read.parquet(f"{self.path}/meta").where(F.col("var") == var).collect()
        if not rows and var:
            raise InvalidInput(f"no variable {var!r}")
        return {r["key"]: r["value"] for r in sorted(rows, key=lambda r: r["at"])}

    def describe(self, var: str) -> dict:
        """dtype, shape and number of timesteps, without reading data."""
        m = self._meta(var)
        return {"dtype": m["_dtype"], "shape": json.loads(m["_shape"]), "timesteps": int(m["_timesteps"])}

    def attribute_text(self, var: str, name: str) -> str:
        """An attribute as text; an empty variable name means the dataset's own."""
        m = self._meta(var)
        if name not in m:
            raise InvalidInput(f"no attribute {name!r}")
        return m[name]

    def attribute_double(self, var: str, name: str) -> float:
        v = parse_attribute(name, self.attribute_text(var, name).split(",")[0])
        if not isinstance(v, float):
            raise InvalidInput(f"attribute {name!r} is not a number")
        return v

    # -- data

    def read(self, var: str, t: int, box: Box | None = None) -> DataFrame:
        """(i0.., value) of one timestep; partition pruning on var and t_idx."""
        d = self.describe(var)
        if not 0 <= t < d["timesteps"]:
            raise InvalidInput(f"timestep {t} of {d['timesteps']}")
        dims = [f"i{k}" for k in range(len(d["shape"]))]
        df = self.spark.read.parquet(f"{self.path}/data").where((F.col("var") == var) & (F.col("t_idx") == t)).select(*dims, "value")
        return hyperslab(df, dims, box, d["shape"]) if box else df

    def write(self, var: str, t: int, df: DataFrame, shape: Sequence[int], dtype: str = "double", attributes: dict | None = None) -> None:
        """Stores one timestep (i0.., value); writing a timestep again replaces it."""
        dims = [f"i{k}" for k in range(len(shape))]
        out = df.select(*dims, F.col("value").cast(dtype).alias("value"), F.lit(var).alias("var"), F.lit(t).alias("t_idx"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("var", "t_idx").parquet(f"{self.path}/data")
        try:
            steps = max(t + 1, self.describe(var)["timesteps"])
        except Exception:  # the first write of the dataset or of the variable
            steps = t + 1
        meta = {"_dtype": dtype, "_shape": json.dumps(list(shape)), "_timesteps": str(steps)} | {k: str(v) for k, v in (attributes or {}).items()}
        self._put_meta(var, meta)

    def set_attributes(self, attributes: dict) -> None:
        self._put_meta("", {k: str(v) for k, v in attributes.items()})

    def _put_meta(self, var: str, values: dict[str, str]) -> None:
        """Appends; the latest value of a key counts."""
        import time

        at = time.time_ns()
        self.spark.createDataFrame([(var, k, v, at) for k, v in values.items()], "var string, key string, value string, at long").coalesce(1).write.mode("append").parquet(f"{self.path}/meta")


_backends: dict[str, object] = {"parquet": Dataset}


def register_backend(key: str, builder) -> None:
    _backends[key] = builder


def has_backend(key: str) -> bool:
    return key in _backends


def backends() -> list[str]:
    return sorted(_backends)


LOSSLESS = ("none", "zstd", "blosc", "deflate", "gzip", "lz4", "snappy")


@dataclass(frozen=True)
class DatasetConfig:
    """A dataset manifest, range-checked."""

    backend: str
    path: str
    codec: str = "none"
    level: int = 1
    prefetch_depth: int = 0
    workers: int = 1
    high_watermark: int = 8
    low_watermark: int = 4

    @classmethod
    def from_dict(cls, d: dict) -> DatasetConfig:
        if not d.get("backend") or not d.get("path"):
            raise InvalidInput("backend and path are required")
        codec, pre, pool = d.get("codec") or {}, d.get("prefetch") or {}, d.get("worker_pool") or {}
        c = cls(d["backend"], d["path"], codec.get("name", "none"), int(codec.get("level", 1)), int(pre.get("depth", 0)), int(pool.get("threads", 1)), int(pool.get("high_watermark", 8)), int(pool.get("low_watermark", 4)))
        if c.codec not in LOSSLESS:
            raise InvalidInput(f"codec {c.codec!r} is not lossless")
        if c.prefetch_depth < 0 or c.workers < 1 or not 0 <= c.low_watermark <= c.high_watermark:
            raise InvalidInput("prefetch depth, threads or watermarks out of range")
        return c

    def to_dict(self) -> dict:
        return {"backend": self.backend, "path": self.path, "codec": {"name": self.codec, "level": self.level}, "prefetch": {"depth": self.prefetch_depth}, "worker_pool": {"threads": self.workers, "high_watermark": self.high_watermark, "low_watermark": self.low_watermark}}


def open_dataset(spark: SparkSession, config: str | dict) -> Dataset:
    """Opens by a manifest: a dict, YAML text, or the path of a YAML file."""
    if isinstance(config, str):
        import yaml

        text = config if "\n" in config or ":" in config.split("/")[0] else open(config).read()
        config = yaml.safe_load(text)
    c = DatasetConfig.from_dict(config)
    if c.backend not in _backends:
        raise InvalidInput(f"no backend {c.backend!r}; there are {backends()}")
    return _backends[c.backend](spark, c.path)


def byte_count(shape: Sequence[int], dtype: str) -> int:
    size = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8}[dtype]
    return math.prod(shape) * size


# ------------------------------------------------------------ weight tables


def write_esmf(weights: DataFrame, path: str, n_a: int, n_b: int) -> None:
    """Weights as S, row, col with 1-based indices, and the grid sizes; fractions and areas are not part of the format."""
    out = weights.select((F.col("row") + 1).cast("int").alias("row"), (F.col("col") + 1).cast("int").alias("col"), F.col("w").alias("S"))
    out.write.mode("overwrite").parquet(f"{path}/weights")
    weights.sparkSession.createDataFrame([(n_a, n_b)], "n_a long, n_b long").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def read_esmf(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    n = spark.read.parquet(f"{path}/sizes").first()
    w = spark.read.parquet(f"{path}/weights").select((F.col("row") - 1).cast("long").alias("row"), (F.col("col") - 1).cast("long").alias("col"), F.col("S").alias("w"))
    return w, n["n_a"], n["n_b"]


def write_esmf_file(weights: DataFrame, path: str, n_a: int, n_b: int) -> None:
    """Weights as one NetCDF file, by row and column: 16 bytes a weight pass through the driver; ``write_esmf`` has no such bound."""
    t = weights.select(F.col("w").cast("double").alias("w"), (F.col("col") + 1).cast("int").alias("col"), (F.col("row") + 1).cast("int").alias("row")).orderBy("row", "col").toArrow()
    # Names that readers of weight files look up.
    names = {"w": "S", "col": "col_idx", "row": "row_idx"}
    variables = {n: (["num_wgts"], t.column(c).to_numpy(), {}) for c, n in names.items()}
    files.write_bytes(path, netcdf.encode({"num_wgts": t.num_rows}, variables, {"n_a": n_a, "n_b": n_b}))


def read_esmf_file(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(weights, n_a, n_b) of such a file, or of one with ``col`` and ``row`` and size dimensions; tasks read ranges of it."""
    h = netcdf.header(path)
    size = dict(h.dims) | {k: v for k, v in h.attributes.items() if k in ("n_a", "n_b")}
    found = [next((h.variables[n] for n in names if n in h.variables), None) for names in (("row_idx", "row"), ("col_idx", "col"), ("S",))]
    if None in found or not {"n_a", "n_b"} <= set(size):
        raise InvalidInput(f"{path} holds no weights")
    n = h.shape(found[2])[0]

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                row, col, w = (netcdf.read_range(path, v, at, min(at + READ, n)) for v in found)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64) - 1), pa.array(col.astype(np.int64) - 1), pa.array(w.astype(np.float64))], ["row", "col", "w"])

    n_a, n_b = (int(np.atleast_1d(size[k])[0]) for k in ("n_a", "n_b"))
    return spark.range(0, n, READ).mapInArrow(run, "row long, col long, w double"), n_a, n_b


def scrip_egress(weights: DataFrame, src_cell: DataFrame, dst_cell: DataFrame, method: str) -> dict[str, DataFrame]:
    """Tables in remapping-file terms: 1-based addresses, centers, areas, fractions and the method's name."""
    names = {"conservative": "Conservative remapping", "bilinear": "Bilinear remapping", "nearest": "Nearest neighbor remapping", "patch": "Patch remapping", "bicubic": "Bicubic remapping"}
    if method not in names:
        raise InvalidInput(f"unknown method {method!r}")
    links = weights.select((F.col("col") + 1).alias("src_address"), (F.col("row") + 1).alias("dst_address"), F.col("w").alias("remap_matrix"))
    grid = lambda d, key, p: d.select((F.col(key) + 1).alias("address"), F.col("clon").alias(f"{p}_grid_center_lon"), F.col("clat").alias(f"{p}_grid_center_lat"), F.col("area").alias(f"{p}_grid_area"), F.col("frac").alias(f"{p}_grid_frac"))
    return {"links": links, "src": grid(src_cell, "col", "src"), "dst": grid(dst_cell, "row", "dst"), "title": weights.sparkSession.createDataFrame([(names[method],)], "map_method string")}


def gmsh(mesh: DataFrame, path: str) -> None:
    """Writes a mesh (cell_id, ring) as a v2.2 ASCII mesh file; one file, so for meshes that fit the driver."""
    rows = mesh.select("cell_id", "ring").orderBy("cell_id").collect()
    nodes: dict[tuple[float, float], int] = {}
    cells = [(r["cell_id"], [nodes.setdefault((p["lon"], p["lat"]), len(nodes) + 1) for p in r["ring"]]) for r in rows]
    kinds = {3: 2, 4: 3}
    lines = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(len(nodes))]
    lines += [f"{n} {x:.17g} {y:.17g} 0" for (x, y), n in nodes.items()]
    tris = [(c, t) for c, v in cells for t in ([v] if len(v) in kinds else [[v[0], v[i], v[i + 1]] for i in range(1, len(v) - 1)])]
    lines += ["$EndNodes", "$Elements", str(len(tris))]
    lines += [f"{k + 1} {kinds[len(v)]} 2 0 {c} {' '.join(map(str, v))}" for k, (c, v) in enumerate(tris)]
    with open(path, "w") as f:
        f.write("\n".join([*lines, "$EndElements", ""]))
