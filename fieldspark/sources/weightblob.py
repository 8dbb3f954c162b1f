"""A weight matrix as one binary blob: 40-byte header, then seven arrays.

Weights, rows, columns, frac_a, frac_b, area_a, area_b, in the byte order that
the header names.  One blob is one object, so it suits matrices that fit the
driver; Parquet (``Regridder.to_file``) serves larger ones.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic word, format version, byte order tags.
MAGIC, VERSION, LITTLE, BIG = 0x43574841, 1, 1, 2
_HEAD = "IIB7xQQQ"


@dataclass
class Matrix:
    w: np.ndarray
    row: np.ndarray
    col: np.ndarray
    frac_a: np.ndarray
    frac_b: np.ndarray
    area_a: np.ndarray
    area_b: np.ndarray

    @classmethod
    def of(cls, weights: DataFrame, src_cell: DataFrame, dst_cell: DataFrame) -> Matrix:
        """From weights (row, col, w), src_cell (col, frac_a, area_a) and dst_cell (row, frac_b, area_b), all ids from 0."""
        w = weights.orderBy("row", "col").select("row", "col", "w").toArrow()
        a = src_cell.orderBy("col").select("frac_a", "area_a").toArrow()
        b = dst_cell.orderBy("row").select("frac_b", "area_b").toArrow()
        return cls(*(t[c].to_numpy() for t, c in ((w, "w"), (w, "row"), (w, "col"), (a, "frac_a"), (b, "frac_b"), (a, "area_a"), (b, "area_b"))))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        w = spark.createDataFrame(pa.table({"row": self.row.astype(np.int64), "col": self.col.astype(np.int64), "w": self.w}))
        a = spark.createDataFrame(pa.table({"col": np.arange(len(self.frac_a)), "frac_a": self.frac_a, "area_a": self.area_a}))
        b = spark.createDataFrame(pa.table({"row": np.arange(len(self.frac_b)), "frac_b": self.frac_b, "area_b": self.area_b}))
        return w, a, b.withColumn("row", F.col("row").cast("long"))


def serialize(m: Matrix) -> bytes:
    head = struct.pack("<" + _HEAD, MAGIC, VERSION, LITTLE, len(m.frac_a), len(m.frac_b), len(m.w))
    body = [(m.w, "<f8"), (m.row, "<i8"), (m.col, "<i8"), (m.frac_a, "<f8"), (m.frac_b, "<f8"), (m.area_a, "<f8"), (m.area_b, "<f8")]
    return head + b"".join(np.asarray(a).astype(t).tobytes() for a, t in body)


def deserialize(blob: bytes) -> Matrix:
    """Raises on a foreign magic word, version or length."""
    if len(blob) < 40:
        raise ValueError("blob shorter than its header")
    order = "<" if blob[8] == LITTLE else ">"
    magic, version, tag, n_src, n_dst, nnz = struct.unpack(order + _HEAD, blob[:40])
    if magic != MAGIC or version != VERSION or tag not in (LITTLE, BIG):
        raise ValueError("not a weight blob of this version")
    out, at = [], 40
    for n, t in ((nnz, "f8"), (nnz, "i8"), (nnz, "i8"), (n_src, "f8"), (n_dst, "f8"), (n_src, "f8"), (n_dst, "f8")):
        out.append(np.frombuffer(blob, order + t, n, at).astype(t))
        at += n * 8
    if at != len(blob):
        raise ValueError("blob length does not match its header")
    return Matrix(*out)
