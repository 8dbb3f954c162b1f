"""Bounded samples of labelled documents, as hashed terms, for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _learnable(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int, balanced: bool = False) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents that ``learn`` admits, chosen by hash of the identifier.

    ``balanced`` takes at most half of them from either class.  Labels that are
    null or not 0/1 teach nothing, and of documents that share an identifier the
    least text teaches.  The identifiers that are broadcast number
    ``limit`` at most.
    """
    order = F.xxhash64("doc_id"), "doc_id", "y"
    ids = _learnable(labels, label, learn)
    if balanced:
        ids = ids.where("y = 1").orderBy(*order).limit(limit // 2).unionByName(ids.where("y = 0").orderBy(*order).limit(limit // 2))
    else:
        ids = ids.orderBy(*order).limit(limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def terms(rows: DataFrame, extract: Callable, counts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, row, term, count) of a bounded sample, gathered to the driver; without ``counts`` they stay behind.

    ``extract(buf, offs)`` gives (document, term, count) arrays of a slice.
    """
    from .textvec import parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_pylist()
            for first, end, buf, offs in parts(b.column(0)):
                d, t, c = extract(buf, offs)
                cut = np.searchsorted(d, np.arange(end - first + 1))
                packed = [[x[i:j].astype("<i4").tobytes() for i, j in zip(cut, cut[1:], strict=False)] if kept else [b""] * (end - first) for x, kept in ((t, True), (c, counts))]
                yield pa.RecordBatch.from_arrays([pa.array(y[first:end], pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["y", "t", "c"])

    got = rows.mapInArrow(run, "y int, t binary, c binary").toArrow()
    t, c = got["t"].to_pylist(), got["c"].to_pylist()
    order = sorted(range(len(t)), key=lambda i: (t[i], c[i]))  # the fit must not depend on the order of tasks
    y = got["y"].to_numpy().astype(np.int64)[order] if order else np.zeros(0, np.int64)
    del got
    row = np.repeat(np.arange(len(order), dtype=np.int32), [len(t[i]) // 4 for i in order])
    term, count = (np.frombuffer(b"".join(x[i] for i in order), "<i4") for x in (t, c))
    return y, row, term, count


def counted(doc: np.ndarray, term: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs in order, with counts."""
    key, n = np.unique(doc.astype(np.int64) << bits | term.astype(np.int64), return_counts=True)
    return key >> bits, key & (1 << bits) - 1, n
