"""Durable intermediate tables, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset and all runs in one process, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/fieldspark/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before the interpreter
            return


class Saved:
    """A table written as Parquet to the shared folder: cuts lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")  # the table stands for its shuffles, so their files go when it is written
        try:
            df.write.parquet(self.path)
        finally:
            conf.set(key, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def saved(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (u, v) of BIGINT nodes, by repeated contraction.

    Returns (node, root): root is the smallest node of the component, and every
    node that has an edge appears once.  Each round points a node at its
    smallest neighbour (partial aggregation, so hubs are cheap), shortens the
    pointers twice by self-joins, relabels both ends of the edges and drops
    duplicates and loops.  The rounds' maps are then composed from the last to
    the first.  No join needs a hub's rows in one task: all are equi-joins
    whose many-rows side adaptive execution can split.  Null ends and loops are
    ignored; no edges give an empty table.
    """
    e = Saved(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    maps: list[Saved] = []
    while e.df.limit(1).count():
        both = e.df.select("u", "v").unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = Saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("to")), f"{name}-parent")
        p = parent.df
        for _ in range(2):
            up = p.select(F.col("node").alias("to"), F.col("to").alias("above"))
            p = p.join(up, "to").select("node", F.col("above").alias("to"))
        jumped = Saved(p, f"{name}-map")
        parent.drop()
        m = jumped.df
        nxt = (
            e.df.join(m.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
            .join(m.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        nxt = Saved(nxt, f"{name}-edges")
        e.drop()
        e = nxt
        maps.append(jumped)
    if not maps:
        return e.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    root = maps[-1].df.select("node", F.col("to").alias("root"))
    for m in reversed(maps[:-1]):
        later = root.select(F.col("node").alias("to"), "root")
        root = m.df.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return root


def renamed(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns _0, _1, ... that clash with no name, and the way back to its own names."""
    own = [f"_{i}" for i in range(len(df.columns))]
    back = lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(own, df.columns, strict=True)])
    return df.toDF(*own), back


def own_name(df: DataFrame, column: str) -> str:
    """The name that ``renamed`` gives a column."""
    return f"_{df.columns.index(column)}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` equals ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
