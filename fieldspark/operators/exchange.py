"""Ghost cells, gathers, reductions and scans: what neighbour exchange computes, as joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCAN_RANGE = 1 << 14


def halo_ghost(cells: DataFrame, shape: Sequence[int], width: int, periodic: bool = False) -> DataFrame:
    """Ghost cells of blocks over a grid of ranks.

    cells (rank, i0.., value) with local indices 0..n-1; ranks are numbered
    along one dimension, the first index.  A rank's first ``width`` layers go
    to its lower neighbour's upper ghost layers and its last to the upper
    neighbour's lower ones.  Returns (rank, i0.., value) with ghost indices
    -width..-1 and n..n+width-1.  An equi-shift on indices: no join at all.
    """
    n = shape[0]
    if n < 2 * width:
        raise ValueError("a block must hold twice the halo width")
    ranks = cells.agg(F.max("rank")).first()[0]
    count = 0 if ranks is None else ranks + 1
    low = cells.where(F.col("i0") < width).withColumns({"rank": F.col("rank") - 1, "i0": F.col("i0") + n})
    high = cells.where(F.col("i0") >= n - width).withColumns({"rank": F.col("rank") + 1, "i0": F.col("i0") - n})
    out = low.unionByName(high)
    if periodic:
        return out.withColumn("rank", F.pmod(F.col("rank"), F.lit(max(count, 1))))
    return out.where(F.col("rank").between(0, count - 1))


def halo_exchange(values: DataFrame, pattern: DataFrame) -> DataFrame:
    """(rank, slot, value) of requests (rank, slot, owner, local_id) answered from values (rank, local_id, value)."""
    v = values.select(F.col("rank").alias("owner"), "local_id", "value")
    return pattern.join(v, ["owner", "local_id"], "left").select("rank", "slot", "value")


def halo_pattern(weights: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(rank, owner, col, slot): the columns that each rank's rows need from other ranks.

    rows (row, rank), cols (col, owner).  Slots count a rank's requests from
    0, by owner and column; ranks hold bounded blocks.
    """
    need = weights.join(rows, "row").join(cols, "col").where("rank <> owner").select("rank", "owner", "col").distinct()
    return need.withColumn("slot", F.row_number().over(Window.partitionBy("rank").orderBy("owner", "col")) - 1)


def allgather(parts: DataFrame) -> DataFrame:
    """(pos, rank, idx, value): ranks' values in rank order with global positions."""
    return prefix_sum_positions(parts, ["rank", "idx"])


def prefix_sum_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the global position in the order: within the rows that share all keys but the last, on top of the counts before them."""
    keys = order[:-1]
    base = _starts(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order[-1])) - 1
    return df.withColumn("_k", nth).join(base, keys).withColumn("pos", F.col("_b") + F.col("_k")).drop("_b", "_k")


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _b): rows before each combination of keys, from counts (keys, _n) by one key within the next."""
    outer, last = keys[:-1], keys[-1]
    before = F.sum("_n").over(Window.partitionBy(*outer).orderBy(last)) - F.col("_n")
    inner = counts.select(*keys, before.alias("_b"))
    if not outer:
        return inner
    above = _starts(counts.groupBy(*outer).agg(F.sum("_n").alias("_n")), outer).withColumnRenamed("_b", "_above")
    return inner.join(above, outer).select(*keys, (F.col("_b") + F.col("_above")).alias("_b"))


def prefix_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """Exclusive running sum over a BIGINT order column: within ranges of it, on top of the ranges' own sums."""
    part = F.floor(F.col(order) / SCAN_RANGE).alias("_part")
    d = df.withColumn("_part", part)
    per = d.groupBy("_part").agg(F.sum(value).alias("_s"))
    base = per.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_b"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_w", within).join(base, "_part").withColumn("exclusive_sum", F.col("_b") + F.col("_w")).drop("_part", "_w", "_b")


def allreduce(values: DataFrame, op: str = "sum") -> DataFrame:
    """(pos, value): element-wise sum, min or max over ranks of (rank, pos, value)."""
    ops = {"sum": F.sum, "min": F.min, "max": F.max}
    if op not in ops:
        raise ValueError(f"unknown reduction {op!r}")
    return values.groupBy("pos").agg(ops[op]("value").alias("value"))


def gather_replicated(bands: DataFrame) -> DataFrame:
    """(pos, level, j, i, value): bands (rank, level, j, i, value) in level, j, i order; small enough fields may be broadcast by the caller."""
    return prefix_sum_positions(bands.drop("rank"), ["level", "j", "i"])


def split_communicator(ranks: DataFrame) -> DataFrame:
    """(color, new_rank, rank): ranks (rank, color, key) renumbered within their color by key, ties by rank."""
    w = Window.partitionBy("color").orderBy("key", "rank")
    return ranks.withColumn("new_rank", F.row_number().over(w) - 1).select("color", "new_rank", "rank")
