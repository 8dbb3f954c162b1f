"""Chat formatting of reply trees.

Messages form trees: each has a conversation, an identifier and a parent.
Paths from root to leaf are enumerated by iterative self-joins that double
their reach: after round j a message knows its ancestor 2**j up and the score
summed on the way, so a tree of depth d takes log2(d) rounds.  Leaves are
ranked by the score of their path and the chosen branches are marked from
leaf to root by the same ancestor tables.  Each chosen path becomes one
conversation in a template

    <|im_start|>role\\ntext<|im_end|>\\n

in which control strings inside texts and roles are escaped reversibly
(``\\`` doubles, ``<|`` becomes ``<\\|``), with the character spans of the
assistant's texts as loss mask.

Edge cases: null text and null role are empty; messages with a null or unknown
parent are roots; where parents run in a circle its least message is a root; of
messages that repeat an identifier the least row (parent, score, role, text)
stands, and rows without one are left out; equal scores choose the branch whose leaf comes first in
(turn, role, text) order; repeated rows are turns of their own; a null
conv_id is a conversation of its own; other columns are ignored; an empty
table gives an empty result.  One conversation is one output value, so a path
must fit in a task; conversations spread over tasks by their identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    out, i = [], 0
    while (j := s.find("\\", i)) >= 0:
        out += [s[i:j], s[j + 1 : j + 2]]
        i = j + 2
    return "".join([*out, s[i:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the [start, end) character spans of assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        turns.append((_unescape_role(head), unescape(body[: body.rindex(END)])))
    return turns


def _unescape_role(s: str) -> str:
    out, i = [], 0
    while (j := s.find("\\", i)) >= 0:
        c = s[j + 1 : j + 2]
        out += [s[i:j], "\n" if c == "n" else c]
        i = j + 2
    return "".join([*out, s[i:]])


def as_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a tree of messages: each row answers the one before it.

    Rows that bring their own message tree keep it: columns msg_id, parent_id
    and score of ``messages`` trees go straight to ``paths``.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    t = t.withColumn("msg_id", nth)
    return t.withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(0.0)})


def _same(a: DataFrame, b: DataFrame):
    return a["conv_id"].eqNullSafe(b["conv_id"])


def _reach(nodes: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(total and depth of every message, the ancestor tables, what circles after ``rounds`` doublings).

    total sums the scores from the message up to, but without, its ancestor
    ``up``; depth counts those messages and low is their least.  Messages that
    have reached their root leave the joins, so a round costs what is still
    under way.  A message that is under way after as many steps as its
    conversation has messages circles, and the ancestor it stands at is on the circle.
    """
    reach = nodes.select("k", "msg_id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"), F.col("msg_id").alias("low"))
    steps, under_way, done = [], reach.where("up is not null"), reach.where("up is null")
    while under_way.limit(1).count():
        if len(steps) == rounds:
            # From the circle's own messages on, the way round passes all of it.
            on = under_way.select("k", F.col("up").alias("msg_id")).distinct()
            return done, steps, under_way.join(on, ["k", "msg_id"], "left_semi").select("k", F.col("msg_id").alias("up"), "low")
        steps.append(under_way.select("k", "msg_id", "up"))
        far = done.unionByName(under_way).select("k", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"), F.col("low").alias("l2"))
        moved = under_way.join(far, ["k", "up"]).select("k", "msg_id", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"), F.least("low", "l2").alias("low"))
        moved = common.saved(moved, "chat-reach")
        under_way, done = moved.where("up is not null"), done.unionByName(moved.where("up is null"))
    return done, steps, None


def unique(tree: DataFrame) -> DataFrame:
    """One row for each (conv_id, msg_id)."""
    row = F.struct(F.col("parent_id").cast("long").alias("parent_id"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return tree.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(F.min(row).alias("row")).select("conv_id", "msg_id", "row.*")


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, rank, nth, msg_id): messages of the ``branches`` best root-to-leaf paths of each conversation, in order.

    ``tree`` has one row for each message (see ``unique``).
    """
    key = F.struct(F.col("conv_id").isNull().alias("z"), F.coalesce("conv_id", F.lit(0)).alias("c"))
    nodes = tree.select(key.alias("k"), "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("k", F.col("msg_id").alias("parent_id"), F.lit(1).alias("known"))
    nodes = nodes.join(known, ["k", "parent_id"], "left").select("k", "msg_id", F.when(F.col("known").isNotNull(), F.col("parent_id")).alias("up"), "score")
    nodes = common.saved(nodes, "chat-nodes")
    longest = nodes.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    reach, steps, circling = _reach(nodes, longest.bit_length() + 1)
    if circling is not None:
        roots = circling.where("up = low").select("k", F.col("up").alias("msg_id"), F.lit(True).alias("cut")).distinct()
        nodes = nodes.join(roots, ["k", "msg_id"], "left").select("k", "msg_id", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "score")
        nodes = common.saved(nodes, "chat-nodes")
        reach, steps, _ = _reach(nodes, longest.bit_length() + 1)
    parents = nodes.where("up is not null").select("k", F.col("up").alias("msg_id")).distinct()
    leaves = reach.join(parents, ["k", "msg_id"], "left_anti")
    if branches == 1:
        best = leaves.groupBy("k").agg(F.min(F.struct((-F.col("total")).alias("t"), "msg_id")).alias("b")).select("k", F.col("b.msg_id").alias("leaf"), F.lit(1).alias("rank"))
    else:
        order = Window.partitionBy("k").orderBy(F.col("total").desc(), "msg_id")
        best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("k", F.col("msg_id").alias("leaf"), "rank")
    marked = best.select("k", "rank", F.col("leaf").alias("msg_id"))
    for step in reversed(steps):
        marked = common.saved(marked.unionByName(marked.join(step, ["k", "msg_id"]).select("k", "rank", F.col("up").alias("msg_id"))), "chat-marked")
    depth = reach.select("k", "msg_id", "depth")
    return marked.join(depth, ["k", "msg_id"]).select(F.when(~F.col("k.z"), F.col("k.c")).alias("conv_id"), "rank", F.col("depth").alias("nth"), "msg_id")


_ROW = "conv_id long, rank int, formatted string, spans array<struct<a: int, b: int>>"


def format_paths(tree: DataFrame, branches: int = 1, is_unique: bool = False) -> DataFrame:
    """(conv_id, rank, formatted, spans): each chosen path as one conversation with its loss mask."""
    tree = tree if is_unique else unique(tree)
    chosen = paths(tree, branches)
    text = tree.select("conv_id", "msg_id", "role", "text")
    rows = chosen.join(text, _same(chosen, text) & (chosen["msg_id"] == text["msg_id"])).select(chosen["conv_id"], "rank", "nth", "role", "text")
    rows = rows.groupBy("conv_id", "rank").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column(2).to_pylist()]
            spans = pa.array([[{"a": a, "b": z} for a, z in s] for _, s in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f for f, _ in out], pa.string()), spans], ["conv_id", "rank", "formatted", "spans"])

    return rows.mapInArrow(run, _ROW)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and its loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["a"] : s["b"]]) for s in spans)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["conv_id", *names])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string")
    tree = common.saved(as_tree(turns.unionByName(more)), "chat-tree")
    return read_back(common.saved(format_paths(tree, is_unique=True), "chat-formatted"))
