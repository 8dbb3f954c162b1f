"""Mixing sources to target weights with a low-discrepancy source schedule.

DataFrame functions only.  Source weights share the corpus' words; a source
gives its words three times at most, and what it cannot give is shared again
among the others by weight (water-filling over the source table).

Slots 0..N-1 stand for equal-token blocks.  Slot i maps the golden-ratio point
frac(i * phi) through the cumulative target shares to its source, so every
stretch of the schedule mixes the sources in proportion.  Slots are ranked
within their source, documents are laid out in a hashed (shuffled) order, and
the k-th slot of a source takes the k-th of its equal blocks of words; a
source that must give more than it has starts its order again.  Ranks and
layouts are prefix sums over bounded buckets, so a source that holds a third
of all rows or slots is spread over many tasks.  Rows equal in identifier,
source and text are one entry of a layout with a count, so they may number a
third of all rows too.

Edge cases: null text has no words; documents without words are reported
with 0 taken; a null source is a source of its own, last in order; repeated
rows are separate documents; a source without words has target 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
ROWS_PER_BUCKET = 4096
BINS = 4096
PHI = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, n_docs, source_size).

    One row a source: the windows below run over this aggregate, not over rows
    of documents.  Sources fill up in order of repeats * size / weight; the
    first that need not be capped fixes the level for all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * MAX_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    level = F.when(F.col("cap").cast("double") * F.col("open") > F.col("left").cast("double") * F.col("w"), F.struct("left", "open"))
    w = w.withColumn("at", F.first(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return w.select("source", "n_docs", "source_size", F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.col("at.left").cast("double") * F.col("w") / F.col("at.open")).alias("target"))


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """(slot, sid, k): slot by slot the source and the block of it that comes next.

    ``plan`` has one row a source: sid, quota (words to take), from/to (its
    part of the unit interval).  A source that no point hits gets one slot at
    the end.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("quota")).first()[0] or 0
    n = -(-total // block_words)
    point = F.lit(PHI) * F.col("slot")
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("bin", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = plan.where("quota > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * BINS).cast("int"), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)).cast("int"))))
    hit = slots.join(bins.select("bin", "sid", "lo", "hi"), "bin").where("u >= lo and u < hi").select("slot", "sid")
    hit = hit.withColumn("bucket", F.floor(F.col("slot") / ROWS_PER_BUCKET))
    counts = hit.groupBy("sid", "bucket").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("slot")) - 1)
    ranked = ranked.join(base.select("sid", "bucket", "base"), ["sid", "bucket"]).select("slot", "sid", (F.col("k") + F.col("base")).alias("k"))
    missed = plan.where("quota > 0").select("sid").join(counts.select("sid").distinct(), "sid", "left_anti")
    return ranked.unionByName(missed.select((F.col("sid") + n).alias("slot"), "sid", F.lit(0).cast("long").alias("k")))


SEED = 7


def _key(doc_id: Column, text: Column, source: Column) -> dict[str, Column]:
    """What the mix knows of a row, without nulls; rows equal in it are copies of one another."""
    return {
        "zd": doc_id.isNull(),
        "cd": F.coalesce(doc_id.cast("long"), F.lit(0)),
        "zs": source.isNull(),
        "cs": F.coalesce(source.cast("string"), F.lit("")),
        "h": F.xxhash64(F.lit(SEED), doc_id.cast("long"), text.cast("string")),
        "size": n_words(text.cast("string")),
    }


KEY = ["zd", "cd", "zs", "cs", "h", "size"]


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(classes, pieces).

    A class is a row with its copies, which lie one after another in its
    source's order: doc_id, source, the columns of KEY, copies, words (of all
    copies), source_size, target, quota and rid (its place).  Pieces: slot, sid, k, rid, epoch, first, last: words
    [first, last) of the class' copies go into the slot's block.
    """
    sized = docs.select(*[c.alias(n) for n, c in _key(F.col("doc_id"), F.col("text"), F.col("source")).items()])
    sized = common.saved(sized.groupBy(*KEY).agg(F.count("*").alias("copies")), "mix-sizes")
    source = F.when(~F.col("zs"), F.col("cs")).alias("source")
    per_source = sized.groupBy(source).agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_kinds"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = targets(per_source.drop("n_kinds")).join(per_source.select(F.col("source").alias("of"), "n_kinds"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    plan = plan.withColumns({"sid": F.row_number().over(by_name) - 1, "quota": F.round("target").cast("long"), "hi": share})
    plan = plan.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    plan = common.saved(plan.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi"))), "mix-plan")

    bucket = F.pmod(F.shiftrightunsigned("h", 16), F.greatest(F.ceil(F.col("n_kinds") / ROWS_PER_BUCKET), F.lit(1)))
    of = plan.select(F.col("source").isNull().alias("zs"), F.coalesce("source", F.lit("")).alias("cs"), "sid", "n_kinds", "source_size", "target", "quota")
    rows = sized.join(of, ["zs", "cs"]).withColumns({"bucket": bucket, "words": F.col("size") * F.col("copies")})
    sums = rows.groupBy("sid", "bucket").agg(F.sum("words").alias("all"))
    base = sums.withColumn("base", F.coalesce(F.sum("all").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = Window.partitionBy("sid", "bucket").orderBy("h", "zd", "cd", "size")
    within = nth.rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumns({"at": F.coalesce(F.sum("words").over(within), F.lit(0)), "nth": F.row_number().over(nth)})
    laid = laid.join(base.select("sid", "bucket", "base"), ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    laid = common.saved(laid.withColumn("rid", F.struct("sid", "bucket", "nth")).drop("bucket", "nth", "base", "n_kinds"), "mix-layout")

    slots = common.saved(schedule(plan, block_words), "mix-slots")
    n_slots = slots.groupBy("sid").agg(F.count("*").alias("n_slots"))
    blocks = plan.join(n_slots, "sid").select("sid", "n_slots")
    spans = laid.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    spans = spans.withColumns({"a": F.col("at") + F.col("epoch") * F.col("source_size")}).withColumn("b", F.least(F.col("a") + F.col("words"), F.col("quota"))).where("b > a")
    # Block k of a source is its words [ceil(k * quota / n), ceil((k+1) * quota / n)); decimals keep the products exact.
    block_of = lambda c: F.expr(f"cast(cast({c} as decimal(19,0)) * cast(n_slots as decimal(19,0)) div cast(quota as decimal(19,0)) as bigint)")
    edge = lambda c: F.expr(f"cast((cast({c} as decimal(19,0)) * cast(quota as decimal(19,0)) + cast(n_slots as decimal(19,0)) - 1) div cast(n_slots as decimal(19,0)) as bigint)")
    spans = spans.join(blocks, "sid").withColumn("k", F.explode(F.sequence(block_of("a"), block_of("(b - 1)"))))
    spans = spans.withColumns({"first": F.greatest("a", edge("k")), "last": F.least("b", edge("(k + 1)"))}).where("last > first")
    pieces = spans.join(slots, ["sid", "k"]).select("slot", "sid", "k", "rid", "epoch", (F.col("first") - F.col("a")).alias("first"), (F.col("last") - F.col("a")).alias("last"))
    named = {"doc_id": F.when(~F.col("zd"), F.col("cd")), "source": F.when(~F.col("zs"), F.col("cs"))}
    return laid.drop("at").withColumns(named), pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the contract's columns, first_slot (of its class; null if nothing is taken) and n_blocks it is cut into."""
    classes, pieces = mix(common.documents(spark, sf_dir))
    taken = pieces.groupBy("rid").agg(F.sum(F.col("last") - F.col("first")).alias("words_taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_blocks"))
    rows = classes.join(taken, "rid", "left").withColumn("t", F.coalesce("words_taken", F.lit(0)))
    # One row a copy; a class of many copies is dealt out in chunks first.
    step = F.lit(ROWS_PER_BUCKET).cast("long")
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    many = F.col("copies") > ROWS_PER_BUCKET
    rows = rows.where(~many).unionByName(rows.where(many).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid", "from"))
    rows = rows.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + step, "copies") - 1)))
    each = F.expr("if(words > 0, t div nullif(words, 0) * size + least(size, greatest(0, t % nullif(words, 0) - i * size)), 0)").cast("long")
    return rows.select("doc_id", "size", "source_size", "target", each.alias("taken"), "first_slot", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the schedule's slots.

    A whole time counts once, and a time of which at least half is taken once
    more.  A source's order is cut at one place, so its words stay within one
    document of the target.  Rows come back with the same columns; copies
    repeat rows.  Rows that agree in doc_id, source and text are copies of one
    another to the mix: where the cut falls between them, some of them are
    repeated once more than the others.
    """
    classes, pieces = mix(docs)
    turns = pieces.groupBy("rid", "epoch").agg(F.min("slot").alias("slot"), F.sum(F.col("last") - F.col("first")).alias("taken"))
    # For each time a class is passed: how many of its copies go along.
    passed = F.expr("cast(floor(taken / size + 0.5) as int)")
    turns = turns.join(classes, "rid").withColumn("n", passed).where("n > 0")
    turns = common.saved(turns.groupBy(*KEY, "copies").agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("turns")), "mix-turns")
    plain, back = common.renamed(docs)
    own = {c: F.col(common.own_name(docs, c)) for c in ("doc_id", "text", "source")}
    rows = plain.withColumns(_key(**own)).join(turns, KEY)
    # A cut between copies concerns one class a source at most: only those rows are numbered, by parts.
    cut = F.exists("turns", lambda t: t.n < F.col("copies"))
    every = rows.where(~cut).withColumn("i", F.lit(1).cast("long"))
    some = common.saved(rows.where(cut).withColumn("row", F.monotonically_increasing_id()), "mix-cut").withColumn("part", F.shiftright("row", 33))
    held = some.groupBy(*KEY, "part").agg(F.count("*").alias("held"))
    base = held.withColumn("base", F.coalesce(F.sum("held").over(Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    some = some.withColumn("i", F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("row"))).join(base.drop("held"), [*KEY, "part"])
    some = some.withColumn("i", F.col("i") + F.col("base"))
    both = every.unionByName(some.select(every.columns))
    dealt = both.withColumn("slot", F.explode(F.transform(F.filter("turns", lambda t: t.n >= F.col("i")), lambda t: t.slot)))
    # Slots hold equal words, so equal ranges of slots are equal parts.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = (turns.agg(F.max(F.element_at("turns", -1).slot)).first()[0] or 0) + 1
    part = F.floor(F.col("slot") * n / slots).cast("int")
    return back(dealt.repartitionById(n, part).sortWithinPartitions("slot", "h", "i"))


#: DuckDB SQL for the query.  The words taken are those of a contiguous stretch of each source's
#: hashed order, which SQL cannot reproduce without that hash; see tests/llm for the full check.
ORACLE = None
