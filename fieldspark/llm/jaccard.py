"""Exact word-shingle similarity for the near-duplicate stage of ``simhash``.

A document is its set of ``SHINGLE``-word shingles (words between white space,
capitals lowered); two documents link if the Jaccard similarity of their sets
is ``NUM / DEN`` or more.  Pairs at that limit differ in some ten of 64
SimHash bits, and a ball that wide has millions of variants, so the ball of
``simhash.links`` cannot meet them all.  This module checks the pairs that
collide there, and completes them by prefix filtering, which loses none: with
the tokens of all sets in one order, two such sets share a token among the
first n//5 + 1 of each.  The order puts shingles that are frequent in a sample
last, so that boilerplate makes no large buckets.  The sample is a share of all
documents: one of fixed size would miss passages that a fixed share of the
documents has, and their buckets grow with the input.

Equal sets collapse to a class first.  The first round checks SimHash
collisions and, in every bucket of a token, each class against one head: the
class with the fewest rarer tokens, so the one with the fewest edits of its own.
Further rounds draw other heads for the buckets of ``DENSE`` classes or more
that still hold several groups, as long as a round still joins groups; the last
checks every pair left of different groups.  So a large group is joined by a few
comparisons a class, not by all its pairs.  Buckets are aggregates and joins,
never one task's rows.  A pair must meet at the token that is first in both (the
smaller set's first n//9 + 1 are enough, by its size), and sets whose parities
by buckets differ in more bits than alike sets have tokens apart cannot be
alike.  A set has at least as many parities as tokens (``BITS`` at least), or
long texts would differ in too few to tell; of two widths the wider is folded.
The exact similarity of the texts decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textvec

SHINGLE = 5
NUM, DEN = 4, 5
SAMPLE = 4096
SHARE = 1 / 16
COMMON = 3
BITS = 1024
COMMON_MAX = 1 << 20
DENSE = 128
ROUNDS = 2
FOLD = [f"b{k}" for k in range(4)]
TOP = np.uint64(1 << 63)
KEY = ["gone", "id", "th"]


def shingle_sets(column: pa.Array, order: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's set of tokens, ascending.

    A token is a shingle's hash without its last bit; the tokens in ``order``,
    rarest first, are replaced by their place behind all others.
    """
    by = np.argsort(order)
    known = order[by]
    for _, _, buf, offs in textvec.parts(column, 1 << 19):
        h, first = textvec.word_hashes(buf, offs)
        runs = [h]
        for k in range(1, SHINGLE):
            last = runs[-1]
            runs.append(textvec.mix(last[:-1] * np.uint64(31) + h[k:]) if len(last) > 1 else last[:0])
        runs = [r >> np.uint64(1) for r in runs]
        if len(known):
            full = runs[-1]
            at = np.minimum(np.searchsorted(known, full), len(known) - 1)
            runs[-1] = np.where(known[at] == full, TOP | by[at].astype(np.uint64), full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            yield np.unique(runs[-1][a : b - SHINGLE + 1]) if n >= SHINGLE else runs[n - 1][a : a + 1] if n else h[:0]


def _sig(s: np.ndarray) -> int:
    return int(textvec.mix(s).sum(dtype=np.uint64).view(np.int64))


def _simhash(s: np.ndarray) -> int:
    """SimHash of a set of tokens, one vote each."""
    votes = np.unpackbits(textvec.mix(s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(s), bitorder="little").view(np.int64)[0])


def _parities(s: np.ndarray) -> np.ndarray:
    """Whether each of a power of two of buckets, as many as tokens or more, holds an odd number of the set's tokens, 64 to a word."""
    width = max(BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITS
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of KEY, which tell rows apart by identifier and text."""
    key = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    return docs.withColumns(dict(zip(KEY, key, strict=True)))


def described(docs: DataFrame, order) -> DataFrame:
    """KEY, sig (a hash of the set), n (its size), fp (its SimHash), bits (parities of its tokens by bucket) and their folds of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, n, fp, bits, folds = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(b.column(3), order.value):
                sig.append(_sig(s))
                n.append(len(s))
                fp.append(_simhash(s))
                bits.append(_parities(s))
                folds.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, len(FOLD))))
            ends = pa.array(np.cumsum([len(x) for x in bits], dtype=np.int32))
            cols = [pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits)))]
            cols += [pa.array(x) for x in np.concatenate(folds).reshape(-1, len(FOLD)).T.copy()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], [*KEY, "sig", "n", "fp", "bits", *FOLD])

    return docs.select(*KEY, F.col("text").cast("string")).mapInArrow(run, "gone boolean, id long, th long, sig long, n int, fp long, bits array<long>, " + ", ".join(f"{f} long" for f in FOLD))


def prefixes(docs: DataFrame, order) -> DataFrame:
    """(token, pos, sig, n): the first n//5 + 1 tokens of every set, once for each set that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(0), order.value):
                sig = _sig(s)
                if sig not in seen and len(s):
                    seen.add(sig)
                    rows.append((s[: len(s) // DEN + 1], sig, len(s)))
            if rows:
                k = np.array([len(r[0]) for r in rows])
                pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                cols = [np.concatenate([r[0] for r in rows]).view(np.int64), pos.astype(np.int32), np.repeat(np.array([r[1] for r in rows], np.int64), k), np.repeat(np.array([r[2] for r in rows], np.int32), k)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["token", "pos", "sig", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, pos int, sig long, n int")


def frequent(docs: DataFrame) -> np.ndarray:
    """Tokens that ``COMMON`` or more of a sample hold, rarest first, ``COMMON_MAX`` at most.

    The sample is ``SHARE`` of the documents or some ``SAMPLE`` of them, whichever is more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(0), np.zeros(0, np.uint64)))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    share = max(SHARE, SAMPLE / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.hash("th"), F.lit(1 << 20)) < share * (1 << 20))
    texts = drawn.select("th", F.col("text").cast("string").alias("text")).dropDuplicates(["th"]).select("text")
    seen = texts.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = seen.orderBy(F.desc("n"), "token").limit(COMMON_MAX).select("token").toArrow()
    return rows["token"].to_numpy()[::-1].copy().view(np.uint64)


def alike(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> common.Saved:
    """The pairs (u, v) of classes whose exact similarity is NUM / DEN or more."""
    for k in "uv":
        pairs = pairs.join(classes.select(F.col("sig").alias(k), F.col("n").alias(f"{k}n"), F.col("bits").alias(f"{k}b")), k)
    pairs = common.Saved(pairs.where(_sizes("un", "vn") & ((DEN + NUM) * _apart("ub", "vb") <= (DEN - NUM) * (F.col("un") + F.col("vn")))).select("u", "v"), "jaccard-pairs")
    ends = pairs.df.select(F.col("u").alias("sig")).unionByName(pairs.df.select(F.col("v").alias("sig"))).distinct()
    reps = classes.join(ends, "sig", "left_semi").select("sig", *KEY)
    # Rows of one key have one text; a hash that two texts share would only cost the second its check.
    texts = common.Saved(docs.select(*KEY, F.col("text").cast("string").alias("text")).join(reps, KEY).select("sig", "text").dropDuplicates(["sig"]), "jaccard-texts")
    both = pairs.df.join(texts.df.select(F.col("sig").alias("u"), F.col("text").alias("a")), "u").join(texts.df.select(F.col("sig").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for r in batches:
            held = []
            for a, b in zip(shingle_sets(r.column(2), none), shingle_sets(r.column(3), none), strict=True):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                held.append(DEN * shared >= NUM * (len(a) + len(b) - shared))
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(keep), r.column(1).filter(keep)], ["u", "v"])

    out = common.Saved(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "jaccard-links")
    pairs.drop()
    texts.drop()
    return out


def _sizes(a: str, b: str) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _apart(a: str, b: str) -> Column:
    """Parities that differ.  Widths of sets that may be alike differ by 2 at most, and the wider is folded; others give any number or null."""
    k = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) > k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _near(a: str, b: str) -> Column:
    """Whether folded parities allow two sets to be alike: folding only joins buckets, so the bound holds."""
    apart = sum((F.bit_count(F.col(a + f).bitwiseXOR(F.col(b + f))) for f in FOLD), F.lit(0))
    return (DEN + NUM) * apart <= (DEN - NUM) * (F.col(a + "n") + F.col(b + "n"))


def _rest(open_: DataFrame) -> DataFrame:
    """Pairs (u, v) of one bucket and different groups that sizes, parities and the positions of their token allow."""
    # Sizes of a pair are within a quarter, so a set meets its own class of sizes and the one below (two, as logarithms are rounded).
    width = F.floor(F.log(F.col("n")) / math.log(DEN / NUM)).cast("int")
    names = ["sig", "n", "pos", "root", *FOLD]
    small = open_.where(F.col("pos") <= F.expr(f"n div {DEN + NUM}")).select("token", width.alias("w"), *[F.col(c).alias("x" + c) for c in names])
    large = open_.select("token", F.explode(F.array(width, width - 1, width - 2)).alias("w"), *[F.col(c).alias("y" + c) for c in names])
    pairs = small.join(large, ["token", "w"]).where(F.struct("xn", "xsig") < F.struct("yn", "ysig"))
    left = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))
    fits = (DEN + NUM) * left >= NUM * (F.col("xn") + F.col("yn"))
    return pairs.where((F.col("xroot") != F.col("yroot")) & (DEN * F.col("xn") >= NUM * F.col("yn")) & fits & _near("x", "y")).select(*_ordered(F.col("xsig"), F.col("ysig"))).distinct()


def _drawn(open_: DataFrame, nth: int) -> DataFrame:
    """Pairs (u, v) of a class and the head that round ``nth`` draws for its bucket of ``DENSE`` or more, where their groups differ."""
    own = F.struct(F.xxhash64(F.lit(nth), "token", "sig").alias("h"), *[F.col(c).alias("x" + c) for c in ("sig", "n", "root", *FOLD)])
    head = open_.groupBy("token").agg(F.min(own).alias("head")).select("token", "head.*").drop("h")
    met = open_.join(head, "token").where(F.col("root") != F.col("xroot"))
    met = met.withColumnsRenamed({c: "y" + c for c in ("sig", "n", *FOLD)})
    return met.where(_sizes("xn", "yn") & _near("x", "y")).select(*_ordered(F.col("xsig"), F.col("ysig"))).distinct()


def grouped(docs: DataFrame, rows: DataFrame, order, collisions) -> DataFrame:
    """(sig, root) of every class of ``rows`` that has a link.

    ``collisions`` gives the links (u, v) of a table of distinct fingerprints.
    """
    least = F.min(F.struct(*KEY)).alias("rep")
    classes = rows.groupBy("sig").agg(least, *[F.first(k).alias(k) for k in ("n", "fp", "bits", *FOLD)])
    classes = common.Saved(classes.select("sig", "rep.*", "n", "fp", "bits", *FOLD), "jaccard-classes")
    c = classes.df
    # SimHash: the least class of a fingerprint meets the fingerprint's others, and those of fingerprints within the radius.
    heads = common.Saved(c.groupBy("fp").agg(F.min("sig").alias("head")), "jaccard-heads")
    own = c.join(heads.df, "fp").where("sig <> head").select(*_ordered(F.col("head"), F.col("sig")))
    near = collisions(heads.df.select("fp"))
    near = near.join(heads.df.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.df.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    met = common.Saved(own.unionByName(near.select(*_ordered(F.col("a"), F.col("b")))), "jaccard-met")
    heads.drop()
    # Prefix filtering.
    tokens = common.Saved(prefixes(docs, order), "jaccard-tokens")
    least = tokens.df.groupBy("token").agg(F.min(F.struct("pos", "sig")).alias("least"), F.count("*").alias("held")).where("held > 1").select("token", F.col("least.sig").alias("head"))
    near = common.Saved(tokens.df.join(least, "token"), "jaccard-buckets")
    tokens.drop()
    star = near.df.where("sig <> head").select(*_ordered(F.col("head"), F.col("sig")))
    first = common.Saved(star.unionByName(met.df).distinct(), "jaccard-first")
    met.drop()
    links = alike(first.df, docs, c).df
    first.drop()
    for nth in range(ROUNDS):
        roots = common.components(links, "jaccard").select(F.col("node").alias("sig"), "root")
        rooted = near.df.select("token", "pos", "sig", "n").dropDuplicates(["token", "sig"]).join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        rooted = common.Saved(rooted, "jaccard-rooted")
        mixed = rooted.df.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).where("lo <> hi")
        mixed = common.Saved(mixed.select("token", "held"), "jaccard-mixed")
        open_ = rooted.df.join(mixed.df, "token").join(c.select("sig", *FOLD), "sig")
        open_ = common.Saved(open_, "jaccard-open")
        dense = mixed.df.where(F.col("held") >= DENSE).limit(1).count()
        mixed.drop()
        rooted.drop()
        near.drop()
        near = open_  # groups only grow, so a bucket of one group stays settled
        if not dense:
            break
        more = alike(common.saved(_drawn(open_.df.where(F.col("held") >= DENSE), nth), "jaccard-drawn"), docs, c).df
        if not more.limit(1).count():
            break
        links = common.saved(links.unionByName(more), "jaccard-links")
    rest = common.Saved(_rest(near.df), "jaccard-rest")
    near.drop()
    links = links.unionByName(alike(rest.df, docs, c).df)
    rest.drop()
    return common.components(links, "jaccard").select(F.col("node").alias("sig"), "root")
