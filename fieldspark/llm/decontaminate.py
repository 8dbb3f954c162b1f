"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of ``UNIT``-word blocks.  One pass over the corpus gathers
word counts and the sketch A'A * Omega of the TF-IDF passage matrix A (one
sum over tasks); a randomised Nystrom factorisation of the sketch gives the
leading singular directions, whitened so that common words do not drown rare
ones.  The weights come after the counts because the test matrix may absorb
them: with A = A0 W and W Omega = Omega0, the pass needs A0 alone.

A second pass takes its candidates from that space alone, by late interaction:
each word of the corpus scores for an item its greatest latent cosine to any of
the item's rarest words (to all its words, if it has an answer) where that is
``COSINE`` or more.  Windows of an item's own length, a block apart, are
candidates if the scores within the range of the check reach the number of words
that the rule below asks for; no other window is looked at.  A word has cosine 1
to itself, so what meets the rule reaches that number whatever the space, and
words near in meaning count beside it.  A candidate counts if the longest common
subsequence of words covers ``OVERLAP`` of the item within the window, and the
answer check holds: the item's answer occurs near the window or, for items
without an answer, most of the item's rarest words do.  Items are taken in batches of ``ITEMS`` so that
what a task holds is bounded.  An item is judged whole however long it is; of
one over ``LONG`` words the first window that meets the rule settles it.

Edge cases: null and empty texts match nothing; items without words are
ignored; an empty benchmark or corpus contaminates nothing; repeated rows are
judged alike; other columns are ignored; documents shorter than an item are
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

BITS = 13
RANK = 48
UNIT = 8
FIT_UNITS = 4
COSINE = 0.8
OVERLAP = 0.75
ANSWER = 0.6
ITEMS = 2048
LONG = 256
#: A cosine of 1 in the whole numbers that scores are summed in.
ONE = 64
#: Bytes of text worked on at once: its word vectors stay in a core's cache.
SLICE = 1 << 16


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.uint16)


def _test_matrix(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(1 << BITS, RANK)).astype(np.float32)


def _block_starts(first: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index at which each block starts, and each document's first block (n+1 entries); documents without words have none."""
    n = -(-np.diff(first) // unit)
    at = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(n)), n)
    return first[doc] + (np.arange(at[-1]) - at[doc]) * unit, at


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word counts by bucket, A0'A0 * Omega0) summed over all documents: 2**BITS * (RANK + 1) numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _test_matrix()
        total = np.zeros((1 << BITS, RANK + 1))
        for b in batches:
            for _, _, buf, offs in textvec.parts(b.column(0), SLICE):
                h, first = textvec.word_hashes(buf, offs, gaps=textvec.MARKS)
                if not len(h):
                    continue
                t = _bucket(h)
                starts, _ = _block_starts(first, UNIT * FIT_UNITS)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(t)]))
                y = np.add.reduceat(test[t], starts, axis=0)
                order = np.argsort(t, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(t[order]) != 0])
                own = t[order[cut]]
                total[own, :RANK] += np.add.reduceat(y[passage[order]], cut, axis=0)
                total[own, RANK] += np.diff(np.r_[cut, len(t)])
        for k in range(64):
            part = total[k :: 64]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_py(), np.float64) for x in table["sums"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "sums": pa.array([out.tobytes()], pa.binary())})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, sums binary")
    # Two levels, so that no task gathers a sum from every other.
    first = rows.withColumn("deal", (F.spark_partition_id() % 16)).groupBy("part", "deal").applyInArrow(add, "part int, sums binary")
    total = np.zeros((1 << BITS, RANK + 1))
    for r in first.groupBy("part").applyInArrow(add, "part int, sums binary").collect():
        total[r["part"] :: 64] = np.frombuffer(r["sums"], np.float64).reshape(-1, RANK + 1)
    return total[:, RANK], total[:, :RANK]


@dataclass
class Space:
    """idf by bucket and idf-weighted whitened directions: rows to sum over a passage's words."""

    idf: np.ndarray
    rows: np.ndarray


def space(counts: np.ndarray, sums: np.ndarray) -> Space:
    """Nystrom: A'A ~ B (Omega'B)^-1 B'; whitening divides by the singular values."""
    n = counts.sum()
    idf = np.where(counts > 0, np.log((1 + n) / (1 + counts)), np.log(1 + n))
    idf = np.maximum((idf / max(idf.max(), 1e-9)) ** 2, 1e-4)  # a test matrix divided by it must stay finite
    test = _test_matrix().astype(float)
    b = idf[:, None] * sums
    shift = 1e-7 * np.linalg.norm(b) + 1e-12
    omega = test / idf[:, None]
    core = omega.T @ b
    core = (core + core.T) / 2 + shift * np.eye(RANK)
    w, q = np.linalg.eigh(core)
    w = np.maximum(w, 1e-9 * w.max())
    f = b @ (q / np.sqrt(w)) @ q.T
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    keep = s > max(1e-4 * s[0], 1e-12)
    return Space(idf, (idf[:, None] * u[:, keep] / s[keep]).astype(np.float32))


def _word_list(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    h, _ = textvec.word_hashes(raw, np.array([0, len(raw)]), gaps=textvec.MARKS)
    return h, _bucket(h)


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    units: int
    rare: frozenset
    answer: tuple


def items_of(rows: list, sp: Space) -> list[Item]:
    out = []
    for r in rows:
        h, t = _word_list(r["text"] or "")
        answer = tuple(_word_list(r["answer"])[0].tolist()) if "answer" in r.asDict() and r["answer"] else ()
        if len(h):
            order = np.argsort(-sp.idf[t], kind="stable")[: max(1, len(h) // 3)]
            out.append(Item(r["item_id"], h, max(1, round(len(h) / UNIT)), frozenset(h[order].tolist()), answer))
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _directions(sp: Space) -> np.ndarray:
    """Each bucket's latent row at length 1; one that the corpus does not have takes its row of the test matrix."""
    x = np.zeros((1 << BITS, RANK), np.float32)
    x[:, : sp.rows.shape[1]] = sp.rows
    top = np.abs(x).max(1, keepdims=True)
    lost = ~(np.isfinite(top) & (top > 0))[:, 0]
    x[lost], top[lost] = _test_matrix()[lost], 1
    x /= top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearness(latent: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose greatest cosine to any of ``own`` is ``COSINE`` or more, and that cosine in parts of ``ONE``."""
    best = np.full(len(latent), -1, np.float32)
    for k in range(0, len(own), 256):
        np.maximum(best, (latent @ latent[own[k : k + 256]].T).max(1), out=best)
    near = np.flatnonzero(np.rint(best * ONE) >= COSINE * ONE)
    return near, np.rint(best[near] * ONE).astype(np.int64)


@dataclass
class Search:
    space: Space
    items: list[Item]

    def __post_init__(self) -> None:
        n = np.array([len(i.words) for i in self.items])
        share = np.array([OVERLAP * len(i.words) if i.answer else ANSWER * len(i.rare) for i in self.items])
        self.need = ONE * np.maximum(np.ceil(share - 1e-9).astype(np.int64), 1)
        self.slack = UNIT + n // 4
        self.units = np.array([i.units for i in self.items])
        latent = _directions(self.space)
        near = [_nearness(latent, np.unique(_bucket(i.words if i.answer else np.array(sorted(i.rare), np.uint64)))) for i in self.items]
        bucket = np.concatenate([b for b, _ in near])
        order = np.argsort(bucket, kind="stable")
        self.owner = np.repeat(np.arange(len(near)), [len(b) for b, _ in near])[order]
        self.score = np.concatenate([s for _, s in near])[order]
        self.entry = np.searchsorted(bucket[order], np.arange((1 << BITS) + 1))

    def candidates(self, h: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """item * (blocks + 1) + block, ascending, of every window whose range for the check scores what the rule needs."""
        t = _bucket(h).astype(np.int64)
        lo = self.entry[t]
        n = self.entry[t + 1] - lo
        pos = np.repeat(np.arange(len(h)), n)
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(pos))
        item = self.owner[entry]
        order = np.argsort(item, kind="stable")
        pos, item, score = pos[order], item[order], self.score[entry[order]]
        # From each scoring word, the first at which the sum is reached.
        total = np.cumsum(score)
        b = np.searchsorted(total, total - score + self.need[item])
        a = np.flatnonzero(b < len(pos))
        b = b[a]
        doc = textvec.doc_of(first)
        wide = self.units[item] * UNIT + 2 * self.slack[item]
        ok = (item[a] == item[b]) & (doc[pos[a]] == doc[pos[b]]) & (pos[b] - pos[a] < wide[a])
        k, d, p, q = item[a[ok]], doc[pos[a[ok]]], pos[a[ok]], pos[b[ok]]
        last = np.maximum(np.diff(at)[d] - self.units[k], 0)
        high = np.minimum((p - first[d] + self.slack[k]) // UNIT, last)
        low = np.maximum((q - first[d] - self.units[k] * UNIT - self.slack[k]) // UNIT + 1, 0)
        n = np.maximum(high - low + 1, 0)
        block = np.repeat(at[d] + low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.unique(np.repeat(k, n) * (at[-1] + 1) + block)

    def find(self, buf: np.ndarray, offs: np.ndarray) -> list[dict[int, float]]:
        """For each document: matched item -> share of the item found."""
        out: list[dict[int, float]] = [{} for _ in range(len(offs) - 1)]
        h, first = textvec.word_hashes(buf, offs, gaps=textvec.MARKS)
        if not len(h):
            return out
        starts, at = _block_starts(first, UNIT)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        for key in self.candidates(h, first, at).tolist():
            k, i = divmod(key, int(at[-1]) + 1)
            self._check(out[doc[i]], self.items[k], h, int(starts[i]), first, int(doc[i]))
        return out

    def _check(self, found: dict[int, float], item: Item, h: np.ndarray, start: int, first: np.ndarray, doc: int) -> None:
        n = len(item.words)
        if found.get(item.item_id, 0) >= (1 if n <= LONG else OVERLAP):
            return
        lo, hi = max(int(first[doc]), start - UNIT - n // 4), min(int(first[doc + 1]), start + item.units * UNIT + UNIT + n // 4)
        window = h[lo:hi].tolist()
        # The cheapest test first: it settles nearly all candidates that only sound alike.
        if not item.answer and len(item.rare.intersection(window)) < ANSWER * len(item.rare):
            return
        held, words = set(window), item.words.tolist()
        if sum(x in held for x in words) < OVERLAP * n:
            return
        share = lcs(words, window) / n
        if share < OVERLAP:
            return
        if item.answer:
            near = h[max(int(first[doc]), lo - 64) : min(int(first[doc + 1]), hi + 64)].tolist()
            if lcs(list(item.answer), near) < len(item.answer):
                return
        found[item.item_id] = max(found.get(item.item_id, 0), share)


def _batches(benchmark: DataFrame, size: int = ITEMS) -> Iterator[list]:
    """The benchmark's rows, ``size`` at a time; the driver never holds more than one batch."""
    cols = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    rows: list = []
    for r in benchmark.select(cols).where("item_id is not null and text is not null").toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def _matcher(search):
    @F.arrow_udf("array<struct<item_id: bigint, share: double>>")
    def matches(text: pa.Array) -> pa.Array:
        out: list = []
        for _, _, buf, offs in textvec.parts(text, SLICE):
            out += [[{"item_id": i, "share": s} for i, s in sorted(d.items())] for d in search.value.find(buf, offs)]
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))

    return matches


def matched(docs: DataFrame, benchmark: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with a column ``leaks``: the items found in each text and the share of each.

    The latent space is fitted to ``corpus`` (``docs`` if not given).
    """
    spark = docs.sparkSession
    out = docs.withColumn("leaks", F.array().cast("array<struct<item_id: bigint, share: double>>"))
    sp = None
    for rows in _batches(benchmark):
        sp = sp or space(*sketch(docs if corpus is None else corpus))
        items = items_of(rows, sp)
        if items:
            search = spark.sparkContext.broadcast(Search(sp, items))
            out = out.withColumn("leaks", F.concat("leaks", _matcher(search)(F.col("text").cast("string"))))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, items (sorted), best share."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x.item_id)))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("items"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x.share)), F.lit(0.0)).alias("share"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; columns and their names are untouched."""
    plain, back = common.renamed(docs)
    out = matched(plain.withColumn("text", F.col(common.own_name(docs, "text"))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(out.where(F.size("leaks") == 0))
