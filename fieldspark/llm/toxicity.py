"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed words it holds and the hashed first
``PREFIXES`` bytes of longer words (inflected forms share those), each counted
once, so that length does not dilute them.  The model is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part learns that an insult weighs more beside the mention of a
group.  The fit takes a bounded sample of labelled rows (``LIMIT``), keeps the
``TERMS`` terms most associated with the label by chi-square, and runs AdaGrad
on the logistic loss.  The model has a fixed size and goes to the tasks in the
function's closure; scoring is one pass without a shuffle.  The sample takes
at most half its rows from either class, so that rare kinds of toxic text are
seen; a score is thus the odds between classes of like size.

Edge cases: null and empty texts score what the bias says; without labels of
both kinds every score is the share of positives (0 without labels); a null
identifier is not held out; repeated rows are scored alike; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled, textvec

BITS = 18
LIMIT = 6_000
TERMS = 2048
PREFIXES = (4, 5, 6)
FACTORS = 8
THRESHOLD = 0.7


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and prefix, repeats included."""
    starts, ends, first = textvec.words(buf, offs, textvec.MARKS)
    sums, doc = textvec.prefix(textvec.fold(buf)), textvec.doc_of(first)
    docs, hashes = [doc], [textvec.span_hash(sums, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        docs.append(doc[long])
        hashes.append(textvec.mix(textvec.span_hash(sums, starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _extract(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return labelled.counted(*_features(buf, offs), BITS)


@dataclass
class Machine:
    """slot: term bucket -> row of w and v, or -1."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, bucket = _features(buf, offs)
        at = self.slot[bucket]
        hit = at >= 0
        doc, term, _ = labelled.counted(doc[hit], at[hit], 20)
        return _sigmoid(_raw(self.bias, self.w, self.v, doc, term, len(offs) - 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, x.shape[1]))
    if len(doc):
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[cut]] = np.add.reduceat(x, cut, axis=0)
    return out


def _raw(bias: float, w: np.ndarray, v: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    s = _sums(doc, v[term], n)
    q = _sums(doc, np.c_[w[term], (v[term] ** 2).sum(1)], n)
    return bias + q[:, 0] + 0.5 * ((s**2).sum(1) - q[:, 1])


def fit(y: np.ndarray, row: np.ndarray, term: np.ndarray, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Machine:
    n, pos = len(y), int(y.sum())
    slot = np.full(1 << BITS, -1, np.int16)
    prior = pos / n if n else 0.0
    empty = Machine(slot, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), np.zeros(1), np.zeros((1, FACTORS)))
    if not 0 < pos < n:
        return empty
    df = np.bincount(term, minlength=1 << BITS).astype(float)
    a = np.bincount(term, y[row], 1 << BITS)
    b, c = df - a, pos - a
    d = n - pos - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    keep = np.flatnonzero((df >= 2) & (chi > 6.63))
    keep = keep[np.lexsort((keep, -chi[keep]))][:TERMS]
    if not len(keep):
        return empty
    slot[keep] = np.arange(len(keep))
    t = slot[term]
    row, t = row[t >= 0], t[t >= 0].astype(np.int64)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(keep)), rng.normal(0, 0.05, (len(keep), FACTORS))
    bias, gb = empty.bias, 1e-6
    gw, gv = np.full(len(keep), 1e-6), np.full((len(keep), FACTORS), 1e-6)
    cut = np.searchsorted(row, np.arange(n + 1))
    size = min(256, max(16, n // 20))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, size):
            part = np.sort(order[k : k + size])
            lens = cut[part + 1] - cut[part]
            at = np.repeat(cut[part] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            doc, x = np.repeat(np.arange(len(part)), lens), t[at]
            s = _sums(doc, v[x], len(part))
            g = (_sigmoid(_raw(bias, w, v, doc, x, len(part))) - y[part]) / len(part)
            used, inv = np.unique(x, return_inverse=True)
            dw = np.bincount(inv, g[doc], len(used)) + decay * w[used] / 10
            each = g[doc][:, None] * (s[doc] - v[x])
            dv = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate / 4 * dv / np.sqrt(gv[used])
            bias -= rate * g.sum() / np.sqrt(gb)
    return Machine(slot, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Machine:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    rows = labelled.sample(docs, labels, "toxic", learn, limit, balanced=True)
    y, row, term, _ = labelled.terms(rows, _extract, counts=False)
    return fit(y, row, term)


def scorer(model) -> Column:
    """A column function of text for any model with score(buf, offs)."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for a, b, buf, offs in textvec.parts(text):
            out[a:b] = model.score(buf, offs)
        return pa.array(out)

    return score


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    return docs.withColumn("score", scorer(model)(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(scorer(model)(F.col("text").cast("string")) < THRESHOLD)
