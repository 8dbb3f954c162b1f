"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed words, lower-cased, hashed word shapes (runs of capitals,
small letters, digits and marks) and, for words that repeat the word before
them, terms for the length of the run so far by powers of two, weighted (1 + log count) * idf with document
frequencies counted over all documents.  A randomised SVD of a bounded sample
of labelled documents (``LIMIT``) gives the latent space; the sample's vectors
and labels are broadcast (LIMIT * RANK floats), as is the projection.  Every
document is projected, its cosines to all labelled vectors are one exact
matrix product for a block of documents, and the ``NEIGHBOURS`` most similar
vote with their similarity.

Edge cases: null and empty texts, and texts without a known term, score the
share of positives in the sample; without labels every score is 0; a null
identifier is not held out; equal similarities at the last place all count;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled, textvec, toxicity

BITS = 14
LIMIT = 4000
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_SHAPE = np.full(256, ord("m"), np.uint8)
_SHAPE[48:58] = ord("d")
_SHAPE[65:91] = ord("C")
_SHAPE[97:123] = ord("s")
_SHAPE[128:] = ord("s")
for _b in b"!#$%&*.,|<>{}@:/":
    _SHAPE[_b] = _b


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = textvec.words(buf, offs)
    doc = textvec.doc_of(first)
    word = textvec.span_hash(textvec.prefix(textvec.fold(buf)), starts, ends)
    kind = _SHAPE[buf]
    run = np.ones(len(buf), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[starts] = True
    # A word's shape: its classes with runs collapsed, hashed from the run starts alone.
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(run, out=at[1:])
    shape = textvec.span_hash(textvec.prefix(kind[run]), at[starts], at[ends])
    new = np.r_[np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]
    nth = np.arange(len(word)) - np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    again = np.flatnonzero(nth)
    level = np.frexp(nth[again].astype(float))[1].astype(np.uint64)
    h = np.concatenate([word, textvec.mix(shape + np.uint64(1)), textvec.mix(_AGAIN + level)])
    return labelled.counted(np.concatenate([doc, doc, doc[again]]), (h >> np.uint64(64 - BITS)).astype(np.int64), BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each term, documents), over the whole table; 2**BITS counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, buf, offs in textvec.parts(b.column(0)):
                df += np.bincount(_terms(buf, offs)[1], minlength=1 << BITS)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[hit, -1]), pa.array(np.r_[df[hit], n])], ["term", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def _rows_times(row: np.ndarray, term: np.ndarray, x: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Sparse (n rows of weights x at term) times dense m, by slices of rows."""
    out = np.zeros((n, m.shape[1]), np.float32)
    for k in range(0, len(row), 1 << 17):
        s = slice(k, k + (1 << 17))
        r = row[s]
        cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[cut]] += np.add.reduceat(m[term[s]] * x[s][:, None], cut, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Voter:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, term, n = _terms(buf, offs)
        x = ((1 + np.log(n)) * self.idf[term]).astype(np.float32)
        return _unit(_rows_times(doc, term, x, self.projection, len(offs) - 1))

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        q = self.project(buf, offs)
        out = np.full(len(q), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for s in range(0, len(q), 256):
            sim = q[s : s + 256] @ self.vectors.T
            last = np.partition(sim, -k, axis=1)[:, -k][:, None]
            w = np.where((sim >= last) & (sim > 0), sim, 0).astype(float)
            w **= 4  # nearer neighbours count for more
            total = w.sum(1)
            vote = w @ self.labels
            got = total > 0
            out[s : s + 256][got] = vote[got] / total[got]
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, rank: int = RANK, seed: int = 11) -> Voter:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; term statistics come from every document."""
    df, n_docs = document_frequencies(docs)
    idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)) + 0.1, 0).astype(np.float32)
    rows = labelled.sample(docs, labels, "quality", F.crc32(F.col("doc_id").cast("string")) % 5 != 0, limit)
    y, row, term, count = labelled.terms(rows, _terms)
    n, size = len(y), 1 << BITS
    if not n:
        return Voter(idf, np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.0)
    x = ((1 + np.log(count)) * idf[term]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, x.astype(float) ** 2, n))
    x = (x / np.where(norm > 0, norm, 1)[row]).astype(np.float32)
    order = np.lexsort((row, term))
    rank = min(rank, n)
    basis = np.random.default_rng(seed).normal(size=(size, rank + 8)).astype(np.float32)
    for _ in range(3):
        left = np.linalg.qr(_rows_times(row, term, x, basis, n))[0]
        basis = _rows_times(term[order], row[order], x[order], left, size)
    _, s, vt = np.linalg.svd(basis.T, full_matrices=False)
    projection = (vt[:rank].T / np.sqrt(np.maximum(s[:rank], 1e-6))).astype(np.float32)
    vectors = _unit(_rows_times(row, term, x, projection, n))
    return Voter(idf, projection, vectors, y.astype(float), float(y.mean()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = docs.select("doc_id", toxicity.scorer(Held(model))(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


class Held:
    """A broadcast model, used by tasks as if it were the model."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.broadcast.value.score(buf, offs)
