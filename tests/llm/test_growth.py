"""Near-duplicate candidates that must not grow faster than the documents, and vectors whose comparing must stay cheap."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from fieldspark.llm import jaccard, vectors

from .test_advice import prose
from .test_llm import make


def test_passages_of_a_share_of_the_documents_make_no_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 6)
    rng = random.Random(5)
    passages = [prose(rng, 20) for _ in range(5)]
    docs = jaccard.keyed(make(spark, [f"{prose(rng, 60)} {passages[k % 5]} {prose(rng, 5)}" for k in range(1500)]))
    order = spark.sparkContext.broadcast(jaccard.frequent(docs))
    held = jaccard.prefixes(docs, order).groupBy("token").count()
    assert held.agg(F.max("count")).first()[0] < 40


def test_parities_tell_long_texts_apart(spark):
    rng = random.Random(6)
    texts = []
    for n in (3, 300, 1100, 3000, 4080, 9000):
        w = prose(rng, n).split()
        texts += [" ".join(w), " ".join([*w, *prose(rng, n // 8).split()]), " ".join([*w[: n * 2 // 3], *prose(rng, n // 3).split()])]
    docs = jaccard.keyed(make(spark, texts))
    rows = jaccard.described(docs, spark.sparkContext.broadcast(jaccard.frequent(docs)))
    pairs = rows.select("id", F.col("n").alias("un"), F.col("bits").alias("ub")).crossJoin(rows.select(F.col("id").alias("to"), F.col("n").alias("vn"), F.col("bits").alias("vb")))
    may = pairs.where(jaccard._sizes("un", "vn") & (9 * jaccard._apart("ub", "vb") <= F.col("un") + F.col("vn"))).select("id", "to").collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)}
    assert len(alike) > 26 and alike == set(map(tuple, may))


def test_a_block_of_vectors_costs_less_than_lookups_pair_by_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2048, 64))
    x[1024:1060] = x[:36] + 0.01 * rng.normal(size=(36, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = SimpleNamespace(value=vectors.train(x, 1))
    vec = pa.array(x.tolist(), pa.list_(pa.float64()))
    made = vectors._tiles(index, 64, np.sqrt(0.1))(iter([pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array([1] * 2048), vec], ["cid", "copies", "vec"])]))
    table = pa.Table.from_batches(made)
    # Half of the vectors are stored, the others probe.
    table = table.filter(pc.equal(table["stored"], pc.less(table["cid"], 1024)))

    def seconds(run):
        start = time.process_time()
        return run(), time.process_time() - start

    ix = index.value
    codes, err = ix.encode(x[:1024] - ix.centroids[0])

    def plain():
        for k in range(1024, 2048, 256):
            t, d = ix.tables(x[k : k + 256] - ix.centroids[0]).copy(order="C"), np.zeros((256, 1024))
            for m in range(8):
                d += t[m][:, codes[:, m]]
            np.nonzero(np.sqrt(d) <= np.sqrt(0.1) + err + 1e-6)

    block = vectors._block(index, 0.95)
    found = {r["cid"]: (r["links"], r["with"]) for r in block(table).to_pylist()}
    assert found == {i + 1024: (1, i) for i in range(36)}
    assert min(seconds(lambda: block(table))[1] for _ in range(5)) < 0.7 * min(seconds(plain)[1] for _ in range(5))


def test_a_vector_goes_to_a_group_of_lists_once(spark, monkeypatch):
    """Rows are not multiplied by the lists they probe, and passes over groups lose no link."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[3000:3500] = x[:500] + 0.02 * rng.normal(size=(500, 32)).astype(np.float32)
    monkeypatch.setattr(vectors, "PER_LIST", 60)
    monkeypatch.setattr(vectors, "BLOCK", 1000)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    index = SimpleNamespace(value=vectors.train(u, len(u)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array([1] * 6000), pa.array(list(x), pa.list_(pa.float32()))], ["cid", "copies", "vec"])
    made = sum(b.num_rows for b in vectors._tiles(index, 32, np.sqrt(0.1))(iter([batch])))
    probed = sum(map(len, index.value.probes(u, np.sqrt(0.1))[1]))
    assert len(index.value.centroids) == 100 and made - 6000 < 0.6 * probed
    monkeypatch.setattr(vectors, "PASS", 1)
    monkeypatch.setattr(vectors, "SHARE", 0.5)
    passes = []
    monkeypatch.setattr(vectors, "_dealt", lambda ix, a, b, real=vectors._dealt: passes.append((a, b)) or real(ix, a, b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    want = ((u @ u.T) >= vectors.COSINE).sum(1) - 1
    assert len(passes) > 2 and got == dict(enumerate(want.tolist())) and want.sum() >= 1000
