"""Candidates of decontamination come from the latent space and from nothing beside it."""

import random

import numpy as np

from fieldspark.llm import decontaminate

from .test_advice import prose
from .test_llm import make


def test_candidates_come_from_the_latent_space(spark, monkeypatch):
    rng = random.Random(23)
    items = [prose(rng, rng.randint(3, 60)) for _ in range(20)]
    docs = make(spark, [prose(rng, 80) for _ in range(30)] + [" ".join([prose(rng, 30), t, prose(rng, 30)]) for t in items])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: decontaminate.matched(docs, bench).where("size(leaks) > 0").count()
    assert found() == len(items)
    monkeypatch.setattr(decontaminate, "COSINE", 2)
    assert found() == 0


def words_of(text):
    h, _ = decontaminate._word_list(text)
    first = np.array([0, len(h)])
    return h, first, decontaminate._block_starts(first, decontaminate.UNIT)[1]


def test_words_near_in_the_latent_space_count(spark):
    noise = np.random.default_rng(2)
    item, like, other = (" ".join(f"{c}{k}" for k in range(24)) for c in "abc")
    rows = noise.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    (_, a), (_, b) = decontaminate._word_list(item), decontaminate._word_list(like)
    rows[b] = rows[a] + 0.2 * noise.normal(size=(len(a), decontaminate.RANK))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string").collect()
    sp = decontaminate.Space(np.ones(1 << decontaminate.BITS), rows)
    search = decontaminate.Search(sp, decontaminate.items_of(bench, sp))
    assert [len(search.candidates(*words_of(t))) > 0 for t in (item, like, other)] == [True, True, False]
    # Buckets that the corpus lacks keep a direction of their own, so their words are not lost.
    sp = decontaminate.Space(sp.idf, np.zeros_like(rows))
    search = decontaminate.Search(sp, decontaminate.items_of(bench, sp))
    assert [len(search.candidates(*words_of(t))) > 0 for t in (item, other)] == [True, False]
