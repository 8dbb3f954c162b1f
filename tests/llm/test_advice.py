"""Cases that the operators once left out."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldspark.llm import chat, decontaminate, licenses, mixing, textvec, tokens, vectors

from . import brute
from .test_llm import make, prose


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1) + "x"
    return " ".join(w)


# ------------------------------------------------------------ pipeline: near copies


def test_near_duplicate_stage_groups_by_similarity(spark):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    for k in range(0, 30):
        n = len(texts[k].split())
        texts += [edited(rng, texts[k], c) for c in (1, max(1, n // 60), max(1, n // 40))]
    footer = " " + prose(rng, 30)
    texts += [prose(rng, 40) + footer for _ in range(20)] + [texts[50], texts[50] + " end", "", None, " ", "a b", "a  b"]
    s = [shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    edges = [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])]
    assert len(edges) > 60
    root = brute.components(len(s), edges)
    kept = stage(spark, make(spark, texts), "")
    assert kept.columns == make(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert stage(spark, make(spark, texts).where(F.lit(False)), "").count() == 0


# ------------------------------------------------------------ 3 vectors: links across many lists


def test_probes_find_every_link_of_low_dimensional_vectors():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 64)), rng.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ix = vectors.train(x, 400 * vectors.PER_LIST)
    assert len(ix.centroids) == 400
    home, probes = ix.probes(x, float(np.sqrt(2 - 2 * vectors.COSINE)))
    asked = np.zeros((len(x), len(ix.centroids)), bool)
    for i, p in enumerate(probes):
        asked[i, p] = True
    i, j = np.nonzero(np.triu(x @ x.T >= vectors.COSINE, 1))
    assert len(i) > 10_000 and (asked[i, home[j]] | asked[j, home[i]]).all()


# ------------------------------------------------------------ 9 decontamination: paraphrases


def test_no_window_that_meets_the_rule_is_lost(spark):
    rng = random.Random(14)
    items = [prose(rng, rng.randint(15, 60)) for _ in range(30)]
    texts = []
    for k, text in enumerate(items):
        for offset in range(8):
            w = [x if rng.random() > (0.15, 0.2, 0.25)[(k + offset) % 3] else prose(rng, 1) for x in text.split()]
            texts.append(" ".join([prose(rng, 40 + offset), *w, prose(rng, 60)]))
    sp = decontaminate.space(*decontaminate.sketch(make(spark, texts)))
    rows = spark.createDataFrame([(k, t, None if k % 5 else t.split()[0]) for k, t in enumerate(items)], "item_id long, text string, answer string").collect()
    search = decontaminate.Search(sp, decontaminate.items_of(rows, sp))
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    h, first = textvec.word_hashes(buf, offs, gaps=textvec.MARKS)
    want = [{} for _ in texts]
    for d in range(len(texts)):
        for item in search.items:
            blocks = -(-(first[d + 1] - first[d]) // decontaminate.UNIT)
            for b in range(max(1, blocks - item.units + 1)):
                search._check(want[d], item, h, int(first[d]) + b * decontaminate.UNIT, first, d)
    assert 60 < sum(map(len, want)) < 10 * len(texts)
    assert [set(x) for x in search.find(buf, offs)] == [set(x) for x in want]


# ------------------------------------------------------------ 5 licences: hard-wrapped notices

WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation.""",
}


def test_hard_wrapped_notices(spark):
    rng = random.Random(19)
    plain = [prose(rng, 12) + "\n" + prose(rng, 30) for _ in range(80)]
    texts, want = list(plain), [None] * len(plain)
    for family, notice in WRAPPED.items():
        for lead in ("", "# ", " * ", "// "):
            block = "\n".join(lead + x for x in notice.split("\n"))
            texts.append(f"{lead}{prose(rng, 6)}\n{lead.rstrip()}\n{block}\n\n{prose(rng, 30)}")
            want.append(family)
    docs = make(spark, texts)
    model = spark.sparkContext.broadcast(licenses.scanner(docs))
    got = {r["doc_id"]: [x["family"] for x in r["licences"]] for r in licenses.scanned(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == [[f] if f else [] for f in want]


# ------------------------------------------------------------ pipeline: one id, two groups


def test_a_repeated_id_keeps_a_row_of_each_group(spark):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rng = random.Random(22)
    a, b = prose(rng, 50), prose(rng, 50)
    kept = stage(spark, make(spark, [a, b, a + " end", b + " end"], [5, 5, 6, 7]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, a), (5, b)])


# ------------------------------------------------------------ 3 vectors: odd magnitudes


def test_tiny_and_huge_vectors_spoil_nothing(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    rows = [[float(v) for v in r] for r in np.concatenate([x, x * 1.0001, [[1e-170] * 8, [1e200] * 8, [5e-324] * 8, [1.0] * 8]])]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    u = np.array(rows)
    u = u / np.abs(u).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    root = brute.components(len(u), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, root[i]) for i in range(len(u))}


# ------------------------------------------------------------ 4 tokens: words that collide in a polynomial


def test_crafted_words_keep_their_own_ids():
    enc = tokens.Encoder(tokens.default_vocabulary())
    for n in (1024, 2048):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        for text in (a, b):
            raw = np.frombuffer(text.encode(), np.uint8)
            ids, _ = enc.encode(raw, np.array([0, len(raw)]))
            assert ids.tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, tokens.END_ID]


# ------------------------------------------------------------ 5 licences: two notices in a line


def test_two_licences_in_one_paragraph(spark):
    rng = random.Random(20)
    plain = [prose(rng, 12) + "\n" + prose(rng, 30) for _ in range(80)]
    texts = [*plain, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    docs = make(spark, texts)
    model = spark.sparkContext.broadcast(licenses.scanner(docs))
    got = {r["doc_id"]: sorted(x["family"] for x in r["licences"]) for r in licenses.scanned(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == [[]] * len(plain) + [["Apache-2.0", "MIT"], ["CC-BY-NC"]]


# ------------------------------------------------------------ 7 chat: circles, repeated ids, ties


def test_reply_trees_with_circles_and_repeats(spark):
    rows = [
        (1, 1, 2, 1.0, "user", "a"), (1, 2, 1, 1.0, "assistant", "b"),  # a circle of two
        (2, 1, 1, 0.0, "user", "self"),  # its own parent
        (3, 1, None, 0.0, "user", "q"), (3, 2, 1, 1.0, "assistant", "x"), (3, 3, 1, 1.0, "assistant", "y"),  # a tie
        (4, 1, None, 0.0, "user", "q"), (4, 2, 1, 1.0, "assistant", "z"), (4, 2, 1, 1.0, "assistant", "w"), (4, None, 1, 9.0, "user", "lost"),
        (5, 9, 7, 0.0, "user", "in"), (5, 7, 8, 0.0, "user", "c7"), (5, 8, 6, 0.0, "user", "c8"), (5, 6, 7, 0.0, "user", "c6"),  # a tail into a circle
    ]
    tree = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double, role string, text string")
    got = {r["conv_id"]: [t for _, t in chat.parse(r["formatted"])] for r in chat.format_paths(tree).collect()}
    assert got == {1: ["a", "b"], 2: ["self"], 3: ["q", "x"], 4: ["q", "w"], 5: ["c6", "c8", "c7", "in"]}
    assert chat.format_paths(tree.where("false")).count() == 0


# ------------------------------------------------------------ 8 mixing: copies, null ids, clashing names


def test_mixing_of_copies_and_null_ids(spark):
    rng = random.Random(31)
    a = [prose(rng, rng.randint(5, 30)) for _ in range(20)]
    texts = [*a, *[a[0]] * 30, *[prose(rng, 9) for _ in range(40)], "", None, None]
    ids = [*range(20), *[None] * 30, *range(20, 60), 60, None, None]
    sources = ["a"] * 50 + ["b"] * 20 + [None] * 20 + ["b", "b", "b"]
    docs = make(spark, texts, ids, sources).withColumnsRenamed({"lang": "times", "score": "copies"})
    size = [len((t or "").split()) for t in texts]
    of = Counter()
    for s, n in zip(sources, size, strict=True):
        of[s] += n
    want = brute.targets(list(of.items()))

    spark_docs = docs.select("doc_id", "text", "source")
    classes, pieces = mixing.mix(spark_docs, 16)
    taken = Counter({r["sid"]: r["n"] for r in pieces.groupBy("sid").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()})
    by_sid = {r["sid"]: r["source"] for r in classes.select("rid.sid", "source").distinct().collect()}
    assert classes.agg(F.sum("copies")).first()[0] == len(texts)
    assert all(abs(taken[k] - want[s]) <= 1 for k, s in by_sid.items())
    out = mixing.stage(spark, docs, "").collect()
    assert docs.columns == mixing.stage(spark, docs, "").columns
    got, rows = Counter(), Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    for r in out:
        got[r["source"]] += len((r["text"] or "").split())
    assert all(abs(got[s] - want[s]) <= max(size) for s in want), (got, want)
    had = Counter(zip(ids, texts, sources, strict=True))
    assert all(n <= 3 * had[k] for k, n in rows.items())


# ------------------------------------------------------------ 9 decontamination: short and long items


def test_items_of_every_length(spark):
    rng = random.Random(41)
    lengths = [*range(3, 13), 16, 24, 40, 64, 65, 66, 80, 130, 200, 300]
    items = [prose(rng, n) for n in lengths]
    noise = [prose(rng, 200) for _ in range(40)]
    whole = [" ".join([prose(rng, 37 + k % 8), t, prose(rng, 50)]) for k, t in enumerate(items)]
    half = [" ".join([prose(rng, 40), *t.split()[: len(t.split()) // 2], prose(rng, 400)]) for t in items]
    docs = make(spark, noise + whole + half)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["share"] for x in r["leaks"]} for r in decontaminate.matched(docs, bench).collect()}
    for k, n in enumerate(lengths):
        assert got[len(noise) + k].get(k, 0) == 1 or n > decontaminate.LONG and got[len(noise) + k].get(k, 0) >= 0.75
        if n >= 16:
            assert k not in got[len(noise) + len(items) + k]
