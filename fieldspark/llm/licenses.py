"""Licence scan by a trained paragraph classifier.

A text is cut into paragraphs (lines; a line of over ``LONG`` words also into
overlapping windows), and windows of ``WRAP`` words slide over adjacent lines,
so that hard-wrapped notices are met whole; lines without words, comment
leaders among them, part blocks.  A window across lines counts only where no
other hit of its family meets it.  A sparse logistic regression over hashed word one- and
two-grams gives each paragraph a probability for every licence family and for
the class of unknown text.  It learns from variations of the notices below and
from paragraphs of a bounded sample of documents (``SAMPLE``) as unknown text.
Probabilities are calibrated by a temperature fitted on held-out variations,
and the acceptance level is the least that lets through no held-out unknown
paragraph, 0.9 at most.  A prediction counts only if a notice of the same family is found
in the paragraph: the longest common subsequence of words covers ``COVER`` of
the notice.  What stands beside the notice is judged again, so a paragraph may
hold several licences.

Edge cases: null and empty texts hold no licence; an empty table gives an
empty result; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, textvec

BITS = 15
SAMPLE = 2000
LONG = 48
WRAP = 32
CONTEXT = 4
COVER = 0.75

# Customary short notices of public licence families.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is distributed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
}
#: Unknown text that shares words with notices.
NEAR_MISSES = [
    "All rights reserved.",
    "A driving license is required to rent a car.",
    "The license plate was found under the bridge.",
    "The general public is free to use the library from nine to five.",
    "Permission to enter the building is granted by the front desk.",
    "The apache helicopter landed at the base.",
    "He works at MIT on source code for robots.",
    "The terms of the contract were modified by both parties.",
    "This work was published by the foundation.",
    "The common creative attribution of the painting is disputed.",
]
FAMILIES = sorted(NOTICES)


def _paragraphs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word, end word and document of each paragraph, whether it is a window across lines)."""
    starts, ends, first = textvec.words(buf, offs, textvec.MARKS)
    h = textvec.span_hash(textvec.prefix(textvec.fold(buf)), starts, ends)
    doc = textvec.doc_of(first)
    lines = np.cumsum(buf == 10)
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, z, z, z, z.astype(bool)
    line = lines[starts]
    a = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    b = np.r_[a[1:], len(h)]
    step = LONG // 2
    n = np.where(b - a > LONG, -(-(b - a - LONG) // step) + 1, 1)
    of = np.repeat(np.arange(len(a)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    la, lb = a[of] + nth * step, np.minimum(a[of] + nth * step + LONG, b[of])
    # Blocks of adjacent lines: windows of WRAP words, a quarter apart, that cross a line's end.
    c = np.flatnonzero(np.r_[True, (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])])
    e = np.r_[c[1:], len(h)]
    step = WRAP // 4
    n = np.where(e - c > WRAP, -(-(e - c - WRAP) // step) + 1, 1)
    row = np.repeat(np.arange(len(c)), n)
    wa = c[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    wb = np.minimum(wa + WRAP, e[row])
    cross = line[wa] != line[wb - 1]
    wa, wb = wa[cross], wb[cross]
    return h, np.r_[la, wa], np.r_[lb, wb], np.r_[doc[a[of]], doc[wa]], np.r_[np.zeros(len(la), bool), np.ones(len(wa), bool)]


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word at, and of the two-gram that starts at, each position."""
    one = (h >> np.uint64(64 - BITS)).astype(np.int64)
    two = np.zeros(len(h), np.int64)
    if len(h) > 1:
        two[:-1] = (textvec.mix(h[:-1] * np.uint64(31) + h[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
    return one, two


@dataclass
class Scanner:
    weights: np.ndarray  # (2**BITS, families + 1); the last class is unknown text
    bias: np.ndarray
    temperature: float
    level: float
    notices: list[list[list[int]]]

    def logits(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, two = _grams(h)
        n = len(self.bias)
        sums = np.zeros((len(h) + 1, n))
        np.cumsum(self.weights[one], axis=0, out=sums[1:])
        out = sums[b] - sums[a]
        np.cumsum(self.weights[two], axis=0, out=sums[1:])
        out += sums[np.maximum(b - 1, a)] - sums[a]
        return out / np.sqrt(np.maximum(2 * (b - a) - 1, 1))[:, None] + self.bias

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, float]]]:
        found: list[list[tuple[str, float]]] = [[] for _ in range(len(offs) - 1)]
        h, a, b, doc, across = _paragraphs(buf, offs)
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        rest: list[tuple[int, int, int, bool]] = []
        # Lines and windows in parts of their own, each of a narrow range of words.
        lines = int((~across).sum())
        cuts = [*range(0, lines, 1 << 14), *range(lines, len(a), 1 << 14), len(a)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = int(a[s:e].min()), int(b[s:e].max())
            z = self.logits(h[lo:hi], a[s:e] - lo, b[s:e] - lo) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p[:, :-1].argmax(1)
            for i in np.flatnonzero(p[np.arange(e - s), best] >= self.level).tolist():
                at = taken.setdefault((int(doc[s + i]), int(best[i])), [])
                first, end = int(a[s + i]), int(b[s + i])
                if across[s + i] and any(first < y and x < end for x, y in at):
                    continue
                if span := self.confirmed(int(best[i]), h[first:end].tolist()):
                    at.append((first, end))
                    found[doc[s + i]].append((FAMILIES[best[i]], float(p[i, best[i]])))
                    sides = ((first, first + span[0]), (first + span[1], end))
                    rest += [(x, y, int(doc[s + i]), bool(across[s + i])) for x, y in sides if y - x > 1]
        # What is left of a paragraph beside a notice may hold another.
        while rest:
            x, y, d, wide = rest.pop()
            z = self.logits(h[x:y], np.array([0]), np.array([y - x]))[0] / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p[:-1].argmax())
            at = taken.setdefault((d, k), [])
            if p[k] < self.level or any(x < f and e < y and wide for e, f in at):
                continue
            if span := self.confirmed(k, h[x:y].tolist()):
                at.append((x, y))
                found[d].append((FAMILIES[k], float(p[k])))
                rest += [(a, b, d, wide) for a, b in ((x, x + span[0]), (x + span[1], y)) if b - a > 1]
        return found

    def confirmed(self, family: int, text: list[int]) -> tuple[int, int] | None:
        """The narrowest span of the paragraph, from its earliest end, that holds a notice of the family."""
        for t in self.notices[family]:
            best = decontaminate.lcs(t, text)
            if best < COVER * len(t):
                continue
            end = next(e for e in range(best, len(text) + 1) if decontaminate.lcs(t, text[:e]) == best)
            start = next(s for s in range(end - best, -1, -1) if decontaminate.lcs(t, text[s:end]) == best)
            return start, end
        return None


def _hashes(text: str) -> np.ndarray:
    return decontaminate._word_list(text)[0]


def _fit(x: list[np.ndarray], y: np.ndarray, classes: int, rng: np.random.Generator, epochs: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by AdaGrad with weight decay over normalised n-gram counts."""
    w, g = np.zeros((1 << BITS, classes)), np.full((1 << BITS, classes), 1e-6)
    bias, gb = np.zeros(classes), np.full(classes, 1e-6)
    grams = [np.concatenate([_grams(h)[0], _grams(h)[1][: max(len(h) - 1, 0)]]) for h in x]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), 128):
            part = order[s : s + 128]
            row = np.repeat(np.arange(len(part)), [len(grams[i]) for i in part])
            t = np.concatenate([grams[i] for i in part])
            v = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(part)), 1))[row]
            z = np.stack([np.bincount(row, w[t, c] * v, len(part)) for c in range(classes)], 1) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            used, inv = np.unique(t, return_inverse=True)
            d = np.stack([np.bincount(inv, p[row, c] * v, len(used)) for c in range(classes)], 1) / len(part) + 1e-5 * w[used]
            g[used] += d**2
            w[used] -= 0.3 * d / np.sqrt(g[used])
            db = p.sum(0) / len(part)
            gb += db**2
            bias -= 0.1 * db / np.sqrt(gb)
    return w, bias


def train(unknown: list[str], seed: int = 23) -> Scanner:
    """Fits on variations of the notices and on unknown paragraphs."""
    rng = np.random.default_rng(seed)
    other = [h for h in map(_hashes, [*unknown, *NEAR_MISSES * 20]) if len(h)]
    filler = np.concatenate(other) if other else np.zeros(1, np.uint64)
    x, y = [], []
    for k, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            h = _hashes(notice)
            for i in range(40):
                v = h[rng.random(len(h)) > (0.06 if i % 2 else 0)]
                around = [filler[rng.integers(len(filler), size=rng.integers(0, 12))] if i % 4 >= 2 else h[:0] for _ in range(2)]
                x.append(np.concatenate([around[0], v, around[1]]))
                y.append(k)
    x += other
    y = np.array(y + [len(FAMILIES)] * len(other))
    held = rng.random(len(x)) < 0.2
    w, bias = _fit([h for h, o in zip(x, held, strict=True) if not o], y[~held], len(FAMILIES) + 1, rng)
    s = Scanner(w, bias, 1.0, 0.5, [[_hashes(t).tolist() for t in NOTICES[f]] for f in FAMILIES])
    test = [h for h, o in zip(x, held, strict=True) if o]
    z = np.stack([s.logits(h, np.array([0]), np.array([len(h)]))[0] for h in test])
    truth = y[held]

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    s.temperature = min(np.geomspace(0.2, 5, 25), key=lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    top = probabilities(s.temperature)[truth == len(FAMILIES), :-1]
    s.level = float(np.clip(top.max() + 0.02 if len(top) else 0.5, 0.3, 0.9))
    s.weights = s.weights.astype(np.float32)
    return s


def scanner(docs: DataFrame, sample: int = SAMPLE) -> Scanner:
    """Trained with four paragraphs a document of ``sample`` documents as unknown text, both chosen by hash.

    Lines that hold a whole notice, alone or with the ``CONTEXT`` lines before and after, are not unknown and are left out.
    """
    known = [h for f in FAMILIES for h in (_hashes(t).tolist() for t in NOTICES[f])]
    # The order runs over identifiers alone; the texts of the chosen follow by a join with at most ``sample`` of them.
    ids = docs.where("text is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    lines = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.split("text", "\n").alias("ls"))
    rows = lines.select("ls", F.posexplode("ls").alias("i", "p")).where("p <> ''")
    around = F.concat_ws("\n", F.slice("ls", F.greatest(F.col("i") - CONTEXT, F.lit(0)) + 1, 2 * CONTEXT + 1))
    rows = rows.select("p", around.alias("around")).orderBy(F.xxhash64("p"), "p").limit(4 * sample).collect()

    def noticed(text: str) -> bool:
        h = _hashes(text).tolist()
        held = set(h)
        return any(sum(x in held for x in k) >= COVER * len(k) and decontaminate.lcs(k, h) >= COVER * len(k) for k in known)

    clean = sorted({r["p"] for r in rows} - {r["p"] for r in rows if noticed(r["around"])})
    return train(clean)


def scanned(docs: DataFrame, model) -> DataFrame:
    """``docs`` with a column ``licences``: (family, probability) of every confirmed paragraph."""

    @F.arrow_udf("array<struct<family: string, probability: double>>")
    def find(text: pa.Array) -> pa.Array:
        out: list = []
        for _, _, buf, offs in textvec.parts(text, 1 << 19):
            out += [[{"family": f, "probability": p} for f, p in found] for found in model.value.scan(buf, offs)]
        return pa.array(out, pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64())])))

    return docs.withColumn("licences", find(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, families (sorted), n_paragraphs with a licence, best probability."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = spark.sparkContext.broadcast(scanner(docs))
    out = scanned(docs, model)
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x.family)))
    return out.select("doc_id", families.alias("families"), F.size("licences").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform("licences", lambda x: x.probability)), F.lit(0.0)).alias("probability"))

