"""The training-data operators against brute force, with the edge cases each must survive."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import chat, common, decontaminate, labelled, licenses, mixing, quality, simhash, suffixes, textvec, tokens, toxicity, vectors

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ti", "or", "es", "ba", "qu", "lo", "ré"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    shared = prose(rng, 60)
    out = list(base)
    out += [base[3]] * 12 + [base[5].upper(), base[5] + " end", "x " + base[7]]
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(6)]
    out += ["", None, " \n\t ", "one", "one two", "A" * 900, "ab " * 400, shared + " " + shared]
    return out


# ------------------------------------------------------------ shared pieces


def test_word_hashes_do_not_depend_on_place():
    texts = ["alpha beta", "", "beta alpha  beta", "É é"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    h, first = textvec.word_hashes(buf, offs)
    assert first.tolist() == [0, 2, 2, 5, 7]
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 3


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 420)] + [(500, k) for k in range(501, 560)]
    want = brute.components(560, edges)
    df = spark.createDataFrame(edges + [(7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert common.components(df.where("u < 0")).count() == 0


# ------------------------------------------------------------ 1 SimHash


def test_simhash(spark, corpus):
    f = [brute.fingerprint(t) for t in corpus]
    edges = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    root = brute.components(len(f), edges)
    rows = simhash.near_duplicates(make(spark, corpus)).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r["fingerprint"] == f"{f[r['doc_id']]:016x}" and r["component_id"] == root[r["doc_id"]]


def test_simhash_ball_finds_every_pair_within_two_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ m for b in base for m in [0, *[1 << rng.randrange(64) for _ in range(20)], *[1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in range(20)]]}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2])
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    at = {x: i for i, x in enumerate(fps)}
    assert brute.components(len(fps), [(at[r["u"]], at[r["v"]]) for r in links]) == want
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)


def test_simhash_stage_and_odd_rows(spark, corpus):
    texts, ids = [*corpus, corpus[0], "lonely words here", None], [*range(len(corpus)), 0, None, None]
    sets = [brute.shingles(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = set(brute.components(len(texts), edges))
    docs = make(spark, texts, ids).withColumnsRenamed({"lang": "sig", "score": "nth", "size": "id"})
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(g for g in groups if g < len(corpus))
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["lonely words here"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0 == simhash.stage(spark, docs.where("false"), "").count()


# ------------------------------------------------------------ 2 toxicity


def test_factorization_machine_learns_pairs():
    """The label is the product of two terms: no additive model separates it."""
    rng = np.random.default_rng(0)
    a, b = rng.random(1200) < 0.5, rng.random(1200) < 0.5
    y = (a & b).astype(int)
    row, term = [], []
    for i in range(1200):
        own = [x for x, on in ((1, a[i]), (2, b[i])) if on] + rng.integers(10, 60, 4).tolist()
        row += [i] * len(set(own))
        term += sorted(set(own))
    m = toxicity.fit(y, np.array(row), np.array(term))
    doc, t = np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2])
    p = toxicity._sigmoid(toxicity._raw(m.bias, m.w, m.v, doc, m.slot[t].astype(int), 3))
    assert p[2] > 0.9 and p[0] < 0.2 and p[1] < 0.2


def labelled_corpus(spark, n=600):
    rng = random.Random(5)
    texts, y = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        t = prose(rng, rng.randint(5, 80)).split()
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["idiotic", "moronic", "scummy"]))
        texts.append(" ".join(t))
        y.append(int(bad))
    docs = make(spark, [*texts, "", None], list(range(n)) + [n, None])
    labels = spark.createDataFrame([(i, 1 - v, v) for i, v in enumerate(y)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, y


def test_toxicity_held_out(spark, tmp_path):
    docs, labels, y = labelled_corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(y) + 2
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    right = [r["predicted"] == y[r["doc_id"]] for r in held if r["doc_id"] < len(y)]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.scored(docs, none).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.scored(docs.where("false"), none).count() == 0


# ------------------------------------------------------------ 3 vectors


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 16))
    x = np.concatenate([centers[k][None] + rng.normal(size=(c, 16)) * 0.15 for k, c in enumerate([40, 25, *[3] * 58])])
    x = np.concatenate([x, x[:30], x[:5] * 7.5])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    rows += [(len(x) + k, v, 1) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.95
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    root = brute.components(len(x), list(zip(*np.nonzero(s), strict=True)))
    links = s.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert len(got) == len(rows) and (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert [got[len(x) + k]["n_links"] for k in range(7)] == [0, 0, 0, 0, 0, 1, 1]
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_product_codes_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ix = vectors.train(x, 3000)
    home, _ = ix.nearest(x)
    codes, err = ix.encode(x - ix.centroids[home])
    own = np.flatnonzero(home == home[0])
    q = x[:50]
    t = ix.tables(q - ix.centroids[home[0]])
    d = sum(t[m][:, codes[own, m]] for m in range(codes.shape[1]))
    real = np.linalg.norm(q[:, None] - x[own][None], axis=2)
    assert (np.sqrt(d) <= real + err[own] + 1e-9).all()


# ------------------------------------------------------------ 4 token shards


def test_tokens(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_vocabulary())
    texts = [*corpus, "don't STOP İstanbul ﬁn e\u0301 日本語 <|endoftext|> a\x85b a\x1cb", "x" * 5000, "word " * 3000]
    ids = list(range(100, 100 + len(texts)))
    rows = sorted(tokens.encode_table(spark, make(spark, texts, ids)).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, texts, strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        raw = np.array(want, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(raw))
        start += len(want)


def test_tokens_odd_rows(spark):
    docs = make(spark, ["b", "a", "c", None], [5, 5, None, -7])
    rows = sorted(tokens.encode_table(spark, docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -7, 5, 5] and rows[1]["n_tokens"] == 1
    assert tokens.encode_table(spark, docs.where("false")).count() == 0


def test_shard_lookup():
    rng = random.Random(0)
    want = {k: np.array([rng.randrange(49408) for _ in range(rng.randrange(3000))], np.uint32) for k in sorted(rng.sample(range(-(10**6), 10**6), 300))}
    out = io.BytesIO()
    w = tokens.Writer(out, 2)
    for k, v in want.items():
        w.add(tokens.key_of(k), v)
    w.close()
    r = tokens.Reader(io.BytesIO(out.getvalue()))
    assert len(r.index) > 3 and r.n_docs == 300
    assert [tokens.id_of(k) for k, _ in r] == list(want)
    assert all((r.get(tokens.key_of(k))[0] == v).all() for k, v in want.items())
    missing = [k for k in range(1000) if k not in want]
    assert not any(r.get(tokens.key_of(k)) for k in missing)
    with pytest.raises(ValueError):
        tokens.Reader(io.BytesIO(bytes(100)))


# ------------------------------------------------------------ 5 licences


def test_licences(spark):
    rng = random.Random(9)
    plain = [prose(rng, 40) + "\n" + prose(rng, 30) for _ in range(80)]
    mine = [prose(rng, 20) + "\n" + n + "\n" + prose(rng, 10) for f in licenses.FAMILIES for n in licenses.NOTICES[f]]
    want = [f for f in licenses.FAMILIES for _ in licenses.NOTICES[f]]
    docs = make(spark, [*plain, *mine, "", None, "A driving license is required to rent a car."])
    model = spark.sparkContext.broadcast(licenses.scanner(docs))
    got = {r["doc_id"]: {x["family"] for x in r["licences"]} for r in licenses.scanned(docs, model).collect()}
    assert not any(got[i] for i in [*range(len(plain)), *range(len(plain) + len(mine), len(got))])
    hit = [want[k] in got[len(plain) + k] for k in range(len(mine))]
    assert sum(hit) / len(hit) > 0.9
    assert licenses.scanned(docs.where("false"), model).count() == 0


# ------------------------------------------------------------ 6 quality


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(6)
    good = [prose(rng, rng.randint(20, 80)) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in prose(rng, 40).split()) for _ in range(100)]
    texts = [*good, *junk, "", None]
    make(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = quality.query(spark, str(tmp_path)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(rows) == 402 and sum(r["predicted"] == (r["doc_id"] < 300) for r in held) / len(held) > 0.97
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    df, n = quality.document_frequencies(docs)
    assert n == 402 and df.max() <= 402
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert (none.score(np.zeros(0, np.uint8), np.zeros(2, np.int64)) == 0).all()


# ------------------------------------------------------------ 7 chat


@pytest.mark.parametrize("text", ["", "a", "\\", "<|im_end|>", "\\<|", "<\\|", "\\n<|im_start|>assistant\nx<|im_end|>\n", "<" * 5 + "|" * 3, "\\\\<|<|\\"])
def test_escape_is_reversible(text):
    turns = [("user", text), ("assistant", text), ("we<|ird\nrole\\", text + "tail")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", None), (2, 0, None, "solo"), (None, 5, "user", "n"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, None, "system", "first")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    by = {}
    for r in [*rows, (-1, 0, "user", chat.CONTROL_TURN), (-1, 1, "assistant", chat.CONTROL_TURN)]:
        by.setdefault(r[0], []).append(r)
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    """Two branches and a lone root; paths are ranked by their summed score."""
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 1.0), (1, 5, 4, 9.0), (1, 6, 3, 1.0), (1, 7, 3, 0.5), (2, 1, 99, 1.0)]
    tree = spark.createDataFrame([(*r, "user", f"m{r[1]}") for r in rows], "conv_id long, msg_id long, parent_id long, score double, role string, text string")
    got = {}
    for r in chat.paths(tree, branches=2).collect():
        got.setdefault((r["conv_id"], r["rank"]), []).append((r["nth"], r["msg_id"]))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == {(1, 1): [1, 2, 4, 5], (1, 2): [1, 3, 6], (2, 1): [1]}
    assert chat.format_paths(tree.where("false")).count() == 0


# ------------------------------------------------------------ 8 mixing


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_mixing(spark, block):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(400)] + ["", None, " \t"]
    sources = [rng.choice(["hot"] * 8 + ["b", "tiny", "Z", "é", None]) for _ in texts]
    sources[3:6] = ["once", "once", "empty"]
    texts[5] = ""
    docs = make(spark, texts, sources=sources)
    per_doc, pieces = mixing.mix(docs, block)
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len((t or "").split())
    want = brute.targets(list(size.items()))
    taken = pieces.groupBy("rid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    rows = per_doc.join(taken, "rid", "left").na.fill(0, ["taken"]).collect()
    assert len(rows) == len(texts)
    got = Counter()
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert pieces.where("first < 0 or last <= first").count() == 0
    per_slot = pieces.groupBy("slot").agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.countDistinct("sid").alias("s"))
    assert per_slot.where("s <> 1").count() == 0


def test_mixing_stage(spark):
    rng = random.Random(3)
    docs = make(spark, [prose(rng, 30) for _ in range(120)], sources=["a"] * 60 + ["b"] * 40 + ["c"] * 20)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 20) <= 1 and abs(n["b"] - 40) <= 1 and abs(n["c"] - 60) <= 1
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.stage(spark, docs, "").collect()))
    assert mixing.stage(spark, docs.where("false"), "").count() == 0


# ------------------------------------------------------------ 9 decontamination


def test_lcs():
    assert decontaminate.lcs([1, 2, 3, 4], [2, 9, 4]) == 2 and decontaminate.lcs([1, 1, 2], [1, 2, 1]) == 2 and decontaminate.lcs([1], []) == 0


def test_decontamination(spark, tmp_path):
    rng = random.Random(12)
    items = [prose(rng, rng.randint(14, 55)) for _ in range(25)]
    clean = [prose(rng, rng.randint(5, 300)) for _ in range(150)]
    leaky, want = [], {}
    for k in range(60):
        w = items[k % 25].split()
        if k % 3 == 1:
            del w[rng.randrange(len(w))]
        if k % 3 == 2:
            w[rng.randrange(len(w))] = "changed"
        leaky.append(prose(rng, rng.randint(0, 150)) + " " + (" ".join(w).upper() if k % 4 == 0 else " ".join(w)) + ". " + prose(rng, rng.randint(0, 100)))
        want[len(clean) + k] = k % 25
    docs = make(spark, [*clean, *leaky, "", None])
    bench = spark.createDataFrame([*enumerate(items), (90, ""), (91, None), (None, "x y")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontaminate.matched(docs, bench).collect()}
    assert not any(got[i] for i in got if i not in want)
    assert sum(want[i] in got[i] for i in want) == len(want)
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(clean) + 2
    assert decontaminate.matched(docs, bench.where("false")).where("size(leaks) > 0").count() == 0
    assert decontaminate.matched(docs.where("false"), bench).count() == 0
    answers = spark.createDataFrame([(0, items[0], "absent words")], "item_id long, text string, answer string")
    assert decontaminate.matched(docs, answers).where("size(leaks) > 0").count() == 0


# ------------------------------------------------------------ 10 repeated strings


def test_suffixes(spark, corpus):
    texts = [*corpus, *corpus[:2]]
    ids = [*range(len(corpus)), 0, None]
    want = brute.repeats(texts)
    got = suffixes.removed(make(spark, texts, ids)).select("doc_id", "spans", "kept").collect()
    digest = lambda r: (r["doc_id"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
    assert sorted(map(str, map(digest, got))) == sorted(str((i, *w[1:])) for i, w in zip(ids, want, strict=True))
    assert suffixes.removed(make(spark, texts).where("false")).count() == 0


def test_suffixes_agree_with_plain_doubling(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ab") for _ in range(40))
    texts = [s + "x" * 5 + s, "y" + s[:30], "z" * 45, "short"]
    got = {(r["key"], r["start"]): r["unique"] for r in suffixes.ranks_by_doubling(make(spark, texts), 20).collect()}
    keys = {t: k for t, k in suffixes._keyed(make(spark, texts)).select("text", "key").collect()}
    seen = Counter(t[k : k + 20] for t in texts for k in range(len(t) - 19))
    assert got == {(keys[t], k): seen[t[k : k + 20]] == 1 for t in texts for k in range(len(t) - 19)}


def test_very_long_text_is_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 4096)
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 123, 20_000).astype(np.uint8)
    at, lo, hi, _ = suffixes.anchors(buf, np.array([0, 20_000]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert (np.sort(covered) == np.arange(20_000 - 199)).all()
    assert ((at - hi >= 0) & (at - lo <= 150)).all()


# ------------------------------------------------------------ pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled_corpus(spark, 300)
    item = prose(random.Random(77), 30)
    docs = docs.unionByName(make(spark, [item, docs.first()["text"]], [9001, 9002]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    assert 9001 not in ids and 9002 not in ids and len(rows) > 50
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_shards"]


def test_labelled_sample_is_bounded(spark):
    docs, labels, _ = labelled_corpus(spark, 100)
    assert labelled.sample(docs, labels, "toxic", F.lit(True), 10).count() == 10
