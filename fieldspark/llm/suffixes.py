"""Removal of byte strings that repeat anywhere in a corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
elsewhere.  Plain prefix doubling (``ranks_by_doubling``) sorts a rank pair
for every byte of the corpus at every offset; on a corpus its rows outgrow the
input a hundredfold.  ``repeats`` doubles over fewer positions without losing
any repeat:

1. Anchors.  Of every ``WINDOW`` consecutive ``GRAM``-byte strings the one
   with the least hash is an anchor (about one position in 75), so the choice
   depends on content alone, and a 200-byte string always holds the anchor of
   its first window at the same place.  An anchor's first rank is its gram's
   hash.  Positions whose rank is unique are settled and go: no string that
   leans on them repeats.
2. Second rank, at the larger offset: a 128-bit fingerprint of all strings
   that lean on the anchor, up to 350 bytes.  Where it repeats, all of them do.
3. Anchors that share the first rank but not the second are resolved on one
   representative of each second rank, which carries its 350 bytes at most.
   Its starts are cut into runs of ``RUN``; a run's first rank is the
   fingerprint of the bytes all its strings share, its second that of all its
   bytes, and the same rule settles most runs.
4. What is left, about one run beside each edge, lists its 200-byte strings,
   whose fingerprints are counted with the representatives' multiplicities.

Counts are partial aggregations, and joins only have one hot side, so a
passage in a third of all documents is spread over tasks; whole copies
collapse to one representative before step 3.  First ranks pass
through a bit table of fixed size (``BITS``) that is broadcast; its false hits
cost rows and are settled in step 2.

Edge cases: a null text is empty; a text under 200 bytes keeps all its bytes;
rows with a null or repeated identifier are documents of their own (rows
are told apart by identifier and text hash; wholly equal rows are copies of
one another, so both go the same way); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

LENGTH = 200
GRAM = 50
RUN = 8
BITS = 27
_POS = 24
_PIECE = 1 << 22


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, gram hash): the starts of ``length``-byte strings that lean on each anchor."""
    n, window = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    if n > _PIECE:  # a very long text, by pieces of starts
        got = []
        for s in range(0, n - length + 1, _PIECE // 2):
            e = min(n, s + _PIECE // 2 + length - 1)
            sub = np.clip(offs, s, e) - s
            got.append([x + s if k < 3 else x for k, x in enumerate(anchors(buf[s:e], sub, length, gram))])
        return tuple(map(np.concatenate, zip(*got, strict=True)))
    sums = textvec.prefix(buf)
    h = (sums[gram:] - sums[:-gram]) * textvec.powers(n)[1][: n - gram + 1]
    h = textvec.mix(h)
    least = h & np.uint64((1 << 64) - (1 << _POS)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, offs[:-1], 1)
    np.add.at(change, np.maximum(offs[1:] - length + 1, offs[:-1]), -1)
    starts = np.flatnonzero(np.cumsum(change)[: n - length + 1] > 0)
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = (least[starts] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[cut[1:], len(at)] - 1
    return at[cut], starts[cut], starts[last], h[at[cut]]


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def _gram_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in textvec.parts(b.column(0), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(buf, offs)[3].view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """Bit table over the low BITS of each hash: 2**BITS / 8 bytes whatever the number of hashes."""
    bit = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    got = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.uint64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def _second_ranks(keyed: DataFrame, table) -> DataFrame:
    """(h, r1, r2, doc_id, key, at, lo, hi) of anchors whose gram may repeat; lo and hi are their first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            for first, _, buf, offs in textvec.parts(b.column(2), 1 << 19):
                at, lo, hi, h = anchors(buf, offs)
                low = h & np.uint64((1 << BITS) - 1)
                hit = np.flatnonzero(bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                if not len(hit):
                    continue
                at, lo, hi, h = at[hit], lo[hit], hi[hit], h[hit]
                raw, base = buf.tobytes(), np.searchsorted(offs, at, "right") - 1
                r = _digests(xxhash.xxh3_128_digest(raw[x : y + LENGTH], (a - x) << 16 | (a - y)) for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True))
                row = pa.array(base + first)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(r[:, 0]), pa.array(r[:, 1]), b.column(0).take(row), b.column(1).take(row), *(pa.array((x - offs[base]).astype(np.int32)) for x in (at, lo, hi))], ["h", "r1", "r2", "doc_id", "key", "at", "lo", "hi"])

    return keyed.mapInArrow(run, "h long, r1 long, r2 long, doc_id long, key long, at int, lo int, hi int")


def _contexts(texts: DataFrame) -> DataFrame:
    """(doc_id, key, at, lo, hi, n, bytes) of the listed representatives (column reps): the bytes of all strings that lean on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, key, text, reps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw, n = text.as_buffer(), len(reps)
                cols = [pa.array([x[c] for x in reps], t) for c, t in (("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int64()))]
                own = pa.array([raw[x["lo"] : x["hi"] + LENGTH].to_pybytes() for x in reps], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), *cols, own], ["doc_id", "key", "at", "lo", "hi", "n", "bytes"])

    return texts.mapInArrow(run, "doc_id long, key long, at int, lo int, hi int, n long, bytes binary")


_RUNS = "c1 long, c2 long, w1 long, w2 long, cid long, doc_id long, key long, n long, first int, last int"


def _runs(contexts: DataFrame) -> DataFrame:
    """Runs of RUN starts at fixed distances before the anchor: fingerprints of their common and of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, last, core, whole = [], [], [], [], []
            cols = {c: b.column(c).to_pylist() for c in ("at", "lo", "hi")}
            for i, (at, lo, hi, raw) in enumerate(zip(*cols.values(), b.column("bytes"), strict=True)):
                raw = raw.as_buffer().to_pybytes()
                for k in range((at - hi) // RUN, (at - lo) // RUN + 1):
                    near, far = max(k * RUN, at - hi), min(k * RUN + RUN - 1, at - lo)
                    c = at - k * RUN - lo
                    core.append(xxhash.xxh3_128_digest(raw[c : c - RUN + 1 + LENGTH], k))
                    whole.append(xxhash.xxh3_128_digest(raw[at - far - lo : at - near - lo + LENGTH], near << 16 | far))
                    row.append(i)
                    first.append(at - far)
                    last.append(at - near)
            if row:
                c, w, at = _digests(core), _digests(whole), pa.array(row)
                cols = [pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(w[:, 0]), pa.array(w[:, 1]), *(b.column(x).take(at) for x in ("cid", "doc_id", "key", "n")), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["c1", "c2", "w1", "w2", "cid", "doc_id", "key", "n", "first", "last"])

    return contexts.select("cid", "doc_id", "key", "n", "at", "lo", "hi", "bytes").mapInArrow(run, _RUNS)


def _strings(rows: DataFrame) -> DataFrame:
    """(g1, g2, n, doc_id, key, start) of every 200-byte string of runs (lo, first, last, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, first, last = (b.column(c).to_numpy() for c in ("lo", "first", "last"))
            count = last.astype(np.int64) - first + 1
            row = np.repeat(np.arange(len(lo)), count)
            start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            raw = [x.as_buffer().to_pybytes() for x in b.column("bytes")]
            if len(row):
                g = _digests(xxhash.xxh3_128_digest(raw[i][p : p + LENGTH]) for i, p in zip(row.tolist(), (start - lo[row]).tolist(), strict=True))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(g[:, 0]), pa.array(g[:, 1]), *(b.column(c).take(at) for c in ("n", "doc_id", "key")), pa.array(start.astype(np.int32))], ["g1", "g2", "n", "doc_id", "key", "start"])

    return rows.select("n", "doc_id", "key", "lo", "first", "last", "bytes").mapInArrow(run, "g1 long, g2 long, n long, doc_id long, key long, start int")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): per document with repeats, the [a, b) byte spans of repeated strings, unmerged."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    until = lambda c: (F.col(c) + LENGTH).alias("b")
    firsts = _gram_hashes(keyed).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    table = spark.sparkContext.broadcast(_bit_table(firsts))
    seconds = common.Saved(_second_ranks(keyed, table), "suffix-ranks")

    classes = common.Saved(seconds.df.groupBy("h", "r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "at", "lo", "hi")).alias("rep")), "suffix-classes")
    whole = common.Saved(seconds.df.join(classes.df.where("n > 1").select("r1", "r2"), ["r1", "r2"], "left_semi").select("doc_id", "key", F.col("lo").alias("a"), until("hi")), "suffix-whole")
    seconds.drop()

    shared = classes.df.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    reps = classes.df.join(shared, "h", "left_semi").select("rep.*", "n").groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "lo", "hi", "n")).alias("reps"))
    same = keyed["doc_id"].eqNullSafe(reps["doc_id"]) & (keyed["key"] == reps["key"])
    contexts = _contexts(keyed.join(reps, same).select(keyed["doc_id"], keyed["key"], "text", "reps"))
    # Rows equal in identifier and text list the same representatives; their classes count 2 or more as it is.
    contexts = common.Saved(contexts.withColumn("cid", F.monotonically_increasing_id()), "suffix-contexts")
    classes.drop()

    kinds = common.Saved(_runs(contexts.df).groupBy("c1", "c2", "w1", "w2").agg(F.sum("n").alias("n"), F.min(F.struct("cid", "first", "last")).alias("rep")), "suffix-kinds")
    runs = _runs(contexts.df.where("n = 1")).join(kinds.df.where("n > 1").select("w1", "w2"), ["w1", "w2"], "left_semi").select("doc_id", "key", F.col("first").alias("a"), until("last"))
    shared = kinds.df.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).where("kinds > 1").select("c1", "c2")
    left = kinds.df.join(shared, ["c1", "c2"], "left_semi").select("rep.*", F.col("n").alias("of"))
    left = left.join(contexts.df, "cid").select(F.col("of").alias("n"), "doc_id", "key", "lo", "first", "last", "bytes")
    strings = common.Saved(_strings(left), "suffix-strings")
    twice = strings.df.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where("all > 1").select("g1", "g2")
    single = strings.df.where("n = 1").join(twice, ["g1", "g2"], "left_semi").select("doc_id", "key", F.col("start").alias("a"), until("start"))

    spans = whole.df.unionByName(runs).unionByName(single).groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = common.Saved(spans, "suffix-spans")
    for t in (whole, contexts, kinds, strings):
        t.drop()
    return spans.df


def _cut(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Spans merged where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, kept): merged removed byte spans and the bytes that stay, for every row."""
    keyed, found = _keyed(docs), repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept = [], []
            for text, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw, at, out = text.as_buffer().to_pybytes(), 0, []
                cut = _cut(found or [], len(raw))
                for a, z in cut:
                    out.append(raw[at:a])
                    at = z
                spans.append([{"a": a, "b": z} for a, z in cut])
                kept.append(b"".join([*out, raw[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["key"] == found["key"])
    return keyed.join(found, same, "left").select(keyed["doc_id"], "text", "spans").mapInArrow(run, "doc_id long, spans array<struct<a: long, b: long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a)
    out = removed(common.documents(spark, sf_dir)).select("doc_id", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", (F.col("left") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def ranks_by_doubling(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, unique) by plain prefix doubling over every byte: the textbook form, for small tables and tests.

    Ranks start as byte values; a round pairs each position's rank with that of
    the position ``h`` further on, sorts and renumbers the pairs, and doubles
    ``h``.  The last round steps by length - h, so ranks cover exactly
    ``length`` bytes.  Positions too near the end of their text drop out.
    """
    pos = _keyed(docs).select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("text")), lambda i: F.ascii(F.substring(F.col("text").cast("binary").cast("string"), i, F.lit(1)))))).toDF("key", "start", "rank")
    h = 1
    while h < length:
        step = min(h, length - h)
        nxt = pos.select("key", (F.col("start") - step).alias("start"), F.col("rank").alias("second"))
        pair = pos.join(nxt, ["key", "start"])
        pos = common.saved(pair.withColumn("rank", F.dense_rank().over(Window.orderBy("rank", "second"))).select("key", "start", "rank"), "doubling")
        h += step
    once = pos.groupBy("rank").agg(F.count("*").alias("n"))
    return pos.join(once, "rank").select("key", "start", (F.col("n") == 1).alias("unique"))
