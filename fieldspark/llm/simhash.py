"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits itself and its 64 one-bit neighbours: the
ball of half the link radius 2.  Two fingerprints at 2 or fewer differing
bits meet in at least one variant, and a variant is shared by 65 fingerprints
at most, so buckets are bounded whatever the data.  Within a bucket each
fingerprint links to the next smaller one; the link is verified by its bit
count and deduplicated.  All members of a bucket are within the radius of one
another, so these links keep the components of the full link graph.

Exact and hashed-alike copies collapse to one fingerprint before any
shuffle on variants, by partial aggregation.

Edge cases: a null text counts as empty; an empty text has fingerprint 0 and
links like any other; a null doc_id takes part and is reported, but names a
component only if no member has an id (then component_id is null); repeated
rows come back as many times; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, jaccard

SEED = 42
BITS = 64
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash over word shingles, repeats included; ASCII case is folded."""
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        e = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts, ends = [0, *(e[:-shingle] + 1).tolist()], e[shingle - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        counts += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 fingerprint bits as a BIGINT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = (fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.fromiter(fps, np.uint64, b.num_rows).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Verified links (u, v) between the distinct BIGINT fingerprints of column ``fp``."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(BITS)])
    near = fps.select("fp", F.explode(flips).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        near.withColumn("u", before)
        .where(F.col("u").isNotNull() & (F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= 2))
        .select("u", F.col("fp").alias("v"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fp = common.saved(fingerprints(docs, shingle), "simhash-fp")
    distinct = common.saved(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = common.components(links(distinct.select("fp")), "simhash")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.saved(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return fp.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents whose 5-word shingles overlap by 4/5 or more.

    Links are SimHash collisions over 5-word shingles with the exact similarity
    checked, completed by ``jaccard`` with the alike pairs that lie further
    apart than the ball's radius.  The row that stays has the group's least
    doc_id (null last), then the least text hash; rows that agree in both are
    ordered by their other columns.  Null and empty texts are alike; a text of
    fewer words is one shingle; columns and their names are untouched.
    """
    order = spark.sparkContext.broadcast(jaccard.frequent(jaccard.keyed(docs.select("doc_id", "text"))))
    own = jaccard.keyed(docs.select("doc_id", "text"))
    rows = common.Saved(jaccard.described(own, order), "simhash-rows")
    roots = jaccard.grouped(own, rows.df, order, links)
    least = rows.df.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min(F.struct(*jaccard.KEY)).alias("head"))
    heads = common.Saved(least.select("head.*"), "simhash-heads")
    rows.drop()
    plain, back = common.renamed(docs)
    doc_id, text = common.own_name(docs, "doc_id"), common.own_name(docs, "text")
    others = [c for c in plain.columns if c not in (doc_id, text)]
    key = jaccard.keyed(plain.withColumns({"doc_id": F.col(doc_id), "text": F.col(text)})).drop("doc_id", "text")
    nth = F.row_number().over(Window.partitionBy(*jaccard.KEY).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0)))
    return back(key.join(heads.df, jaccard.KEY, "left_semi").withColumn("nth", nth).where("nth = 1"))
