"""Embedding near-duplicates by product quantisation.

Vectors are normalised and equal ones collapse to a class with a count.  An
inverted file has coarse centroids (spherical k-means on a bounded sample);
each class is stored in the list of its nearest centroid with a residual code:
one of 256 codewords in each of the subspaces.  A class probes a list when the
boundary between its own cell and the list's is within ``MARGIN`` link radii, so lists
are probed by distance, not by count; as either vector of a pair may find the
other, and the distances of both ends of a link to the boundary sum to one
radius at most, half a radius loses no pair.  Within a list,
distances to the codes come from lookup tables (a query's asymmetric
distances); a code passes if its distance is within the radius plus its own
stored quantisation error, so the filter loses nothing, and the exact cosine
in double precision decides.

Lists next to each other form groups of some ``BLOCK`` rows, and a class goes
to a group once, whatever number of its lists it probes.  Work on a group goes
by blocks: its rows are cut into blocks of ``BLOCK`` and those that probe it
into as many, so a list that holds a third of all rows becomes many tasks and
no task gets more than two blocks.  A block reports for each class how many
vectors it links to there and one representative it links to: no pairs leave
it.  Rows sent to groups are many times the input, so groups take turns: each
pass shuffles some ``SHARE`` times the vectors and its files go with it.

Edge cases: a vector that is null, zero, or holds null or non-finite
components links with nothing; only vectors of equal length are compared;
rows with a null vec_id count as partners and are reported, and name a
component only if no member has an id; repeated rows are separate vectors;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

COSINE = 0.95
SAMPLE = 16_384
LISTS_MAX = 4096
PER_LIST = 400
SUBSPACES = 8
BLOCK = 8192
MARGIN = 0.5
#: A pass shuffles so many times the vectors' bytes, or this many bytes where that is more.
SHARE = 2
PASS = 192 << 20


@dataclass
class Index:
    """Centroids (k, d) and codebooks (m, 256, d/m), of bounded size: LISTS_MAX * d and 256 * d floats."""

    centroids: np.ndarray
    codebooks: np.ndarray
    splits: list[np.ndarray]
    group: np.ndarray
    """The group of each list; lists of a group follow each other."""

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each row, and its squared distances to all centroids."""
        d = np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)
        return d.argmin(1), d

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        home, d = self.nearest(x)
        # Distance to the plane between two cells: (d_c - d_home) / (2 |c - home|).
        c2 = (self.centroids**2).sum(1)
        between = np.sqrt(np.maximum(c2[home][:, None] + c2 - 2 * self.centroids[home] @ self.centroids.T, 1e-12))
        near = (d - d[np.arange(len(x)), home][:, None]) / (2 * between) <= MARGIN * radius + 1e-9
        near[np.arange(len(x)), home] = True
        return home, [np.flatnonzero(r) for r in near]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the quantisation error)."""
        codes = np.empty((len(residual), len(self.splits)), np.uint8)
        err = np.zeros(len(residual))
        for m, cols in enumerate(self.splits):
            r = residual[:, cols]
            d = (r**2).sum(1)[:, None] + (self.codebooks[m] ** 2).sum(1) - 2 * r @ self.codebooks[m].T
            codes[:, m] = d.argmin(1)
            err += np.maximum(((r - self.codebooks[m][codes[:, m]]) ** 2).sum(1), 0)
        return codes, np.sqrt(err)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each query residual to every codeword: (m, n, 256), laid out codeword by codeword."""
        out = np.empty((len(self.splits), 256, len(residual)))
        for t, b, c in zip(out, self.codebooks, self.splits, strict=True):
            r = residual[:, c]
            np.matmul(-2 * b, r.T, out=t)
            t += (b**2).sum(1)[:, None]
            t += (r**2).sum(1)
            np.maximum(t, 0, out=t)
        return out.swapaxes(1, 2)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, by blocks of rows."""
    c2 = (c**2).sum(1)
    return np.concatenate([(c2 - 2 * x[s : s + 1024] @ c.T).argmin(1) for s in range(0, max(len(x), 1), 1024)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps squares from under- and overflowing."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _closest(x, c)
        order = np.argsort(near, kind="stable")
        own, cut = np.unique(near[order], return_index=True)
        c[own] = np.add.reduceat(x[order], cut, axis=0) / np.diff(np.r_[cut, len(x)])[:, None]
    return c


def _line(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An order of rows in which neighbours are near: halves along the main direction, again and again."""
    if len(c) <= 2:
        return np.arange(len(c))
    x = c - c.mean(0)
    v = rng.normal(size=c.shape[1])
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    order = np.argsort(x @ v, kind="stable")
    return np.concatenate([h[_line(c[h], rng)] for h in np.array_split(order, 2)])


def train(sample: np.ndarray, n_rows: int, seed: int = 5) -> Index:
    """Fits on a bounded sample; the number of lists follows the number of rows up to LISTS_MAX."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    k = int(np.clip(n_rows // PER_LIST, 1, min(LISTS_MAX, max(1, len(sample) // 4))))
    centroids = _kmeans(sample, k, 8, rng)
    splits = np.array_split(np.arange(d), min(SUBSPACES, d))
    centroids = centroids[_line(centroids, rng)]
    near = _closest(sample, centroids)
    before = np.r_[0, np.cumsum(np.bincount(near, minlength=len(centroids)))[:-1]] * (n_rows / len(sample))
    group = np.unique((before / BLOCK).astype(int), return_inverse=True)[1]
    rest = sample - centroids[near]
    books = []
    for cols in splits:
        b = _kmeans(rest[:, cols], 256, 6, rng)
        books.append(np.concatenate([b, np.repeat(b[:1], 256 - len(b), 0)]))
    return Index(centroids, np.array(books, dtype=object) if len({b.shape for b in books}) > 1 else np.stack(books), splits, group)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls whose rows are equally long, as a matrix."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return v.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(x: np.ndarray, n: np.ndarray | None = None, empty: int = 0) -> pa.Array:
    """A binary column: the rows of x (or runs of n of its entries), then ``empty`` empty ones."""
    n = np.full(len(x), x[0].nbytes if len(x) else 0) if n is None else n * x.itemsize
    offsets = np.r_[0, np.cumsum(n), np.full(empty, n.sum())].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n) + empty, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column without nulls, and the number of each row's."""
    buf, offs = textvec.flat(column)
    return np.frombuffer(buf, dtype), np.diff(offs) // np.dtype(dtype).itemsize


def _valid(x) -> F.Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _assigned(index, radius: float):
    """Rows (cid, copies, vec) with vectors packed, their home list, code, its error and the lists to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                own = np.float32 if part.column(2).type.value_type == pa.float32() else np.float64
                raw = _rows(part.column(2))
                x = _unit(raw)
                home, probes = ix.probes(x, radius)
                codes, err = ix.encode(x - ix.centroids[home])
                n = np.array([len(p) for p in probes])
                cols = {
                    "cid": part.column(0),
                    "copies": part.column(1),
                    "vec": _packed(raw.astype(own)),
                    "home": pa.array(home.astype(np.int32)),
                    "code": _packed(codes),
                    "err": pa.array(err),
                    "probes": _packed(np.concatenate(probes).astype(np.uint16), n),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _dealt(index, first: int, last: int):
    """Rows of ``_assigned`` for groups first to last: one in the group of the home list, and one in each group that is probed, with the lists there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = index.value.group
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                lists, n = _unpacked(pa.chunked_array([part.column(6)]), np.uint16)
                who = np.repeat(np.arange(part.num_rows), n)
                at = group[lists]
                held = np.flatnonzero((group[part.column(3).to_numpy()] >= first) & (group[part.column(3).to_numpy()] <= last))
                mine = (at >= first) & (at <= last)
                who, lists, at = who[mine], lists[mine], at[mine]
                # Lists come in order, and so do the groups of a row.
                start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1])]) if len(who) else np.zeros(0, int)
                row = pa.array(np.r_[held, who[start]])
                asked = _packed(lists, np.diff(np.r_[start, len(who)]))
                cols = {
                    "group": pa.array(np.r_[group[part.column(3).to_numpy()[held]], at[start]].astype(np.int32)),
                    "stored": pa.array(np.arange(len(row)) < len(held)),
                    **{c: part.column(k).take(row) for k, c in enumerate(("cid", "copies", "vec", "home"))},
                    "code": pa.concat_arrays([part.column(4).take(pa.array(held)), pa.array([b""] * len(start), pa.binary())]),
                    "err": part.column(5).take(row),
                    "probes": pa.concat_arrays([part.column(6).take(pa.array(held)), asked]),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _counted(index):
    """For each batch of ``_assigned`` and group: rows held, rows that probe it, and bytes of the held rows' probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = index.value.group
        k = int(group.max()) + 1
        for b in batches:
            lists, n = _unpacked(pa.chunked_array([b.column(6)]), np.uint16)
            home = group[b.column(3).to_numpy()]
            pairs = np.unique(np.repeat(np.arange(b.num_rows), n) * k + group[lists])
            sums = np.bincount(home, minlength=k), np.bincount(pairs % k, minlength=k), np.bincount(home, 2 * n, k).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *[pa.array(s.astype(np.int64)) for s in sums]], ["group", "held", "asked", "bytes"])

    return run


def _tiles(index, dim: int, radius: float):
    """Assigns rows (cid, copies, vec): one stored row, and one row for each group that is probed."""
    assigned, dealt = _assigned(index, radius), _dealt(index, 0, LISTS_MAX)
    return lambda batches: dealt(assigned(batches))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def _block(index, cosine: float):
    """Links between the stored rows and the probing rows of one block: (cid, links, with)."""

    def run(table: pa.Table) -> pa.Table:
        ix = index.value
        stored = np.asarray(table["stored"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        cid, copies, home = (table[c].to_numpy() for c in ("cid", "copies", "home"))
        s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        if not len(s) or not len(q):
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "with": pa.array([], pa.int64())})
        x, size = _unpacked(table["vec"], np.uint8)
        x = _unit(x.view(np.float32 if size[0] == 4 * ix.centroids.shape[1] else np.float64).reshape(len(cid), -1).astype(np.float64))
        s = s[np.argsort(home[s], kind="stable")]
        codes = _unpacked(table["code"].take(pa.array(s)), np.uint8)[0].reshape(len(s), -1).T.astype(np.intp)
        radius = np.sqrt(2 - 2 * cosine)
        # Sums of single precision are off by far less than this share of a distance.
        limit = ((radius + table["err"].to_numpy()[s] + 1e-6) ** 2 * (1 + 1e-5)).astype(np.float32)[:, None]
        asked, n = _unpacked(table["probes"].take(pa.array(s)), np.uint16)
        probes = np.zeros((len(s), len(ix.centroids)), bool)
        probes[np.repeat(np.arange(len(s)), n), asked] = True
        asked, n = _unpacked(table["probes"].take(pa.array(q)), np.uint16)
        order = np.argsort(asked, kind="stable")
        asker, asked = np.repeat(q, n)[order], asked[order]
        links = np.zeros(len(x), np.int64)
        ea, eb = [], []
        lists, start = np.unique(home[s], return_index=True)
        for own, lo, hi in zip(lists.tolist(), start, np.r_[start[1:], len(s)], strict=True):
            mine = asker[np.searchsorted(asked, own) : np.searchsorted(asked, own, "right")]
            held = s[lo:hi]
            for k in range(0, len(mine), 256):
                part = mine[k : k + 256]
                t = ix.tables(x[part] - ix.centroids[own])
                d = np.zeros((len(held), len(part)), np.float32)
                for m, code in enumerate(codes[:, lo:hi]):
                    d += t[m].T.astype(np.float32)[code]
                j, i = np.nonzero(d <= limit[lo:hi])
                i = part[i]
                keep = cid[i] != cid[held[j]]
                i, j = i[keep], j[keep]
                for c in range(0, len(i), 1 << 17):
                    a, b = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                    linked = np.einsum("ij,ij->i", x[a], x[held[b]]) >= cosine
                    a, b = a[linked], b[linked]
                    # A pair that also meets in the prober's own list counts in the smaller list only;
                    # within one list each ordered pair comes up once, so it counts for the prober.
                    same = home[a] == own
                    again = probes[lo + b, home[a]]
                    once = same | ~again | (own < home[a])
                    a, b, same = a[once], b[once], same[once]
                    np.add.at(links, a, copies[held[b]])
                    np.add.at(links, held[b[~same]], copies[a[~same]])
                    ea.append(a)
                    eb.append(held[b])
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ea, eb))
        # The block's components over class ids, so that a class met as prober and as stored row is one node.
        ids, at = np.unique(cid, return_inverse=True)
        root = _roots(len(ids), at[a], at[b])
        total = np.bincount(at, links, len(ids)).astype(np.int64)
        hit = np.flatnonzero(total)
        return pa.table({"cid": pa.array(ids[hit]), "links": pa.array(total[hit]), "with": pa.array(ids[root[hit]])})

    return run


def _passes(held: DataFrame, index, width: int, n: int, cosine: float) -> DataFrame:
    """Links (cid, links, with) of all blocks; groups take turns, so that a pass shuffles a bounded multiple of the vectors."""
    spark = held.sparkSession
    # One row for each group; groups number LISTS_MAX at most.
    dealt = held.mapInArrow(_counted(index), "group int, held long, asked long, bytes long")
    size = {r["group"]: r for r in dealt.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("held", "asked", "bytes")]).collect()}
    groups, passes, full = [], [], 0
    for g in sorted(size):
        hb, qb = -(-size[g]["held"] // BLOCK), -(-size[g]["asked"] // BLOCK)
        if not hb:
            continue
        cost = size[g]["asked"] * hb * (width + 96) + qb * (size[g]["held"] * (width + 96) + size[g]["bytes"])
        if not passes or full + cost > max(PASS, SHARE * n * width):
            passes.append([g, g])
            full = 0
        passes[-1][1] = g
        full += cost
        groups.append((g, hb, qb))
    blocks = spark.createDataFrame(groups, "group int, hb int, qb int")
    out = None
    for first, last in passes:
        tiles = held.mapInArrow(_dealt(index, first, last), "group int, stored boolean, cid long, copies long, vec binary, home int, code binary, err double, probes binary")
        tiles = tiles.join(F.broadcast(blocks), "group")
        mine = F.pmod(F.xxhash64("cid"), F.when(F.col("stored"), F.col("hb")).otherwise(F.col("qb"))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("qb")).otherwise(F.col("hb")) - 1))
        tiles = tiles.withColumn("mine", mine).withColumn("other", others)
        tiles = tiles.withColumns({"h": F.when(F.col("stored"), F.col("mine")).otherwise(F.col("other")), "q": F.when(F.col("stored"), F.col("other")).otherwise(F.col("mine"))})
        found = common.saved(tiles.groupBy("group", "h", "q").applyInArrow(_block(index, cosine), "cid long, links long, with long"), "vector-links")
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    # Single precision is kept where vectors come in it; all arithmetic is in double.
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vec"))
    good = rows.where(_valid(F.col("vec")))
    classes = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = common.saved(classes.withColumn("dim", F.size("vec")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    parts, edges = [], []
    for dim, n in sorted(classes.groupBy("dim").agg(F.count("*")).collect()):  # one row for each length of vector
        of = classes.where(F.col("dim") == dim).select("cid", "copies", "vec")
        sample = of.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
        sample = _rows(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample)
        sample = _unit(sample)
        index = spark.sparkContext.broadcast(train(sample, n, seed))
        radius = float(np.sqrt(2 - 2 * cosine))
        held = common.Saved(of.mapInArrow(_assigned(index, radius), "cid long, copies long, vec binary, home int, code binary, err double, probes binary"), "vector-lists")
        found = _passes(held.df, index, dim * (4 if single else 8), n, cosine)
        held.drop()
        parts.append(found.groupBy("cid").agg(F.sum("links").alias("links")))
        edges.append(found.select(F.col("cid").alias("u"), F.col("with").alias("v")))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, pairs = parts[0], edges[0]
    for p, e in zip(parts[1:], edges[1:], strict=True):
        links, pairs = links.unionByName(p), pairs.unionByName(e)
    roots = common.components(pairs, "vectors").withColumnRenamed("node", "cid")
    named = classes.join(links, "cid", "left").join(roots, "cid", "left")
    named = common.saved(named.select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "vector-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("vec", "n_links", "component_id")
    out = good.join(named, "vec").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(_valid(F.col("vec")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
