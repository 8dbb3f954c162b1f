"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task tokenises
its range as a stream and writes shard files.  A shard holds

* data blocks of about ``BLOCK`` bytes: entries (shared prefix length, suffix
  length, value length as varints, key suffix, value).  The key is the
  identifier as 8 big-endian bytes with the sign bit flipped, preceded by 1
  (a null identifier is the single byte 0), so byte order is identifier order;
  the value is the document's ids as little-endian unsigned integers of 2 bytes,
  or of 4 for vocabularies beyond 65,536 ids.  The first key of a block is
  whole, and a block is one Zstandard frame;
* a Bloom filter over the keys, 10 bits a key, 7 probes from one 128-bit hash;
* a sparse index: for each block its first key, offset and length;
* a footer of fixed size: offsets and lengths of filter and index, number of
  documents and of ids, bytes an id, and a magic word.

A lookup reads the footer, asks the filter, finds the block by binary search
in the index and scans one block.  Files are written under another name and
renamed when whole, so a task that is lost or runs twice leaves no half shard;
the manifest lists only the shards of the tasks that counted.

Edge cases: a null text is empty and holds just the end id; repeated
identifiers stand next to one another, ordered by their texts' hash (and may
span shards, so a hot identifier is many ranges); a null identifier
comes first; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

END_ID = 1
BLOCK = 32 << 10
SHARD = 32 << 20
FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"FSTOKEN2"
TABLE_BITS = 21
VOCABULARY = "word_bpe_49k.json"


# ---------------------------------------------------------------- encoding


class Encoder:
    """Encodes texts word by word (white space is a hard boundary for this tokenizer family) with a bounded memo.

    The vocabulary's normaliser drops white space and its pre-tokeniser never
    joins over it, so a text's ids are its words' ids in order.  The memo is an
    open-addressed table of 64-bit word hashes in NumPy arrays; ids of a whole
    slice of texts are gathered at once (words of over 64 bytes are hashed by XXH3, which no crafted pair defeats).  Words not in it go to the tokenizers
    library joined by newlines, and its offsets deal the ids back to the words.
    """

    def __init__(self, path: str, limit: int = 1_300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.at = np.zeros(1 << TABLE_BITS, np.int32)
        self.n = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int32)
        self.store = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it has none."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[slot]
            same = k == h[todo]
            out[todo[same]] = self.at[slot[same]]
            go = ~same & (k != 0)
            todo, slot = todo[go], (slot[go] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        size = sum(map(len, ids))
        while self.used + size > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.n + len(h) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        self.lens[self.n : self.n + len(h)] = lens
        self.starts[self.n : self.n + len(h)] = self.used + np.cumsum(lens) - lens
        self.store[self.used : self.used + size] = np.concatenate(ids) if ids else []
        self.used += size
        mask = (1 << TABLE_BITS) - 1
        at = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        todo, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            _, one = np.unique(slot, return_index=True)
            first = np.zeros(len(slot), bool)
            first[one] = True
            take = free & first
            self.keys[slot[take]], self.at[slot[take]] = h[todo[take]], at[todo[take]]
            todo, slot = todo[~take], np.where(free[~take], slot[~take], (slot[~take] + 1) & mask)

    def _encode_words(self, ws: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(ws)
        plain = [i for i, w in enumerate(ws) if max(w) < "ɐ" and len(w) <= 64 and "<|" not in w and not any(c.isspace() for c in w)]
        for c in range(0, len(plain), 2000):
            part = plain[c : c + 2000]
            e = self.tok.encode("\n".join(ws[i] for i in part), add_special_tokens=False)
            begin = np.cumsum([0, *(len(ws[i]) + 1 for i in part)])
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ids = np.array(e.ids, np.uint32)
            cut = np.searchsorted(at, begin)
            for j, i in enumerate(part):
                out[i] = ids[cut[j] : cut[j + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i in rest:
            out[i] = np.array(self.tok.encode(ws[i], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, each text's followed by the end id, and the n+1 offsets."""
        starts, ends, first = textvec.words(buf, offs)
        h = textvec.word_hash(buf, starts, ends)
        h[h == 0] = 1
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            if self.n + len(new) > self.limit:
                self.clear()
                new, one = np.unique(h, return_index=True)
                miss = np.arange(len(h))
            at = miss[one]
            self._put(new, self._encode_words([buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in at]))
            entry = self._find(h)
        lens = self.lens[entry].astype(np.int64)
        w = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=w[1:])
        n_docs = len(offs) - 1
        doc_len = w[first[1:]] - w[first[:-1]] + 1
        doc_at = np.zeros(n_docs + 1, np.int64)
        np.cumsum(doc_len, out=doc_at[1:])
        out = np.full(doc_at[-1], END_ID, np.uint32)
        src = np.repeat(self.starts[entry] - w[:-1], lens) + np.arange(w[-1])
        keep = np.ones(len(out), bool)
        keep[doc_at[1:] - 1] = False
        out[keep] = self.store[src]
        return out, doc_at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker: the memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- format


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: memoryview, i: int) -> tuple[int, int]:
    n = s = 0
    while True:
        c = b[i]
        n |= (c & 127) << s
        i += 1
        if c < 128:
            return n, i
        s += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Writes one shard to a binary stream; entries must come in key order."""

    def __init__(self, out: BinaryIO, width: int = 4):
        self.width, self.zip = width, zstandard.ZstdCompressor(level=1)
        self.out, self.at, self.block, self.last = out, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.head = b""
        self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        ids = ids.astype(f"<u{self.width}").tobytes()
        if len(self.block) >= BLOCK:
            self._flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.head = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids) // self.width

    def _flush(self) -> None:
        frame = self.zip.compress(bytes(self.block))
        self.out.write(frame)
        self.index.append((self.head, self.at, len(frame)))
        self.at += len(frame)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._flush()
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        self.out.write(bytes(bloom) + index)
        self.out.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), len(self.keys), self.n_ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream block by block, or one key by binary search."""

    def __init__(self, src: BinaryIO):
        self.src = src
        size = src.seek(0, 2)
        src.seek(size - FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(src.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        src.seek(bloom_at)
        self.bloom = src.read(bloom_n)
        self.bits = max(64, 10 * self.n_docs)
        src.seek(index_at)
        raw, i, self.index = memoryview(src.read(index_n)), 0, []
        while i < len(raw):
            n, i = _read_varint(raw, i)
            key, i = bytes(raw[i : i + n]), i + n
            at, i = _read_varint(raw, i)
            n, i = _read_varint(raw, i)
            self.index.append((key, at, n))

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[k]
        self.src.seek(at)
        raw, i, key = memoryview(zstandard.ZstdDecompressor().decompress(self.src.read(n))), 0, b""
        while i < len(raw):
            shared, i = _read_varint(raw, i)
            more, i = _read_varint(raw, i)
            size, i = _read_varint(raw, i)
            key = key[:shared] + bytes(raw[i : i + more])
            i += more
            yield key, np.frombuffer(raw[i : i + size], f"<u{self.width}")
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values under ``key``: several if an identifier is repeated, none if it is absent."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        heads = [k for k, _, _ in self.index]
        out = []
        for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
            out += [v for k, v in self._block(b) if k == key]
        return out


def open_fs(uri: str):
    """(file system, path) of a URI, for executors: local, HDFS, S3 or GCS as pyarrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:/") else f"file://{uri}")


# ---------------------------------------------------------------- Spark


def write_shards(docs: DataFrame, vocabulary: str, folder: str, n_ranges: int) -> DataFrame:
    """Writes the shards and returns the manifest (range, seq, path, n_docs, n_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        rows: list[tuple] = []
        shard: tuple | None = None

        def close() -> None:
            nonlocal shard
            if shard:
                w, out, tmp, final, fsys = shard
                w.close()
                out.close()
                fsys.move(tmp, final)
                rows.append((part, len(rows), final_uri(final), len(w.keys), w.n_ids))
                shard = None

        def final_uri(path: str) -> str:
            return f"{folder}/{path.rsplit('/', 1)[1]}"

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, end, buf, offs in textvec.parts(b.column(1), 1 << 19):
                tokens, at = enc.encode(buf, offs)
                for j in range(end - first):
                    if shard and shard[0].at >= SHARD:
                        close()
                    if not shard:
                        fsys, root = open_fs(folder)
                        fsys.create_dir(root, recursive=True)
                        name = f"{part:06d}-{len(rows):05d}-{uuid.uuid4().hex}.sst"
                        out = fsys.open_output_stream(f"{root}/.{name}")
                        shard = Writer(out, 2 if enc.tok.get_vocab_size() <= 1 << 16 else 4), out, f"{root}/.{name}", f"{root}/{name}", fsys
                    shard[0].add(key_of(ids[first + j]), tokens[at[j] : at[j + 1]])
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["range", "seq", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange(n_ranges, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    return common.saved(ordered.mapInArrow(run, "range int, seq int, path string, n_docs long, n_ids long"), "token-manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read back from the files of a manifest, one shard after another in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fsys, p = open_fs(path)
                with fsys.open_input_file(p) as src:
                    rows: tuple[list, ...] = ([], [], [], [], [])
                    size = 0
                    for key, value in Reader(src):
                        n = len(value)
                        for c, v in zip(rows, (id_of(key), start, n, zlib.crc32(value.astype("<u4").tobytes()), value.astype(np.int64) if with_ids else None), strict=True):
                            c.append(v)
                        start += n
                        size += n
                        if len(rows[0]) >= 4096 or with_ids and size > 1 << 20:
                            yield batch(rows)
                            rows, size = ([], [], [], [], []), 0
                    if rows[0]:
                        yield batch(rows)

    def batch(rows: tuple[list, ...]) -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in rows[:4]] + ([pa.array(rows[4], pa.list_(pa.int64()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    # One row a shard of tens of MB: the running sum goes over that list, not over documents.
    before = Window.orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.select("path", "start").repartition(n, "path").mapInArrow(run, schema)


def n_ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_table(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    manifest = write_shards(docs, vocabulary or default_vocabulary(), common.new_path(spark, "tokens"), n_ranges(spark))
    return read_shards(manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark, common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; returns what they hold for each document."""
    return encode_table(spark, docs)
