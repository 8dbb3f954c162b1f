"""Zarr version 3 arrays as a Spark data source, format "zarr3".

    spark.dataSource.register(ZarrSource)
    spark.read.format("zarr3").load(path)                      # (i0.., value)
    df.write.format("zarr3").option("shape", "4,6").option("chunks", "2,3").mode("overwrite").save(path)

A read has one partition for each stored object (a chunk, or a shard of
chunks), and comparisons on index columns prune objects before any is opened.
Codecs: bytes (little endian), zstd, and sharding with a trailing index.
Missing objects hold the fill value.
"""

from __future__ import annotations

import itertools
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

TYPES = {"float32": "float", "float64": "double", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "uint8": "short", "uint16": "int", "uint32": "long"}


def _crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


class Array:
    """Metadata of an array, and its objects' encoding."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta = path.rstrip("/"), meta
        self.shape = tuple(meta["shape"])
        if meta["data_type"] not in TYPES:
            raise ValueError(f"data type {meta['data_type']!r}")
        self.dtype = np.dtype(meta["data_type"]).newbyteorder("<")
        self.outer = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        codecs = meta["codecs"]
        self.sharded = codecs[0]["name"] == "sharding_indexed"
        inner = codecs[0]["configuration"] if self.sharded else None
        self.inner = tuple(inner["chunk_shape"]) if inner else self.outer
        if any(o % i for o, i in zip(self.outer, self.inner, strict=True)):
            raise ValueError("the chunk shape must divide the shard shape")
        names = [c["name"] for c in (inner["codecs"] if inner else codecs)]
        if unknown := [n for n in names if n not in ("bytes", "zstd")]:
            raise ValueError(f"codecs {unknown}")
        self.zstd = "zstd" in names
        self.level = next((c["configuration"].get("level", 3) for c in (inner["codecs"] if inner else codecs) if c["name"] == "zstd"), 3)
        self.checked = bool(inner) and any(c["name"] == "crc32c" for c in inner.get("index_codecs", []))
        key = meta.get("chunk_key_encoding", {})
        self.separator = key.get("configuration", {}).get("separator", "/")

    @classmethod
    def open(cls, path: str) -> Array:
        return cls(path, json.loads(files.read_bytes(f"{path.rstrip('/')}/zarr.json")))

    def key(self, at: tuple[int, ...]) -> str:
        return f"{self.path}/" + self.separator.join(["c", *map(str, at)])

    def grid(self) -> list[int]:
        return [-(-n // c) for n, c in zip(self.shape, self.outer, strict=True)]

    def _decode(self, raw: bytes) -> np.ndarray:
        if self.zstd:
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(np.prod(self.inner)) * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype).reshape(self.inner)

    def _encode(self, a: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(a, self.dtype).tobytes()
        if self.zstd:
            import zstandard

            raw = zstandard.ZstdCompressor(level=self.level).compress(raw)
        return raw

    def _fill(self, shape: tuple[int, ...]) -> np.ndarray:
        v = self.meta.get("fill_value", 0)
        return np.full(shape, float(v) if isinstance(v, str) else v, self.dtype)

    def _places(self) -> list[tuple[slice, ...]]:
        n = [o // i for o, i in zip(self.outer, self.inner, strict=True)]
        return [tuple(slice(k * i, (k + 1) * i) for k, i in zip(p, self.inner, strict=True)) for p in itertools.product(*map(range, n))]

    def load(self, at: tuple[int, ...]) -> np.ndarray:
        """One object as an array of the outer chunk's shape."""
        uri = self.key(at)
        out = self._fill(self.outer)
        if not files.exists(uri):
            return out
        raw = files.read_bytes(uri)
        if not self.sharded:
            return self._decode(raw)
        places = self._places()
        size = 16 * len(places)
        tail = raw[-size - 4 :] if self.checked else raw[-size:]
        if self.checked and struct.unpack("<I", tail[-4:])[0] != crc32c(tail[:-4]):
            raise ValueError(f"shard index of {uri} is damaged")
        index = np.frombuffer(tail[:size], "<u8").reshape(-1, 2)
        for place, (start, n) in zip(places, index.tolist(), strict=True):
            if start != (1 << 64) - 1:
                out[place] = self._decode(raw[start : start + n])
        return out

    def store(self, at: tuple[int, ...], a: np.ndarray) -> None:
        if not self.sharded:
            files.write_bytes(self.key(at), self._encode(a))
            return
        body, index = bytearray(), []
        for place in self._places():
            part = self._encode(a[place])
            index.append((len(body), len(part)))
            body += part
        tail = np.array(index, "<u8").tobytes()
        if self.checked:
            tail += struct.pack("<I", crc32c(tail))
        files.write_bytes(self.key(at), bytes(body) + tail)


def metadata(shape: list[int], chunks: list[int], dtype: str, shards: list[int] | None = None, zstd: bool = True, attributes: dict | None = None) -> dict:
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if zstd:
        codecs.append({"name": "zstd", "configuration": {"level": 3, "checksum": False}})
    if shards:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": chunks, "codecs": codecs, "index_codecs": index, "index_location": "end"}}]
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": shape,
        "data_type": dtype,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shards or chunks}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": "NaN" if dtype.startswith("float") else 0,
        "codecs": codecs,
        "attributes": attributes or {},
    }


class _Object(InputPartition):
    def __init__(self, at: tuple[int, ...]):
        self.at = at


class _Reader(DataSourceReader):
    def __init__(self, array: Array):
        self.array = array
        self.low, self.high = [0] * len(array.shape), [n - 1 for n in array.shape]

    def pushFilters(self, filters):
        """Ranges on index columns prune objects; all filters stay with Spark too."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name.startswith("i") and name[1:].isdigit() and isinstance(getattr(f, "value", None), int):
                d, v = int(name[1:]), f.value
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[d] = max(self.low[d], v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[d] = min(self.high[d], v - isinstance(f, LessThan))
            yield f

    def partitions(self):
        spans = [range(lo // c, hi // c + 1) if lo <= hi else range(0) for lo, hi, c in zip(self.low, self.high, self.array.outer, strict=True)]
        return [_Object(at) for at in itertools.product(*spans)]

    def read(self, partition):
        a = self.array
        block = a.load(partition.at)
        base = [k * c for k, c in zip(partition.at, a.outer, strict=True)]
        own = tuple(slice(0, min(c, n - b)) for c, n, b in zip(a.outer, a.shape, base, strict=True))
        block = block[own]
        kind = np.dtype({"u1": "i2", "u2": "i4", "u4": "i8"}.get(block.dtype.str[1:], block.dtype.str[1:]))
        rows = max(1, (1 << 18) // max(1, block[0].size if block.ndim > 1 else 1))
        for s in range(0, block.shape[0], rows):
            part = block[s : s + rows]
            idx = np.indices(part.shape).reshape(part.ndim, -1)
            cols = [pa.array(idx[d].astype(np.int64) + base[d] + (s if d == 0 else 0)) for d in range(part.ndim)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(part.reshape(-1).astype(kind))], [*[f"i{d}" for d in range(part.ndim)], "value"])


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """Rows of an object must come in one partition: ``prepare`` deals them so."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta = path, meta

    def write(self, rows):
        a = Array(self.path, self.meta)
        blocks: dict[tuple[int, ...], np.ndarray] = {}
        n = len(a.shape)
        last = None
        for r in rows:
            at = tuple(r[d] // c for d, c in zip(range(n), a.outer, strict=True))
            if at != last and last is not None and last in blocks:
                a.store(last, blocks.pop(last))
            last = at
            if at not in blocks:
                blocks[at] = a._fill(a.outer)
            blocks[at][tuple(r[d] % c for d, c in zip(range(n), a.outer, strict=True))] = r[n]
        for at, b in blocks.items():
            a.store(at, b)
        return _Done()

    def commit(self, messages):
        files.write_bytes(f"{self.path.rstrip('/')}/zarr.json", json.dumps(self.meta).encode())


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def schema(self) -> str:
        a = Array.open(self.options["path"])
        return ", ".join([*[f"i{d} long" for d in range(len(a.shape))], f"value {TYPES[a.meta['data_type']]}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(Array.open(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        ints = lambda k: [int(x) for x in self.options[k].split(",")] if self.options.get(k) else None
        meta = metadata(ints("shape"), ints("chunks"), self.options.get("dtype", "float64"), ints("shards"), self.options.get("codec", "zstd") == "zstd", json.loads(self.options.get("attributes", "{}")))
        Array(self.options["path"], meta)
        return _Writer(self.options["path"], meta)


def prepare(df, shape: list[int], object_shape: list[int]):
    """Deals rows (i0.., value) so that each stored object's rows share a partition and stand together."""
    at = [F.expr(f"i{d} div {c}") for d, c in enumerate(object_shape)]
    return df.select(*[f"i{d}" for d in range(len(shape))], "value").repartition(*at).sortWithinPartitions(*at)


def write(df, path: str, shape: list[int], chunks: list[int], dtype: str = "float64", shards: list[int] | None = None, attributes: dict | None = None) -> None:
    w = prepare(df, shape, shards or chunks).write.format("zarr3").mode("append").option("shape", ",".join(map(str, shape))).option("chunks", ",".join(map(str, chunks))).option("dtype", dtype).option("attributes", json.dumps(attributes or {}))
    (w.option("shards", ",".join(map(str, shards))) if shards else w).save(path)
