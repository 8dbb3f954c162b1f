"""NetCDF classic files (CDF-1, CDF-2 and CDF-5) as a Spark data source, format "netcdf".

    spark.dataSource.register(NetcdfSource)
    spark.read.format("netcdf").option("variable", "t").load(path)   # (t_idx, i0.., value)

One partition for a timestep where the leading dimension is time, else one for
the variable; a read touches only its bytes.  A leading dimension is time if
it is the record dimension or called time.  NetCDF-4 (HDF5) needs a native
library and is not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import StructType

from . import files

# External types of the classic format, by code.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SPARK = {1: "byte", 3: "short", 4: "int", 5: "float", 6: "double", 7: "short", 8: "int", 9: "long", 10: "long"}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    size: int
    begin: int
    record: bool = False


@dataclass
class Header:
    n_records: int
    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0

    def shape(self, v: Variable) -> list[int]:
        return [self.n_records if v.record and k == 0 else self.dims[d][1] for k, d in enumerate(v.dims)]

    def timed(self, v: Variable) -> bool:
        return bool(v.dims) and (v.record or self.dims[v.dims[0]][0].lower() == "time") and len(v.dims) > 1

    def describe(self, name: str) -> dict:
        if name not in self.variables:
            raise KeyError(f"no variable {name!r}")
        v = self.variables[name]
        s = self.shape(v)
        return {"dtype": SPARK[v.kind], "shape": s[1:] if self.timed(v) else s, "timesteps": s[0] if self.timed(v) else 1}


class _Cursor:
    def __init__(self, data: bytes):
        self.d, self.i = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.wide, self.offset = data[3] == 5, data[3] >= 2

    def count(self) -> int:
        f, n = (">q", 8) if self.wide else (">i", 4)
        v = struct.unpack_from(f, self.d, self.i)[0]
        self.i += n
        return v

    def tag(self) -> int:
        v = struct.unpack_from(">i", self.d, self.i)[0]
        self.i += 4
        return v

    def place(self) -> int:
        f, n = (">q", 8) if self.offset else (">i", 4)
        v = struct.unpack_from(f, self.d, self.i)[0]
        self.i += n
        return v

    def text(self) -> str:
        n = self.count()
        s = self.d[self.i : self.i + n].decode()
        self.i += -(-n // 4) * 4
        return s

    def attributes(self) -> dict:
        self.tag()
        out = {}
        for _ in range(self.count()):
            name, kind, n = self.text(), self.tag(), self.count()
            size = n * np.dtype(KINDS[kind]).itemsize
            raw = self.d[self.i : self.i + size]
            self.i += -(-size // 4) * 4
            out[name] = raw.decode().rstrip("\0") if kind == 2 else np.frombuffer(raw, KINDS[kind]).tolist()
        return out


def parse(data: bytes) -> Header:
    c = _Cursor(data)
    n = c.count()
    c.tag()
    dims = [(c.text(), c.count()) for _ in range(c.count())]
    h = Header(n, dims, c.attributes())
    c.tag()
    for _ in range(c.count()):
        name = c.text()
        ids = [c.count() for _ in range(c.count())]
        att, kind = c.attributes(), c.tag()
        v = Variable(name, ids, att, kind, c.count(), c.place())
        v.record = bool(ids) and dims[ids[0]][1] == 0
        h.variables[name] = v
    records = [v for v in h.variables.values() if v.record]
    h.record_size = sum(v.size for v in records)
    if len(records) == 1:  # a lone record variable is not padded
        v = records[0]
        h.record_size = v.size = int(np.prod([dims[d][1] for d in v.dims[1:]] or [1])) * np.dtype(KINDS[v.kind]).itemsize
    return h


def header(path: str) -> Header:
    """Reads as much of the file's start as its header takes."""
    n = 1 << 16
    while True:
        data = files.read_bytes(path, 0, n)
        try:
            return parse(data)
        except (struct.error, UnicodeDecodeError, KeyError, ValueError):
            if len(data) < n:
                raise
            n *= 4


def read_step(path: str, h: Header, v: Variable, t: int | None) -> np.ndarray:
    """One timestep (or the whole variable) by its byte range."""
    shape, kind = h.shape(v), np.dtype(KINDS[v.kind])
    if t is None and not v.record:
        n = int(np.prod(shape or [1]))
        return np.frombuffer(files.read_bytes(path, v.begin, n * kind.itemsize), kind).reshape(shape)
    inner = shape[1:]
    n = int(np.prod(inner or [1])) * kind.itemsize
    if t is None:
        return np.stack([read_step(path, h, v, k) for k in range(shape[0])]) if shape[0] else np.zeros(shape, kind)
    at = v.begin + t * (h.record_size if v.record else n)
    return np.frombuffer(files.read_bytes(path, at, n), kind).reshape(inner)


def read_range(path: str, v: Variable, start: int, end: int) -> np.ndarray:
    """Elements ``start`` to ``end`` of a variable without a record dimension, in file order."""
    kind = np.dtype(KINDS[v.kind])
    return np.frombuffer(files.read_bytes(path, v.begin + start * kind.itemsize, (end - start) * kind.itemsize), kind)


class _Step(InputPartition):
    def __init__(self, path: str, t: int | None, at: int):
        self.path, self.t, self.at = path, t, at


class _Reader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable, self.only = path, variable, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("t_idx",):
                self.only = f.value
            yield f

    def partitions(self):
        out, base = [], 0
        for p in files.listing(self.path):
            h = header(p)
            v = h.variables[self.variable]
            n = h.describe(self.variable)["timesteps"]
            steps = range(n) if h.timed(v) else [None]
            out += [_Step(p, t, base + k) for k, t in enumerate(steps) if self.only is None or self.only == base + k]
            base += n
        return out

    def read(self, partition):
        h = header(partition.path)
        a = read_step(partition.path, h, h.variables[self.variable], partition.t)
        flat = a.reshape(-1).astype(a.dtype.newbyteorder("="))
        kind = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(flat.dtype.str[1:])
        flat = flat.astype(kind) if kind else flat
        idx = np.indices(a.shape).reshape(a.ndim, -1) if a.ndim else np.zeros((0, 1), np.int64)
        for s in range(0, len(flat), 1 << 18):
            part = slice(s, s + (1 << 18))
            cols = [pa.array(idx[d][part].astype(np.int64)) for d in range(a.ndim)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat[part]), partition.at)), *cols, pa.array(flat[part])], ["t_idx", *[f"i{d}" for d in range(a.ndim)], "value"])


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        h = header(files.listing(self.options["path"])[0])
        d = h.describe(self.options["variable"])
        return ", ".join(["t_idx long", *[f"i{k} long" for k in range(len(d["shape"]))], f"value {d['dtype']}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["variable"])


def encode(dims: dict[str, int | None], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A CDF-5 file of arrays in memory; a dimension of None is the record dimension."""
    pad = lambda b: b + bytes(-len(b) % 4)
    text = lambda s: struct.pack(">q", len(s.encode())) + pad(s.encode())

    def atts(a: dict) -> bytes:
        out = b""
        for k, v in a.items():
            if isinstance(v, str):
                out += text(k) + struct.pack(">iq", 2, len(v.encode())) + pad(v.encode())
            else:
                x = np.atleast_1d(np.asarray(v, ">f8"))
                out += text(k) + struct.pack(">iq", 6, len(x)) + x.tobytes()
        return struct.pack(">iq", 12 if a else 0, len(a)) + out

    codes = {np.dtype(v).newbyteorder("="): k for k, v in KINDS.items() if k != 2}
    names = list(dims)
    record = next((n for n in names if dims[n] is None), None)
    n_rec = max([v[1].shape[0] for v in variables.values() if v[0] and v[0][0] == record] or [0])
    lone = sum(v[0][:1] == [record] for v in variables.values()) == 1
    head = b"CDF\5" + struct.pack(">q", n_rec) + struct.pack(">iq", 10 if dims else 0, len(dims)) + b"".join(text(n) + struct.pack(">q", dims[n] or 0) for n in names) + atts(attributes or {})

    def body(a: np.ndarray) -> bytes:
        return np.ascontiguousarray(a, a.dtype.newbyteorder(">")).tobytes()

    def layout(base: int) -> tuple[bytes, dict[str, int], int]:
        out, at, places = struct.pack(">iq", 11 if variables else 0, len(variables)), base, {}
        order = sorted(variables, key=lambda n: variables[n][0][:1] == [record])
        for n in order:
            d, a, _ = variables[n]
            places[n] = at
            size = len(body(a[0])) if d[:1] == [record] else len(body(a))
            at += size if lone and d[:1] == [record] else -(-size // 4) * 4
        for n, (d, a, att) in variables.items():
            size = len(body(a[0])) if d[:1] == [record] else len(body(a))
            out += text(n) + struct.pack(">q", len(d)) + b"".join(struct.pack(">q", names.index(x)) for x in d) + atts(att) + struct.pack(">iqq", codes[a.dtype.newbyteorder("=")], -(-size // 4) * 4, places[n])
        return out, places, at

    var, _, _ = layout(0)
    var, _, _ = layout(len(head) + len(var))
    out = bytearray(head + var)
    fixed = [n for n in variables if variables[n][0][:1] != [record]]
    recs = [n for n in variables if n not in fixed]
    for n in fixed:
        out += pad(body(variables[n][1]))
    for t in range(n_rec):
        for n in recs:
            b = body(variables[n][1][t])
            out += b if lone else pad(b)
    return bytes(out)
