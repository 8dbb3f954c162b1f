"""Vectorised tokenising and hashing of Arrow text columns.

A batch of texts is one flat byte buffer with document offsets (Arrow's own
layout).  Words are runs of bytes outside ASCII white space.  A word's 64-bit
hash is a polynomial over its bytes modulo 2**64, read off prefix sums, then
mixed, so that hashing costs a few NumPy passes over the bytes and no Python
work for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LEN = np.uint64(0xA0761D6478BD642F)
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII that is neither letter nor digit: words between these carry no punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fold(buf: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capitals lowered (C3 80..9E become C3 A0..BE in UTF-8)."""
    out = LOWER[buf]
    if len(buf) > 1:
        tail = out[1:]
        tail[(buf[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept between calls up to 4 Mi entries."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        new = []
        for base in (_P, _PINV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            new.append(np.cumprod(a, dtype=np.uint64))
        if size > 1 << 22:
            return new[0], new[1]
        _powers[:] = new
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n+1 offsets; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]), offs - offs[0]


def slices(offs: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``target`` bytes each (a longer document stands alone)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + target, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def parts(column, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for slices of a text column."""
    buf, offs = flat(column)
    for a, b in slices(offs, target):
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def words(buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each document the index of its first word (n+1 entries)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~gaps[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**position, n+1 entries."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[0][: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal strings hash alike wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * _LEN)


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hash`` of words; words of over ``LONG_WORD`` bytes by XXH3, as long ones can be made to collide in any polynomial modulo 2**64."""
    h = span_hash(prefix(buf), starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        raw = buf.tobytes()
        h[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]]) for i in long.tolist()), np.uint64, len(long))
    return h


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (capitals lowered if asked) and each document's first word index."""
    starts, ends, first = words(buf, offs, gaps)
    return word_hash(fold(buf) if lower else buf, starts, ends), first


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
