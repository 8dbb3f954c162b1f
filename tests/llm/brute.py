"""Plain-Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

import xxhash


def fingerprint(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", fold)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, k=5):
    """The set of k-word shingles, ASCII and Latin-1 capitals lowered; a shorter text is one shingle."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\u0100" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(docs, length=200):
    """doc index -> (bytes, removed, spans, sha256 of what is kept)."""
    raw = [(t or "").encode() for t in docs]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes):
    """Water-filling over [(source, size)] as the contract words it: weights 1, 2, 3 in code point order, caps at 3 times the size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, (s, _) in enumerate(order)}
    size = dict(sizes)
    left, open_, out = float(sum(size.values())), set(size), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 3 * size[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 3.0 * size[s]
            open_.discard(s)
        left = sum(size.values()) - sum(out.values())
    return out
