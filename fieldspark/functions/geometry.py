"""Vectorised spherical and planar polygon geometry on padded NumPy batches.

Polygons come as (n, v, 3) unit vectors or (n, v, 2) plane points, padded by
repeating their last vertex; a batch is one Arrow batch of candidate pairs.
"""

from __future__ import annotations

import numpy as np

TOL = 1e-14


def to_xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)


def to_lonlat(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(p, axis=-1)
    return np.degrees(np.arctan2(p[..., 1], p[..., 0])) % 360, np.degrees(np.arcsin(np.clip(p[..., 2] / np.where(n > 0, n, 1), -1, 1)))


def two_sum(a, b):
    """a + b and its rounding error (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    """High and low halves of the mantissa (Dekker)."""
    c = 134217729.0 * a
    hi = c - (c - a)
    return hi, a - hi


def two_product(a, b):
    """a * b and its rounding error."""
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def orientation(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sign of det[a b c], from compensated products where plain ones leave it open."""
    det = np.einsum("...i,...i->...", np.cross(a, b), c)
    unsure = np.abs(det) < 1e-12
    if np.any(unsure):
        total, err = np.zeros_like(det), np.zeros_like(det)
        for i, j, k, s in ((0, 1, 2, 1), (1, 2, 0, 1), (2, 0, 1, 1), (0, 2, 1, -1), (2, 1, 0, -1), (1, 0, 2, -1)):
            p, e = two_product(a[..., i], b[..., j])
            q, f = two_product(s * p, c[..., k])
            total, g = two_sum(total, q)
            err = err + f + g + s * e * c[..., k]
        det = np.where(unsure, total + err, det)
    return np.sign(det)


def area(poly: np.ndarray) -> np.ndarray:
    """Spherical area by a fan from the first vertex (Van Oosterom and Strackee)."""
    a = poly[:, :1]
    b, c = poly[:, 1:-1], poly[:, 2:]
    triple = np.einsum("nvi,nvi->nv", np.broadcast_to(a, b.shape), np.cross(b, c))
    dots = 1 + (a * b).sum(-1) + (b * c).sum(-1) + (c * a).sum(-1)
    return np.abs(2 * np.arctan2(triple, dots).sum(1))


def planar_area(poly: np.ndarray) -> np.ndarray:
    x, y = poly[..., 0], poly[..., 1]
    return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def _counter_clockwise(p: np.ndarray) -> np.ndarray:
    """Spherical rings turned so that they run counter-clockwise seen from outside."""
    center = p.sum(1)
    total = np.einsum("nvi,ni->n", np.cross(p, np.roll(p, -1, 1)), center)
    return np.where((total < 0)[:, None, None], p[:, ::-1], p)


def _angular_area(points: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Area of the convex hull order of marked points (n, k, 3): sorted by angle about their mean, unmarked ones folded onto the first."""
    n = ok.sum(1)
    center = (points * ok[..., None]).sum(1) / np.maximum(n, 1)[:, None]
    size = np.linalg.norm(center, axis=1, keepdims=True)
    center = center / np.where(size > 0, size, 1)
    axis = np.where(np.abs(center[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    u = np.cross(axis, center)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    v = np.cross(center, u)
    angle = np.arctan2(np.einsum("nki,ni->nk", points, v), np.einsum("nki,ni->nk", points, u))
    angle = np.where(ok, angle, np.inf)
    order = np.argsort(angle, axis=1)
    ring = np.take_along_axis(points, order[..., None], 1)
    last = np.minimum(np.arange(points.shape[1])[None], np.maximum(n - 1, 0)[:, None])
    ring = np.take_along_axis(ring, last[..., None], 1)
    return np.where(n >= 3, area(ring), 0.0)


def overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Area that two batches of convex spherical polygons share.

    The shared polygon's corners are the corners of each that lie in the other
    and the crossings of their edges; they are ordered by angle, so repeated
    corners cost nothing.
    """
    p, q = _counter_clockwise(p), _counter_clockwise(q)
    np_, nq = np.cross(p, np.roll(p, -1, 1)), np.cross(q, np.roll(q, -1, 1))

    def inside(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
        return (np.einsum("nki,nvi->nkv", x, normals) >= -TOL).all(2)

    cross = np.cross(np_[:, :, None], nq[:, None])
    size = np.linalg.norm(cross, axis=-1, keepdims=True)
    real = size[..., 0] > 1e-15
    cross = cross / np.where(size > 1e-15, size, 1)
    k = p.shape[1] * q.shape[1]
    flat = np.concatenate([cross, -cross], 1).reshape(len(p), 2 * k, 3)
    real = np.concatenate([real, real], 1).reshape(len(p), 2 * k)
    slack = 1e-12
    meets = real & (np.einsum("nki,nvi->nkv", flat, np_) >= -slack).all(2) & (np.einsum("nki,nvi->nkv", flat, nq) >= -slack).all(2)
    points = np.concatenate([p, q, flat], 1)
    ok = np.concatenate([inside(p, nq), inside(q, np_), meets], 1)
    return _angular_area(points, ok)


def planar_overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Area that two batches of convex plane polygons share, by Sutherland-Hodgman clipping of each pair."""
    out = np.zeros(len(p))
    for n in range(len(p)):
        s, c = p[n], q[n]
        if _signed(c) < 0:
            c = c[::-1]
        for a, b in zip(c, np.roll(c, -1, 0), strict=True):
            if (a == b).all() or not len(s):
                continue
            d = (b[0] - a[0]) * (s[:, 1] - a[1]) - (b[1] - a[1]) * (s[:, 0] - a[0])
            new = []
            for i in range(len(s)):
                j = (i + 1) % len(s)
                if d[i] >= -TOL:
                    new.append(s[i])
                if (d[i] >= -TOL) != (d[j] >= -TOL):
                    new.append(s[i] + (s[j] - s[i]) * (d[i] / (d[i] - d[j])))
            s = np.array(new)
        out[n] = abs(_signed(s)) if len(s) > 2 else 0.0
    return out


def _signed(r: np.ndarray) -> float:
    x, y = r[:, 0], r[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def contains(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether convex spherical rings (n, v, 3) hold points (n, 3)."""
    p = _counter_clockwise(p)
    return (np.einsum("nvi,ni->nv", np.cross(p, np.roll(p, -1, 1)), x) >= -TOL).all(1)


def arc_meets_latitude(a: np.ndarray, b: np.ndarray, lat: float) -> np.ndarray:
    """Points where great-circle arcs (n, 3) cross a parallel: (n, 2, 3), NaN where they do not."""
    z = np.sin(np.radians(lat))
    n = np.cross(a, b)
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    h = n[:, 0] ** 2 + n[:, 1] ** 2
    base = np.stack([-n[:, 0] * n[:, 2], -n[:, 1] * n[:, 2]], 1) * z / np.maximum(h, 1e-300)[:, None]
    left = (1 - z * z) - (base**2).sum(1)
    side = np.stack([-n[:, 1], n[:, 0]], 1) / np.sqrt(np.maximum(h, 1e-300))[:, None] * np.sqrt(np.maximum(left, 0))[:, None]
    out = np.stack([np.c_[base + side, np.full(len(a), z)], np.c_[base - side, np.full(len(a), z)]], 1)
    on = (np.einsum("nki,ni->nk", np.cross(a[:, None], out), n) >= -1e-12) & (np.einsum("nki,ni->nk", np.cross(out, b[:, None]), n) >= -1e-12)
    return np.where((on & (left >= 0)[:, None] & (h > 1e-30)[:, None])[..., None], out, np.nan)


def gnomonic(p: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Tangent-plane coordinates (…, 2) about unit vectors ``center``."""
    axis = np.where(np.abs(center[..., 2:]) < 0.9, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0])
    u = np.cross(axis, center)
    u = u / np.linalg.norm(u, axis=-1, keepdims=True)
    v = np.cross(center, u)
    d = (p * center).sum(-1)
    return np.stack([(p * u).sum(-1) / d, (p * v).sum(-1) / d], -1)


def inverse_bilinear(quad: np.ndarray, x: np.ndarray, rounds: int = 25) -> np.ndarray | None:
    """(s, t) in [0, 1] of a point in a plane quad by Newton steps, or None outside or where they fail."""
    s = t = 0.5
    a, b, c, d = quad
    for _ in range(rounds):
        f = (1 - s) * (1 - t) * a + s * (1 - t) * b + s * t * c + (1 - s) * t * d - x
        if np.abs(f).max() < 1e-12:
            break
        ds = (1 - t) * (b - a) + t * (c - d)
        dt = (1 - s) * (d - a) + s * (c - b)
        det = ds[0] * dt[1] - ds[1] * dt[0]
        if abs(det) < 1e-14:
            return None
        s -= (f[0] * dt[1] - f[1] * dt[0]) / det
        t -= (ds[0] * f[1] - ds[1] * f[0]) / det
    if not (-1e-9 <= s <= 1 + 1e-9 and -1e-9 <= t <= 1 + 1e-9):
        return None
    s, t = min(max(s, 0.0), 1.0), min(max(t, 0.0), 1.0)
    return np.array([(1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t])


def barycentric(tri: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Weights of a point in a plane triangle, or None outside it."""
    a, b, c = tri
    det = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    if abs(det) < 1e-14:
        return None
    u = ((b[1] - c[1]) * (x[0] - c[0]) + (c[0] - b[0]) * (x[1] - c[1])) / det
    v = ((c[1] - a[1]) * (x[0] - c[0]) + (a[0] - c[0]) * (x[1] - c[1])) / det
    w = np.array([u, v, 1 - u - v])
    return np.clip(w, 0, 1) if (w >= -1e-9).all() else None


def inverse_distance(d2: np.ndarray) -> np.ndarray:
    """Weights by inverse squared distance; a point at distance 0 takes all."""
    if (d2 < 1e-24).any():
        w = (d2 == d2.min()).astype(float)
    else:
        w = 1 / d2
    return w / w.sum()


def crosses_dateline(lons: np.ndarray) -> np.ndarray:
    """Whether rings (n, v) of longitudes jump by more than 180 degrees."""
    return (np.abs(np.diff(np.c_[lons, lons[:, :1]], axis=1)) > 180).any(1)


def self_intersects(ring: np.ndarray) -> bool:
    """Whether any two edges that do not touch cross, on the sphere (v, 3)."""
    v = len(ring)
    edges = [(ring[i], ring[(i + 1) % v]) for i in range(v)]
    for i in range(v):
        for j in range(i + 2, v):
            if i == 0 and j == v - 1:
                continue
            (a, b), (c, d) = edges[i], edges[j]
            if orientation(a, b, c) * orientation(a, b, d) < 0 and orientation(c, d, a) * orientation(c, d, b) < 0 and np.dot(a + b, c + d) > 0:
                return True
    return False


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per-column coefficients of the tension spline, columns (n, levels) over shared or own levels.

    The tridiagonal system is that of second derivatives, so a straight line
    gets 0; the evaluation below takes them as they are.
    """
    n = y.shape[1]
    if n == 2:
        return np.repeat((y[:, 1:] - y[:, :1]) / (x[:, 1:] - x[:, :1]), 2, 1)
    gap = np.maximum(np.diff(x, axis=1), 1e-15)
    rise = np.diff(y, axis=1) / gap
    upper, d = np.zeros_like(y), np.zeros_like(y)
    for i in range(1, n - 1):
        pivot = 2 * (gap[:, i - 1] + gap[:, i]) - gap[:, i - 1] * upper[:, i - 1]
        pivot = np.where(pivot == 0, 1e-15, pivot)
        upper[:, i] = gap[:, i] / pivot
        d[:, i] = (3 * (rise[:, i] - rise[:, i - 1]) - gap[:, i - 1] * d[:, i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        d[:, i] -= upper[:, i] * d[:, i + 1]
    return d


def spline_values(x: np.ndarray, y: np.ndarray, d: np.ndarray, at: np.ndarray, tension: float) -> np.ndarray:
    """Spline values at targets (n, m); targets outside the levels use the end segments."""
    k = np.clip((at[:, :, None] >= x[:, None, :]).sum(2) - 1, 0, x.shape[1] - 2)
    take = lambda a, j: np.take_along_axis(a, j, 1)
    x0, x1, y0, y1, d0, d1 = (take(a, j) for a in (x, y, d) for j in (k, k + 1))
    dx = x1 - x0
    t = (at - x0) / np.where(dx > 0, dx, 1)
    u = 1 - t
    if tension <= 0:
        v = y0 * (1 + 2 * t) * u**2 + y1 * t**2 * (3 - 2 * t) + dx * (d0 * t * u**2 + d1 * t**2 * (t - 1))
    else:
        sh = np.sinh(tension)
        if sh == 0:
            return y0
        den = tension * np.cosh(tension) - sh or 1e-15
        rise = y1 - y0
        v = y0 * u + y1 * t + ((d0 * dx - rise) * (np.sinh(tension * u) - u * sh) + (d1 * dx - rise) * (np.sinh(tension * t) - t * sh)) / den
    return np.where(dx > 0, v, y0)
