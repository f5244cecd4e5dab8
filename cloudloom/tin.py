"""Delaunay triangulation of the points of one tile, and location of points in it."""

from __future__ import annotations

import numpy as np

try:
    from scipy.spatial import Delaunay as _Fast
except ImportError:
    _Fast = None


def _order(xy: np.ndarray) -> np.ndarray:
    """Rows of a grid, every second one backwards, so that neighbours follow one another."""
    low, span = xy.min(axis=0), np.maximum(np.ptp(xy, axis=0), 1e-12)
    n = max(1, int(np.sqrt(len(xy) / 4)))
    cell = np.minimum(((xy - low) / span * n).astype(np.int64), n - 1)
    along = np.where(cell[:, 1] % 2 == 0, cell[:, 0], n - 1 - cell[:, 0])
    return np.lexsort((along, cell[:, 1]))


def triangles(xy: np.ndarray, jitter: float = 1e-9) -> np.ndarray:
    """Corners (n, 3) of the Delaunay triangles of distinct points, counter-clockwise. Fewer than three points, or all on a line: none.

    jitter: a shift, as a share of the extent, that chooses among several triangulations; 0 for points that are in general position already.
    """
    xy = np.asarray(xy, dtype=np.float64)
    if len(xy) < 3:
        return np.zeros((0, 3), dtype=np.int64)
    if _Fast is not None:
        try:
            t = _Fast(xy).simplices.astype(np.int64)
        except Exception:
            return np.zeros((0, 3), dtype=np.int64)
        a, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
        turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        t[turn < 0] = t[turn < 0][:, ::-1]
        return t
    return _insert_all(xy, jitter)


def _insert_all(xy: np.ndarray, jitter: float) -> np.ndarray:
    """Points are inserted one by one: those triangles go whose circumcircle holds the point, and their outline is joined to it."""
    n = len(xy)
    low, span = xy.min(axis=0), float(np.ptp(xy, axis=0).max()) or 1.0
    # A tiny seeded shift: points on a grid or a circle have several triangulations, any one will do.
    at = (xy - low) / span + np.random.default_rng(0).uniform(-jitter, jitter, xy.shape)
    far = 1e4
    x = [*at[:, 0].tolist(), -far, far, 0.0]
    y = [*at[:, 1].tolist(), -far, -far, far]
    first = (n, n + 1, n + 2)
    owner = {(first[k], first[(k + 1) % 3]): first for k in range(3)}  # directed edge: its triangle
    last = first

    def turn(a: int, b: int, px: float, py: float) -> float:
        return (x[b] - x[a]) * (py - y[a]) - (y[b] - y[a]) * (px - x[a])

    def holds(t: tuple, px: float, py: float) -> bool:
        ax, ay, bx, by, cx, cy = x[t[0]] - px, y[t[0]] - py, x[t[1]] - px, y[t[1]] - py, x[t[2]] - px, y[t[2]] - py
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0

    for p in _order(at).tolist():
        px, py, t, steps = x[p], y[p], last, 0
        while steps < 4 * n + 16:  # walk towards the point
            steps += 1
            for k in range(3):
                a, b = t[k], t[(k + 1) % 3]
                if turn(a, b, px, py) < 0 and (b, a) in owner:
                    t = owner[b, a]
                    break
            else:
                break
        bad, todo, outline = {t}, [t], []
        while todo:
            s = todo.pop()
            for k in range(3):
                a, b = s[k], s[(k + 1) % 3]
                other = owner.get((b, a))
                if other in bad:
                    continue
                if other is not None and holds(other, px, py):
                    bad.add(other)
                    todo.append(other)
                else:
                    outline.append((a, b))
        outline = [(a, b) for a, b in outline if owner.get((b, a)) not in bad]
        for s in bad:
            for k in range(3):
                owner.pop((s[k], s[(k + 1) % 3]), None)
        for a, b in outline:
            last = (a, b, p)
            owner[a, b] = owner[b, p] = owner[p, a] = last
    out = {t for t in owner.values() if max(t) < n}
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


def locate(xy: np.ndarray, t: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The triangle of each point, -1 outside, and its three weights. Triangles are binned to cells, points meet those of their cell."""
    found, weights = np.full(len(points), -1, dtype=np.int64), np.zeros((len(points), 3))
    if not len(t) or not len(points):
        return found, weights
    a, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
    low, high = xy.min(axis=0), xy.max(axis=0)
    n = max(1, int(np.sqrt(len(t))))
    size = np.maximum((high - low) / n, 1e-12)
    cell = lambda p: np.clip(((p - low) / size).astype(np.int64), 0, n - 1)
    lo, hi = cell(np.minimum(np.minimum(a, b), c)), cell(np.maximum(np.maximum(a, b), c))
    wide, tall = hi[:, 0] - lo[:, 0] + 1, hi[:, 1] - lo[:, 1] + 1
    many = wide * tall
    of = np.repeat(np.arange(len(t)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    key = (lo[of, 1] + k // wide[of]) * n + lo[of, 0] + k % wide[of]
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    inside = ((points >= low) & (points <= high)).all(axis=1)
    own = np.flatnonzero(inside)
    at = cell(points[own])
    want = at[:, 1] * n + at[:, 0]
    begin, end = np.searchsorted(key, want), np.searchsorted(key, want, side="right")
    for start in range(0, len(own), 200_000):
        part = slice(start, start + 200_000)
        many = end[part] - begin[part]
        p = np.repeat(own[part], many)
        s = of[np.repeat(begin[part], many) + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)]
        d = (b[s, 1] - c[s, 1]) * (a[s, 0] - c[s, 0]) + (c[s, 0] - b[s, 0]) * (a[s, 1] - c[s, 1])
        good = np.abs(d) >= 1e-12
        d = np.where(good, d, 1.0)
        w0 = ((b[s, 1] - c[s, 1]) * (points[p, 0] - c[s, 0]) + (c[s, 0] - b[s, 0]) * (points[p, 1] - c[s, 1])) / d
        w1 = ((c[s, 1] - a[s, 1]) * (points[p, 0] - c[s, 0]) + (a[s, 0] - c[s, 0]) * (points[p, 1] - c[s, 1])) / d
        w2 = 1.0 - w0 - w1
        hit = np.flatnonzero(good & (w0 >= -1e-9) & (w1 >= -1e-9) & (w2 >= -1e-9))
        first = hit[np.unique(p[hit], return_index=True)[1]]
        found[p[first]] = s[first]
        weights[p[first]] = np.stack((w0[first], w1[first], w2[first]), axis=1)
    return found, weights


def interpolate(xy: np.ndarray, z: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Heights between the triangles' corners; NaN outside."""
    t = triangles(xy)
    at, w = locate(xy, t, points)
    out = np.full(len(points), np.nan)
    ok = at >= 0
    out[ok] = (z[t[at[ok]]] * w[ok]).sum(axis=1)
    return out
