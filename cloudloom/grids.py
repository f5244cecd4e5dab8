"""Small dense grids of one tile: windows, holes, and the largest region."""

from __future__ import annotations

import numpy as np


def lowest(x: np.ndarray, y: np.ndarray, z: np.ndarray, size: float) -> tuple[np.ndarray, float, float]:
    """The least z of each cell (row by y, column by x), NaN without points, and the corner."""
    x0, y0 = float(x.min()), float(y.min())
    nx, ny = int(np.ceil((x.max() - x0) / size)) + 1, int(np.ceil((y.max() - y0) / size)) + 1
    out = np.full((ny, nx), np.inf)
    np.minimum.at(out, (((y - y0) / size).astype(np.int64), ((x - x0) / size).astype(np.int64)), z)
    out[np.isinf(out)] = np.nan
    return out, x0, y0


def sliding(grid: np.ndarray, size: int, how: str) -> np.ndarray:
    """min, max or median over a square about each cell, mirrored at the border."""
    pad = size // 2
    wide = np.pad(grid, pad, mode="symmetric") if pad <= min(grid.shape) else np.pad(grid, pad, mode="edge")
    if how == "median":
        return np.median(np.lib.stride_tricks.sliding_window_view(wide, (size, size)), axis=(2, 3))
    f = np.min if how == "min" else np.max
    rows = f(np.lib.stride_tricks.sliding_window_view(wide, size, axis=0), axis=2)
    return f(np.lib.stride_tricks.sliding_window_view(rows, size, axis=1), axis=2)


def fill(grid: np.ndarray, passes: int = 20) -> np.ndarray:
    """Empty cells get the mean of their filled side neighbours, pass by pass."""
    out = grid.copy()
    for _ in range(passes):
        empty = np.isnan(out)
        if not empty.any():
            break
        wide = np.pad(out, 1, constant_values=np.nan)
        sides = np.stack((wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]))
        have = (~np.isnan(sides)).sum(axis=0)
        some = empty & (have > 0)
        out[some] = np.nansum(sides, axis=0)[some] / have[some]
    return out


def sample(grid: np.ndarray, x: np.ndarray, y: np.ndarray, x0: float, y0: float, size: float, empty: float | None = None) -> np.ndarray:
    """Bilinear heights; missing corners count as the median, or what is given."""
    g = np.where(np.isnan(grid), np.nanmedian(grid) if empty is None else empty, grid)
    fx, fy = (x - x0) / size, (y - y0) / size
    c = np.clip(np.floor(fx).astype(np.int64), 0, g.shape[1] - 1)
    r = np.clip(np.floor(fy).astype(np.int64), 0, g.shape[0] - 1)
    c1, r1 = np.minimum(c + 1, g.shape[1] - 1), np.minimum(r + 1, g.shape[0] - 1)
    wx, wy = fx - c, fy - r
    return g[r, c] * (1 - wx) * (1 - wy) + g[r, c1] * wx * (1 - wy) + g[r1, c] * (1 - wx) * wy + g[r1, c1] * wx * wy


def _plus(mask: np.ndarray) -> np.ndarray:
    wide = np.pad(mask, 1)
    return wide[1:-1, 1:-1] | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]


def close_gaps(mask: np.ndarray, times: int) -> np.ndarray:
    """Widened by the side neighbours, then narrowed as often; what lies beyond the border is never set."""
    out = mask
    for _ in range(times):
        out = _plus(out)
    for _ in range(times):
        wide = np.pad(out, 1)
        out = out & wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:]
    return out


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers of side-connected regions, 0 outside: least numbers spread along rows and columns until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), np.iinfo(np.int64).max)
    while True:
        wide = np.pad(label, 1, constant_values=np.iinfo(np.int64).max)
        near = np.minimum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        new = np.where(mask, near, label)
        inside = mask & (new <= mask.size)
        flat = label.ravel()
        new[inside] = np.minimum(new[inside], flat[new[inside] - 1])  # jump to the label of the label's cell
        if (new == label).all():
            return np.where(mask, label, 0)
        label = new


def fill_enclosed(mask: np.ndarray) -> np.ndarray:
    """Holes that no way of side steps connects with the border are set."""
    outside = regions(~np.pad(mask, 1))
    return (outside != outside[0, 0])[1:-1, 1:-1] | mask


def largest(mask: np.ndarray) -> np.ndarray:
    label = regions(mask)
    if not mask.any():
        return mask
    names, n = np.unique(label[mask], return_counts=True)
    return label == names[n.argmax()]
