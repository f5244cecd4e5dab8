"""Balls about points without a pair on any shuffle: boxes of space go to tasks, each with the points around it, and pairs are met there.

A box holds some thousand points, fewer where they are crowded, and is no smaller than the radius allows; so a point goes to a bounded number of boxes, and
what leaves a task is a row or so for each of its points. Points in one place are one spot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import _leaves, cell
from .lineage import bounded, settle

AIM = 1 << 14


def has_place(dims: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, [F.abs(F.col(d)) < F.lit(math.inf) for d in dims]), F.lit(False))


def finite(df: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Rows with a place: others are near nothing."""
    return df.where(has_place(dims))


def ball_tasks(probe: DataFrame, build: DataFrame, radius: float, dims: tuple[str, ...], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: tuple[str, ...] = (), aim: int = AIM, least: float = 2.0) -> DataFrame:
    """run(mine, near) for each box: its probe rows, and all build rows in it or within the radius of it. by: columns that must be equal.
    least: of a box, in radii.

    Boxes of very many probe rows are dealt to several tasks, each with the same near rows.
    """
    spots = build.select(*dims).unionByName(probe.select(*dims))
    row = spots.agg(F.count(F.lit(1)), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    low, wide = [float(v or 0.0) for v in row[1::2]], [float(b - a) if b is not None else 0.0 for a, b in zip(row[1::2], row[2::2])]
    groups = max(1, build.select(*by).distinct().count()) if by else 1
    aim = max(1, min(aim * groups, max(row[0] // 64, 1024 * groups)))
    d = max(1, sum(w > 0 for w in wide))
    floor = least * radius
    edge = max(floor, (math.prod([w for w in wide if w > 0] or [1.0]) * aim / max(row[0], 1)) ** (1 / d), max(wide) * 1e-6)
    deepest = max(0, int(math.log2(edge / floor)))
    keys = [f"c{i}" for i in range(len(dims))]
    leaves = settle(_leaves(spots, edge, dims, aim, deepest).select("l", *keys, F.ceil(F.col("n") / (8 * aim)).cast("int").alias("chunks")))
    levels = sorted(r[0] for r in leaves.select("l").distinct().collect())  # a number a halving
    group, reach = ["l", *keys, "chunk", *by], F.lit(radius * (1 + 1e-9))
    asked = offered = None
    for level in levels:
        own = edge / 2**level
        there = leaves.where(F.col("l") == level)
        mine = probe.withColumns({k: cell(c, own) for k, c in zip(keys, dims)}).join(bounded(there), keys)
        mine = mine.withColumn("chunk", F.pmod(F.xxhash64(*dims), F.col("chunks")).cast("int")).select(*[F.col(g).alias("_" + g) for g in group], *[F.col(c).alias(c) for c in probe.columns])
        asked = mine if asked is None else asked.unionByName(mine)
        boxes = there
        for i, k in enumerate(keys):
            boxes = boxes.withColumns({f"lo{i}": F.col(k) * own - reach, f"hi{i}": (F.col(k) + 1) * own + reach})
        for i in range(len(keys)):
            boxes = boxes.withColumn(f"g{i}", F.explode(F.sequence(F.floor(F.col(f"lo{i}") / own), F.floor(F.col(f"hi{i}") / own))))
        boxes = boxes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        gridded = build.withColumns({f"q{i}": F.floor(F.col(c) / own) for i, c in enumerate(dims)})
        on = reduce(lambda a, b: a & b, [F.col(f"g{i}") == F.col(f"q{i}") for i in range(len(dims))] + [F.col(c).between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i, c in enumerate(dims)])
        # All columns of the two sides differ in name, or Spark takes one for the other.
        theirs = gridded.join(bounded(boxes), on).select(*[F.col(g).alias("_n_" + g) for g in group], *[F.col(c).alias("n_" + c) for c in build.columns])
        offered = theirs if offered is None else offered.unionByName(theirs)
    if asked is None:
        return probe.sparkSession.createDataFrame([], schema)
    mine_names, near_names = probe.columns, build.columns
    task = lambda mine, near: run(mine.select(mine_names), near.select(["n_" + c for c in near_names]).rename_columns(near_names))
    return asked.groupBy(*["_" + g for g in group]).cogroup(offered.groupBy(*["_n_" + g for g in group])).applyInArrow(task, schema)


def places(table: pa.Table, dims: tuple[str, ...]) -> np.ndarray:
    return np.stack([table[d].to_numpy() for d in dims], axis=1).astype(np.float64) if table.num_rows else np.zeros((0, len(dims)))


def blocks(p: np.ndarray, b: np.ndarray, radius: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d2): some rows of p, all rows of b that may be within the radius of them, rising, and the squared distances. Every row of p comes once, unless b has nothing near."""
    if not len(p) or not len(b):
        return
    d = p.shape[1]
    low = np.minimum(p.min(0), b.min(0))
    wide = np.maximum(p.max(0), b.max(0)) - low
    size = max(radius * (1 + 1e-6), (np.prod(np.maximum(wide, radius)) * 16 / len(b)) ** (1 / d))
    shape = np.floor(wide / size).astype(np.int64) + 3
    stride = np.array([np.prod(shape[k + 1 :]) for k in range(d)], dtype=np.int64)
    code = lambda a: (np.floor((a - low) / size).astype(np.int64) + 1) @ stride
    cb, cp = code(b), code(p)
    ob, op = np.argsort(cb, kind="stable"), np.argsort(cp, kind="stable")
    cb = cb[ob]
    cells, first = np.unique(cp[op], return_index=True)
    last = np.append(first[1:], len(p))
    moves = np.array([np.dot(o, stride[:-1]) for o in product((-1, 0, 1), repeat=d - 1)], dtype=np.int64)
    starts = np.searchsorted(cb, cells[:, None] + moves[None, :] - 1, "left")
    ends = np.searchsorted(cb, cells[:, None] + moves[None, :] + 1, "right")
    for f, t, ss, ee in zip(first.tolist(), last.tolist(), starts.tolist(), ends.tolist()):
        runs = [ob[s:e] for s, e in zip(ss, ee) if e > s]
        if not runs:
            continue
        j = np.sort(np.concatenate(runs))
        step = max(1, most // len(j))
        for lo in range(f, t, step):
            i = op[lo : min(t, lo + step)]
            d2 = None
            for k in range(d):
                off = p[i, k][:, None] - b[j, k][None, :]
                off *= off
                d2 = off if d2 is None else d2 + off
            yield i, j, d2


class _Tree:
    """A balanced tree over rows: nodes of order[start:end], in the order of their depth, with the boxes of their points."""

    def __init__(self, p: np.ndarray, spatial: int, leaf: int = 32):
        self.order = np.arange(len(p))
        start, end, self.left, depth = [0], [len(p)], [-1], [0]
        at = 0
        while at < len(start):
            s, e = start[at], end[at]
            if e - s > leaf:
                own = p[self.order[s:e]]
                wide = own.max(0) - own.min(0)
                # Columns that do not count for distances only part what is in one place.
                k = int(wide[:spatial].argmax()) if wide[:spatial].max() > 0 else int(wide.argmax())
                mid = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, k], mid)]
                self.left[at] = len(start)
                start += [s, s + mid]
                end += [s + mid, e]
                self.left += [-1, -1]
                depth += [depth[at] + 1] * 2
            at += 1
        self.start, self.end, self.left, depth = np.array(start), np.array(end), np.array(self.left), np.array(depth)
        self.leaf = self.left < 0
        self.levels = [np.flatnonzero((depth == k) & ~self.leaf) for k in range(depth.max() + 1)]
        self.lo, self.hi = self.up(p, np.minimum), self.up(p, np.maximum)

    def up(self, v: np.ndarray, f: np.ufunc) -> np.ndarray:
        """Of each node what f makes of its rows' values."""
        own = np.flatnonzero(self.leaf)
        own = own[np.argsort(self.start[own])]
        out = np.empty((len(self.start), *v.shape[1:]), dtype=v.dtype)
        out[own] = f.reduceat(v[self.order], self.start[own], axis=0)
        for level in reversed(self.levels):
            out[level] = f(out[self.left[level]], out[self.left[level] + 1])
        return out

    def down(self, v: np.ndarray, f: np.ufunc) -> np.ndarray:
        """Of each row what f makes of the values of all nodes about it."""
        v = v.copy()
        for level in self.levels:
            for side in (0, 1):
                v[self.left[level] + side] = f(v[self.left[level] + side], v[level])
        own = np.flatnonzero(self.leaf)
        out = np.empty(len(self.order), dtype=v.dtype)
        out[self.order[np.concatenate([np.arange(s, e) for s, e in zip(self.start[own], self.end[own])])]] = np.repeat(v[own], self.end[own] - self.start[own])
        return out

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, there): a line a leaf, filled up to the longest."""
        n = self.end[nodes] - self.start[nodes]
        k = np.arange(n.max())
        there = k[None, :] < n[:, None]
        return self.order[np.where(there, self.start[nodes][:, None] + k[None, :], self.start[nodes][:, None])], there


def _squares(offs: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda a, b: a + b, [o * o for o in offs])


def node_pairs(a: _Tree, b: _Tree, limit: float, spatial: int, apart: bool = False) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("inside", nodes, nodes) wholly within the distance of each other, ("rim", leaves, leaves) to be looked at; apart: none inside whose boxes meet."""
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(x):
        gap = [np.maximum(0.0, np.maximum(a.lo[x, k] - b.hi[y, k], b.lo[y, k] - a.hi[x, k])) for k in range(a.lo.shape[1])]
        near = _squares(gap[:spatial]) <= limit
        x, y, gap = x[near], y[near], [g[near] for g in gap]
        within = _squares([np.maximum(a.hi[x, k] - b.lo[y, k], b.hi[y, k] - a.lo[x, k]) for k in range(spatial)]) <= limit
        if apart:
            within &= reduce(lambda p, q: p + q, gap) > 0
        if within.any():
            yield "inside", x[within], y[within]
        x, y = x[~within], y[~within]
        ends = a.leaf[x] & b.leaf[y]
        if ends.any():
            yield "rim", x[ends], y[ends]
        x, y = x[~ends], y[~ends]
        first = ~a.leaf[x] & (b.leaf[y] | (a.end[x] - a.start[x] >= b.end[y] - b.start[y]))
        p, q = x[first], y[first]
        r, s = x[~first], y[~first]
        x = np.concatenate((a.left[p], a.left[p] + 1, r, r))
        y = np.concatenate((q, q, b.left[s], b.left[s] + 1))


_HOW = {"sum": (np.add, F.sum), "min": (np.minimum, F.min), "max": (np.maximum, F.max)}


def _neutral(how: str, kind: np.dtype):
    if how == "sum":
        return kind.type(0)
    worst = (np.iinfo(kind).max, np.iinfo(kind).min) if kind.kind == "i" else (np.inf, -np.inf)
    return kind.type(worst[how == "max"])


def aggregate_spots(probe: DataFrame, build: DataFrame, radius: float, dims: tuple[str, ...], values: dict[str, str], more: tuple[str, ...] = (), others: bool = False, by: tuple[str, ...] = (), aim: int = AIM) -> DataFrame:
    """(spot, *values): of each probe spot (spot, dims) the sum, minimum or maximum of the build spots' column of that name within the radius.

    Spots that meet nothing get no row. others: a spot is no neighbour of itself unless its n, a column of build, is above 1; probe is build then,
    and ``more`` tells spots in one place apart. Boxes of spots meet first: those wholly inside count with what they add up to.
    """
    kinds = {f.name: f.dataType.simpleString() for f in build.schema.fields}
    limit = float(radius) * float(radius)
    tree_dims, k = (*dims, *more), len(dims)

    def run(mine: pa.Table, near: pa.Table) -> pa.Table:
        size = mine.num_rows
        columns, met = {}, np.zeros(size, bool)
        loaded = {}
        for n, how in values.items():
            kind = np.dtype(np.float64 if kinds[n] in ("double", "float") else np.int64)
            none = _neutral(how, kind)
            v = near[n].combine_chunks()
            v = np.where(v.is_null().to_numpy(zero_copy_only=False), none, np.nan_to_num(v.to_numpy(zero_copy_only=False), nan=none if kind.kind == "f" else 0)).astype(kind) if v.null_count else v.to_numpy(zero_copy_only=False).astype(kind)
            loaded[n] = (how, _HOW[how][0], none, v)
            columns[n] = np.full(size, none, kind)
        if size and near.num_rows:
            p, b = places(mine, tree_dims), places(near, tree_dims)
            p, b = np.nan_to_num(p), np.nan_to_num(b)
            a, t = _Tree(p, k), _Tree(b, k)
            sums = {n: t.up(v, f) for n, (_, f, _, v) in loaded.items()}
            whole = {n: np.full(len(a.start), none, v.dtype) for n, (_, _, none, v) in loaded.items()}
            full = np.zeros(len(a.start), bool)
            ids, ids_b = mine["spot"].to_numpy(), near["spot"].to_numpy() if others else None
            lone = near["n"].to_numpy() == 1 if others else None
            for what, x, y in node_pairs(a, t, limit, k, others):
                if what == "inside":
                    for n, (_, f, _, _) in loaded.items():
                        f.at(whole[n], x, sums[n][y])
                    full[x] = True
                    continue
                for lo in range(0, len(x), 1000):
                    i, mi = a.rows(x[lo : lo + 1000])
                    j, mj = t.rows(y[lo : lo + 1000])
                    hit = _squares([p[i, c][:, :, None] - b[j, c][:, None, :] for c in range(k)]) <= limit
                    hit &= mi[:, :, None] & mj[:, None, :]
                    if others:
                        hit &= ~((ids[i][:, :, None] == ids_b[j][:, None, :]) & lone[j][:, None, :])
                    np.logical_or.at(met, i[mi], hit.any(axis=2)[mi])
                    for n, (how, f, none, v) in loaded.items():
                        got = np.einsum("mij,mj->mi", hit, v[j]) if how == "sum" else f.reduce(np.where(hit, v[j][:, None, :], none), axis=2)
                        f.at(columns[n], i[mi], got[mi])
            for n, (_, f, _, _) in loaded.items():
                columns[n] = f(columns[n], a.down(whole[n], f))
            met |= a.down(full, np.logical_or)
        out = {"spot": mine["spot"]} | {n: pa.array(c, mask=(c == loaded[n][2]) if loaded[n][0] != "sum" else None) for n, c in columns.items()}
        return pa.table(out).filter(pa.array(met))

    own = build.select(*(("spot", "n") if others else ()), *tree_dims, *by, *[v for v in values if v not in (*tree_dims, "n" if others else "")])
    schema = "spot long, " + ", ".join(f"`{n}` {'double' if kinds[n] in ('double', 'float') else 'long'}" for n in values)
    return ball_tasks(probe.select("spot", *tree_dims, *by), own, radius, dims, run, schema, by, aim)


class Unions:
    """Sets of rows that edges join; the least row names a set. Edges are taken in by the million."""

    def __init__(self, n: int):
        self.parent, self.held, self.n = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.parent[a] != self.parent[b]
        if new.any():
            self.held.append((a[new], b[new]))
            self.n += int(new.sum())
            if self.n > 1_000_000:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(c) for c in zip(*self.held))
            self.held, self.n = [], 0
            while True:
                a, b = self.parent[a], self.parent[b]
                a, b = a[a != b], b[a != b]
                if not len(a):
                    break
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := self.parent[self.parent], self.parent):
                    self.parent = up
        return self.parent


def join_steps(sets: Unions, p: np.ndarray, at: np.ndarray, radius: float, step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], may: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] | None = None) -> int:
    """Joins the rows ``at`` of p with all rows that a step within the radius leads to; gives the number of pairs looked at.

    Boxes of rows meet, first within small distances, then larger ones up to the radius. Those that are one set already are passed over, so a crowd costs about
    as much as its nearest steps. may(least, most): which boxes may have a step, by the bounds of their differences along each axis.
    """
    d, looked = p.shape[1], 0
    a, t = _Tree(p[at], d, 12), _Tree(p, d, 12)
    own, every = at[a.order], t.order
    leaves_a, leaves_t = (k[np.argsort(r[k])] for k, r in ((np.flatnonzero(a.leaf), a.start), (np.flatnonzero(t.leaf), t.start)))

    def named() -> list[np.ndarray]:
        """Of each node the set that all of its rows are in; those of several sets have a number of their own."""
        out = []
        for tree, rows, first, sign in ((a, own, leaves_a, -1), (t, every, leaves_t, -2)):
            v, lo, hi = sets.parent[rows], np.empty(len(tree.start), np.int64), np.empty(len(tree.start), np.int64)
            lo[first], hi[first] = np.minimum.reduceat(v, tree.start[first]), np.maximum.reduceat(v, tree.start[first])
            for level in reversed(tree.levels):
                lo[level] = np.minimum(lo[tree.left[level]], lo[tree.left[level] + 1])
                hi[level] = np.maximum(hi[tree.left[level]], hi[tree.left[level] + 1])
            out.append(np.where(lo == hi, lo, sign))
        return out

    for part in (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0):
        limit, stack, names = float(radius * part) * float(radius * part), [(np.zeros(1, np.int64), np.zeros(1, np.int64))], named()
        while stack:
            x, y = stack.pop()
            apart = names[0][x] != names[1][y]
            x, y = x[apart], y[apart]
            gap = [np.maximum(0.0, np.maximum(a.lo[x, k] - t.hi[y, k], t.lo[y, k] - a.hi[x, k])) for k in range(d)]
            near = _squares(gap) <= limit
            if may is not None:
                near &= may(gap, [np.maximum(a.hi[x, k] - t.lo[y, k], t.hi[y, k] - a.lo[x, k]) for k in range(d)])
            x, y = x[near], y[near]
            ends = a.leaf[x] & t.leaf[y]
            u, v = x[ends], y[ends]
            for lo in range(0, len(u), 2000):
                k, m = u[lo : lo + 2000], v[lo : lo + 2000]
                if lo:
                    apart = names[0][k] != names[1][m]
                    k, m = k[apart], m[apart]
                if not len(k):
                    continue
                i, mi = a.rows(k)
                j, mj = t.rows(m)
                i = at[i]
                hit = _squares([p[i, c][:, :, None] - p[j, c][:, None, :] for c in range(d)]) <= limit
                hit &= mi[:, :, None] & mj[:, None, :] & (sets.parent[i][:, :, None] != sets.parent[j][:, None, :])
                looked += hit.size
                b, r, c = np.nonzero(hit)
                i, j = i[b, r], j[b, c]
                good = step(p, i, j)
                if good.any():
                    sets.add(i[good], j[good])
                    sets.settle()
                    names = named()
            x, y = x[~ends], y[~ends]
            first = ~a.leaf[x] & (t.leaf[y] | (a.end[x] - a.start[x] >= t.end[y] - t.start[y]))
            q, r, u, v = x[first], y[first], x[~first], y[~first]
            x, y = np.concatenate((a.left[q], a.left[q] + 1, u, u)), np.concatenate((r, r, t.left[v], t.left[v] + 1))
            stack += [(x[lo : lo + 65536], y[lo : lo + 65536]) for lo in range(0, len(x), 65536)]
    return looked


def linked_spots(
    spots: DataFrame, radius: float, dims: tuple[str, ...], by: tuple[str, ...] = (), step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, aim: int = AIM,
    may: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """(spot, label): spots joined by steps within the radius; the least spot of a set names it.

    Each box joins what it sees; only the names that a spot got in different boxes are edges of a graph. step(p, i, j): which pairs of rows of p,
    all within the radius, are steps; by default all. may: see ``join_steps``.
    """
    from .graph import components

    limit = float(radius) * float(radius)

    def run(mine: pa.Table, near: pa.Table) -> pa.Table:
        near = near.take(pa.array(np.argsort(near["spot"].to_numpy(), kind="stable")))
        ids, p = near["spot"].to_numpy(), places(near, dims)
        own = np.isin(ids, mine["spot"].to_numpy())
        at = np.flatnonzero(own)
        sets = Unions(len(ids))
        if len(at) and step is None:
            a, t = _Tree(p[at], len(dims)), _Tree(p, len(dims))
            for what, x, y in node_pairs(a, t, limit, len(dims)):
                if what == "inside":
                    # Every row of one node is joined with every row of the other: with its first row, then.
                    heads_a, heads_t = at[a.order[a.start[x]]], t.order[t.start[y]]
                    for side, nodes, order, heads in ((a, x, at[a.order], heads_t), (t, y, t.order, heads_a)):
                        n = side.end[nodes] - side.start[nodes]
                        for lo in range(0, len(nodes), 4096):
                            m = n[lo : lo + 4096]
                            rows = order[np.repeat(side.start[nodes][lo : lo + 4096] - np.append(0, m.cumsum()[:-1]), m) + np.arange(m.sum())]
                            sets.add(rows, np.repeat(heads[lo : lo + 4096], m))
                    continue
                for lo in range(0, len(x), 1000):
                    i, mi = a.rows(x[lo : lo + 1000])
                    j, mj = t.rows(y[lo : lo + 1000])
                    i = at[i]
                    hit = _squares([p[i, c][:, :, None] - p[j, c][:, None, :] for c in range(len(dims))]) <= limit
                    hit &= mi[:, :, None] & mj[:, None, :] & (sets.parent[i][:, :, None] != sets.parent[j][:, None, :])
                    m, r, c = np.nonzero(hit)
                    sets.add(i[m, r], j[m, c])
        elif len(at):
            join_steps(sets, p, at, radius, step, may)
        root = sets.settle()
        seen = own | (np.bincount(root, minlength=len(ids))[root] > 1)
        return pa.table({"spot": ids[seen], "root": ids[root[seen]], "own": own[seen]})

    named = settle(ball_tasks(spots.select("spot", *dims, *by), spots.select("spot", *dims, *by), radius, dims, run, "spot long, root long, own boolean", by, aim, least=2.0 if step is None else 4.0))
    own, guests = named.where("own").select("spot", "root"), named.where("not own").select(F.col("spot").alias("guest"), F.col("root").alias("b"))
    edges = settle(guests.join(own, F.col("guest") == F.col("spot")).select(F.col("root").alias("a"), "b").where("a <> b").distinct())
    if edges.isEmpty():
        return own.select("spot", F.col("root").alias("label"))
    labels = settle(components(edges)).withColumnRenamed("label", "_label")
    return own.join(labels, F.col("root") == F.col("v"), "left").select("spot", F.coalesce("_label", "root").alias("label"))
