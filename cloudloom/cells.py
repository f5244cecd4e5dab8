"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import bounded, settle


def cell(name: str, size: float) -> Column:
    return F.floor(F.col(name) / F.lit(float(size))).cast("long")


def _offsets(reach: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1)]))


def _neighbour_cells(df: DataFrame, dims: tuple[str, ...], size: float, reach: int) -> DataFrame:
    """Each row once for every cell within reach of its own, in columns c0, c1, ..."""
    for i, d in enumerate(dims):
        df = df.withColumn(f"o{i}", _offsets(reach)).withColumn(f"c{i}", cell(d, size) + F.col(f"o{i}")).drop(f"o{i}")
    return df


def radius_join(probe: DataFrame, build: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y", "z"), prefix: str = "n_") -> DataFrame:
    """Pairs no farther apart than radius, a point and itself included. Build columns get the prefix; d2 is the squared distance.

    The cell edge is the radius, so a probe row meets 3 ** len(dims) cells; both sides shuffle on cells and dense cells can be split.
    """
    right = build.select(*[F.col(c).alias(prefix + c) for c in build.columns])
    for i, d in enumerate(dims):
        right = right.withColumn(f"b{i}", F.floor(F.col(prefix + d) / F.lit(float(radius))).cast("long"))
    left = _neighbour_cells(probe, dims, radius, 1)
    on = reduce(lambda a, b: a & b, [F.col(f"c{i}") == F.col(f"b{i}") for i in range(len(dims))])
    d2 = reduce(lambda a, b: a + b, [(F.col(d) - F.col(prefix + d)) * (F.col(d) - F.col(prefix + d)) for d in dims])
    joined = left.join(right, on).withColumn("d2", d2).where(F.col("d2") <= F.lit(float(radius) * float(radius)))
    return joined.drop(*[f"c{i}" for i in range(len(dims))], *[f"b{i}" for i in range(len(dims))])


def _leaves(spots: DataFrame, edge: float, dims: tuple[str, ...], aim: int, deepest: int = 24) -> DataFrame:
    """(l, c0, c1, ..., n): cells that cover all spots; the edge halves l times where more than four times ``aim`` spots share a cell."""
    keys = [f"c{i}" for i in range(len(dims))]
    at = lambda level: [cell(d, edge / 2**level).alias(k) for d, k in zip(dims, keys)]
    counted = settle(spots.groupBy(*at(0)).agg(F.count(F.lit(1)).alias("n")).withColumn("l", F.lit(0)))
    done, level = None, 0
    while True:
        full = counted.where((F.col("n") > 4 * aim) & F.lit(level < deepest))
        part = counted if full.isEmpty() else counted.where((F.col("n") <= 4 * aim) | F.lit(level >= deepest))
        done = part if done is None else done.unionByName(part)
        if part is counted:
            return done
        inside = spots.select(*dims, *at(level)).join(bounded(full.select(*keys)), keys, "left_semi")
        level += 2
        counted = settle(inside.select(*dims).groupBy(*at(level)).agg(F.count(F.lit(1)).alias("n")).withColumn("l", F.lit(level)))


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of the columns side by side, as they came, and where in it a new one begins."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(lambda a, b: a | b, [c[order][1:] != c[order][:-1] for c in columns])
    return order, new


def knn_join(
    probe: DataFrame, build: DataFrame, k: int, size: float | None = None, dims: tuple[str, ...] = ("x", "y"), key: str = "pid", self_join: bool = True, prefix: str = "n_", by: str | None = None, aim: int = 1024,
    reduce_to: tuple[Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray, np.ndarray], pa.Table], str] | None = None,
) -> DataFrame:
    """The k nearest build rows of each probe row (itself apart if self_join), ranked by distance, then key.

    Space is cut into cells of about ``aim`` rows, smaller ones where rows are dense. A cell's probe rows meet the build rows in the cell and
    around it, as far as its density promises k of them. A row is settled once its k-th distance is within what its cell has seen; cells with
    open rows go on for those with twice the margin, until it holds everything. Exact: no row is left out, however far it lies. Of more than
    k + 1 build rows in one place those of the smallest keys count, so a heap of equal points is no burden. size: the edge of the
    first cells; by default it follows from the rows and their extent. by: a whole number that must be equal on both sides, as a batch is.
    reduce_to: (f, schema): f(rows, i, near, j, d2) makes one row of that schema of each of ``rows``, whose neighbours near[j] have its number in i, by rank;
    what leaves the tasks then is a row a probe row instead of k. Rows without any neighbour have none.
    """
    spots = probe.select(*dims) if self_join else build.select(*dims).unionByName(probe.select(*dims))
    row = spots.agg(F.count(F.lit(1)), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    low, high = [float(v or 0.0) for v in row[1::2]], [float(v or 0.0) for v in row[2::2]]
    wide = [b - a for a, b in zip(low, high)]
    d, widest = max(1, sum(w > 0 for w in wide)), max([*wide, 0.0])
    edge = float(size * 8) if size else max((np.prod([w for w in wide if w > 0] or [1.0]) * aim / max(row[0], 1)) ** (1 / d), widest * 1e-9, 1e-9)
    keys = [f"c{i}" for i in range(len(dims))]
    leaves = _leaves(spots, edge, dims, aim)
    # In a ball of this radius an even cell has two or three times k rows.
    margin = F.least(F.lit(1.0), F.pow(F.lit(2.5 * (k + 1) / {1: 2.0, 2: 3.14}.get(d, 4.19)) / F.col("n"), F.lit(1 / d))) * edge / F.pow(F.lit(2.0), F.col("l"))
    leaves = settle(leaves.select("l", *keys, margin.alias("h"), F.ceil(F.col("n") / (16 * aim)).cast("int").alias("chunks")))
    levels = sorted(r[0] for r in leaves.select("l").distinct().collect())  # a number a halving
    if not leaves.where("chunks > 1").isEmpty():
        same = Window.partitionBy(*dims, *([by] if by else [])).orderBy(key)
        build = settle(build.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"))
    right = build.select(*[F.col(c).alias(prefix + c) for c in build.columns])
    group, probe_names = ["l", *keys, "chunk"], probe.columns
    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*probe.schema.fields, *right.schema.fields]) + ", d2 double, rank int"
    types = {f.name: f.dataType for f in right.schema.fields}
    if reduce_to:
        out_fields = reduce_to[1] + ", _open struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in probe.schema.fields) + ">"

    def run(asked: pa.Table, near: pa.Table) -> pa.Table:
        wanted, near = asked.select(probe_names), near.select(list(types))
        near = near.take(pc.sort_indices(near, [(prefix + key, "ascending")]))
        keyed = lambda t, names: [t[c].to_numpy() for c in names]
        same = tuple(dims) + ((by,) if by else ())
        # A row may be its own neighbour in the lists below, so they are longer by as many rows as share a key.
        keys_near = near[prefix + key].to_numpy()
        most = k + (int(np.diff(np.flatnonzero(np.r_[True, keys_near[1:] != keys_near[:-1], True])).max()) if self_join and near.num_rows else 0)
        order, new = _runs(keyed(near, [prefix + c for c in same]))
        near = near.take(np.sort(order[np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] < most]))
        b, keys_near = keyed(near, [prefix + c for c in dims]), near[prefix + key].to_numpy()
        # Rows in one place have one list.
        order, new = _runs(keyed(wanted, same))
        one, spot = order[new], np.empty(asked.num_rows, np.int64)
        spot[order] = np.cumsum(new) - 1
        p = [v[one] for v in keyed(wanted, dims)]
        level, far = asked["l"][0].as_py() if asked.num_rows else 0, asked["h"].to_numpy()[one]
        own, sure = edge / 2**level, np.full(len(one), np.inf)
        for i, name in enumerate(keys):
            start = asked[name].to_numpy()[one] * own
            for lo, v in ((p[i] - start + far, start - far > low[i]), (start + own + far - p[i], start + own + far < high[i])):
                sure = np.where(v, np.minimum(sure, lo * (1 - 1e-9)), sure)  # beyond the outermost rows there are none
        at, of, dist = [], [], []
        step = max(1, 4_000_000 // max(1, near.num_rows))
        for lo in range(0, len(one) if near.num_rows else 0, step):
            part = slice(lo, lo + step)
            d2 = np.zeros((len(p[0][part]), near.num_rows))
            for a, c in zip(p, b):
                off = a[part, None] - c[None, :]
                off *= off
                d2 += off
            if by:
                d2[wanted[by].to_numpy()[one[part], None] != near[prefix + by].to_numpy()[None, :]] = np.inf
            border = np.partition(d2, most - 1, axis=1)[:, most - 1] if most < near.num_rows else np.full(len(d2), np.inf)
            r, c = np.nonzero((d2 <= border[:, None]) & (d2 < np.inf))
            order = np.lexsort((c, d2[r, c], r))  # columns rise with the key
            r, c = r[order], c[order]
            few = np.arange(len(r)) - np.searchsorted(r, r) < most
            at, of, dist = [*at, r[few] + lo], [*of, c[few]], [*dist, d2[r[few], c[few]]]
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        at, of, dist = join(at, np.int64), join(of, np.int64), join(dist, np.float64)
        # The lists of the places become those of their rows.
        held = np.bincount(at, minlength=len(one))
        n = held[spot]
        pick = np.repeat((np.cumsum(held) - held)[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, of, dist, sure = np.repeat(np.arange(asked.num_rows), n), of[pick], dist[pick], sure[spot]
        if self_join:
            other = wanted[key].to_numpy()[at] != keys_near[of]
            at, of, dist = at[other], of[other], dist[other]
        rank = (np.arange(len(at)) - np.searchsorted(at, at) + 1).astype(np.int32)
        at, of, dist, rank = (v[rank <= k] for v in (at, of, dist, rank))
        last = np.full(asked.num_rows, np.inf)
        last[at[rank == k]] = dist[rank == k]
        done = (last <= sure * sure) | np.isinf(sure)
        ok, left = done[at], np.flatnonzero(~done)
        if reduce_to:
            full = np.flatnonzero(done & (np.bincount(at, minlength=len(done)) > 0))
            number = np.zeros(len(done), np.int64)
            number[full] = np.arange(len(full))
            made = reduce_to[0](wanted.take(full), number[at[ok]], near, of[ok], dist[ok])
            again = pa.StructArray.from_arrays([c.combine_chunks() for c in wanted.take(left).columns], names=probe_names)
            columns = [pa.chunked_array([*c.chunks, pa.nulls(len(left), c.type)], c.type) for c in made.columns]
            return pa.Table.from_arrays([*columns, pa.chunked_array([pa.nulls(len(full), again.type), again], again.type)], names=[*made.column_names, "_open"])
        # Open rows go back with rank 0.
        mine, theirs = wanted.take(np.concatenate((at[ok], left))), near.take(pa.array(np.concatenate((of[ok], np.zeros(len(left), np.int64))), mask=np.concatenate((np.zeros(ok.sum(), bool), np.ones(len(left), bool)))))
        columns = [*mine.columns, *theirs.columns, pa.array(np.concatenate((dist[ok], np.zeros(len(left))))), pa.array(np.concatenate((rank[ok], np.zeros(len(left), np.int32))))]
        return pa.Table.from_arrays(columns, names=[*probe_names, *types, "d2", "rank"])

    todo, done, times = probe, None, 1
    while True:
        asked, offered = None, None
        for level in levels:
            own = edge / 2**level
            there = leaves.where(F.col("l") == level).withColumn("h", F.col("h") * times)
            mine = todo.withColumns({name: cell(c, own) for name, c in zip(keys, dims)}).join(bounded(there), keys)
            mine = mine.withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).select(*group, "h", *probe_names)
            asked = mine if asked is None else asked.unionByName(mine)
            # Cells a margin wide at least: a cell and its margin lie in few of them.
            grid, boxes = own * times, there if done is None else there.join(mine.select(*keys).distinct(), keys, "left_semi")
            for i, name in enumerate(keys):
                boxes = boxes.withColumns({f"lo{i}": F.col(name) * own - F.col("h"), f"hi{i}": (F.col(name) + 1) * own + F.col("h")})
            for i in range(len(keys)):
                boxes = boxes.withColumn(f"g{i}", F.explode(F.sequence(F.floor((F.col(f"lo{i}")) / grid), F.floor(F.col(f"hi{i}") / grid))))
            boxes = boxes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            gridded = right.withColumns({f"q{i}": F.floor(F.col(prefix + c) / grid) for i, c in enumerate(dims)})
            inside = reduce(lambda a, b: a & b, [(F.col(f"g{i}") == F.col(f"q{i}")) for i in range(len(dims))] + [F.col(prefix + c).between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i, c in enumerate(dims)])
            theirs = gridded.join(bounded(boxes), inside).select(*[F.col(g).alias("_" + g) for g in group], *right.columns)
            offered = theirs if offered is None else offered.unionByName(theirs)
        made = settle(asked.groupBy(*group).cogroup(offered.groupBy(*["_" + g for g in group])).applyInArrow(run, out_fields))
        found, todo = (made.where("_open is null").drop("_open"), made.where("_open is not null").select("_open.*")) if reduce_to else (made.where("rank > 0"), made.where("rank = 0").select(*probe_names))
        done = found if done is None else done.unionByName(found)
        if todo.isEmpty():
            return done
        times *= 2


def with_groups(points: DataFrame, groups: DataFrame, key: str = "g", n: str = "n") -> DataFrame:
    """points with the row of their group. Few groups are broadcast, so the points stay where they are; of many those
    with a 256th of all rows or more, at most 256, are, so no task gets one whole."""
    if groups.limit((1 << 17) + 1).count() <= 1 << 17:
        return points.join(F.broadcast(groups), key)
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * 256 >= F.lit(total)
    few = F.broadcast(groups.where(hot))
    return points.join(few, key).unionByName(points.join(few.select(key), key, "left_anti").join(groups.where(~hot), key))


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def ball_aggregate(points: DataFrame, radius: float, dims: tuple[str, ...], values: dict[str, tuple[str, Column]], others: bool = False, heavy: int = 1 << 14) -> DataFrame:
    """(pid, *values): sums, minima or maxima over all points no farther off than radius, the point itself included.

    Points of one place and one value are a spot, and spots meet in tasks, box by box (see ``balls``): no pair is ever written. values: name -> (sum, min
    or max; of what). others: minima and maxima over the other points; a point without any gets no row. heavy: spots a box aims at.
    """
    from .balls import aggregate_spots, finite

    if others and any(how == "sum" for how, _ in values.values()):
        raise ValueError("sums count the point itself")
    names = list(values)
    pts = finite(points.select("pid", *dims, *[c.alias(f"v_{n}") for n, (_, c) in values.items()]), dims)
    spots = pts.groupBy(*dims, *[f"v_{n}" for n in names]).agg(F.count(F.lit(1)).alias("_size"))
    spots = settle(spots.withColumn("spot", F.monotonically_increasing_id()))
    value = lambda n: F.col(f"v_{n}") * F.col("_size") if values[n][0] == "sum" else F.col(f"v_{n}")
    build = spots.select("spot", *dims, *[f"v_{n}" for n in names], *[value(n).alias(f"w_{n}") for n in names], F.col("_size").alias("n"))
    made = aggregate_spots(build, build, radius, dims, {f"w_{n}": values[n][0] for n in names}, tuple(f"v_{n}" for n in names) if others else (), others, aim=heavy)
    g = F.struct(*dims, *[f"v_{n}" for n in names]).alias("g")
    found = settle(made.join(spots.select("spot", g, "_size"), "spot").select("g", "_size", *[F.col(f"w_{n}").alias(n) for n in names]))
    met = with_groups(pts.select("pid", g), found, n="_size").select("pid", *names)
    return met.groupBy("pid").agg(*[_MERGE[values[n][0]](n).alias(n) for n in names])
