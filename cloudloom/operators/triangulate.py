"""One Delaunay triangulation over many blocks: heights between its triangles, the same however the plane is cut.

A block triangulates the points in and around it, and the corners of the hull of all points. A triangle of that is one of the whole cloud's if no
point lies in its circumcircle. Circles inside the block's margin are certain at once; the others are looked up: the blocks a circle
reaches into name the point of theirs that lies deepest in it. Without such a point the triangle stands; otherwise the
points found join the block's own, and it works out anew what hangs on that triangle. No block ever needs more than what its own
triangles ask for.

Points that share a place count once, with the least height. Points on one circle, as on a grid, have several
triangulations: every point is moved by a millionth of a cell, by a hash of its place, so all blocks choose alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tin
from ..lineage import settle


def hull(points: DataFrame) -> np.ndarray:
    """Corners (x, y, z) of the convex hull: of each batch, then of what the batches gave."""

    def corners(xyz: np.ndarray) -> np.ndarray:
        xyz = xyz[np.lexsort((xyz[:, 1], xyz[:, 0]))]
        out = []
        for turn in (xyz, xyz[::-1]):
            side: list = []
            for p in turn:
                while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                    side.pop()
                side.append(p)
            out += side[:-1] or side
        return np.array(out).reshape(-1, 3)

    def reduce(batches):
        held = np.zeros((0, 3))
        for b in batches:
            held = corners(np.vstack([held, np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[:, i])) for i in range(3)], names=["x", "y", "z"])

    found = points.select("x", "y", "z").mapInArrow(reduce, "x double, y double, z double").collect()  # corners of each task's points only
    return corners(np.array([tuple(r) for r in found])) if found else np.zeros((0, 3))


def moved(xy: np.ndarray, by: float) -> np.ndarray:
    """Places shifted a little, the same place always alike."""
    bits = np.ascontiguousarray(xy, dtype=np.float64).view(np.uint64)
    mixed = bits[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (bits[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    out = []
    for k in range(2):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5)
    return xy + np.stack(out, axis=1) * by


def _circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centre and radius of the circle through the corners."""
    u, v = b - a, c - a
    d = 2.0 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
    with np.errstate(all="ignore"):
        x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
    return np.stack((a[:, 0] + x, a[:, 1] + y, np.hypot(x, y)), axis=1)


def heights(xyz: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Height and circumcircle (x, y, radius) of the triangle at each wanted place; NaN outside the hull."""
    z, circle = np.full(len(wanted), np.nan), np.full((len(wanted), 3), np.nan)
    xy = xyz[:, :2]
    t = tin.triangles(xy, 0.0)
    at, w = tin.locate(xy, t, wanted)
    ok = at >= 0
    own = t[at[ok]]
    z[ok] = (xyz[own, 2] * w[ok]).sum(axis=1)
    circle[ok] = _circles(*(xy[own[:, k]] for k in range(3)))
    return z, circle


def block_edge(points: DataFrame, aim: int = 4096, most: int = 50_000) -> float:
    """An edge at which blocks hold about ``aim`` points on average and the densest at most ``most``."""
    n, x0, x1, y0, y1 = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return 1.0
    wide = max(x1 - x0, y1 - y0, 1e-9)
    edge = max(np.sqrt(max(x1 - x0, wide * 1e-3) * max(y1 - y0, wide * 1e-3) * aim / n), wide * 1e-6)
    for _ in range(20):
        cells = points.groupBy(F.floor(F.col("x") / edge), F.floor(F.col("y") / edge)).agg(F.count(F.lit(1)).alias("n"))
        if cells.agg(F.max("n")).first()[0] <= most:
            break
        edge /= 2
    return float(edge)


def interpolate(points: DataFrame, wanted: DataFrame, shift: float, edge: float | None = None, margin: float | None = None, rounds: int = 100) -> DataFrame:
    """(id, z) of the wanted places (id, x, y) inside the hull of points (x, y, z)."""
    spark = points.sparkSession

    def move(batches):
        for b in batches:
            xy = moved(np.stack([b.column(i).to_numpy() for i in range(2)], axis=1), shift)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1])), b.column(2)], names=["x", "y", "z"])

    points = settle(points.groupBy("x", "y").agg(F.min("z").alias("z")).mapInArrow(move, "x double, y double, z double"))
    edge = edge or block_edge(points)
    margin = edge / 4 if margin is None else margin
    number = lambda c, off=0.0: F.floor((F.col(c) + off) / edge).cast("long")
    corners = hull(points)
    if len(corners) < 3:
        return spark.createDataFrame([], "id long, z double")
    low, high = corners[:, :2].min(axis=0), corners[:, :2].max(axis=0)
    by_block = points.withColumns({"bx": number("x"), "by": number("y")})
    spread = points.withColumn("bx", F.explode(F.sequence(number("x", -margin), number("x", margin)))).withColumn("by", F.explode(F.sequence(number("y", -margin), number("y", margin))))
    todo = settle(wanted.select("id", "x", "y", number("x").alias("bx"), number("y").alias("by")))
    on_hull = spark.createDataFrame([tuple(map(float, c[:2])) for c in corners], "x double, y double")  # fetched by hull() before
    extra = done = None
    out_schema = "bx long, by long, id long, z double, cx double, cy double, r double, sure boolean"

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        places = np.stack([asked[c].to_numpy() for c in "xy"], axis=1)
        own = np.vstack([corners, np.stack([known[c].to_numpy() for c in "xyz"], axis=1)])
        own = own[np.unique(own[:, :2], axis=0, return_index=True)[1]]
        if not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("bx", "by", "id") else pa.bool_() if c == "sure" else pa.float64()) for c in ("bx", "by", "id", "z", "cx", "cy", "r", "sure")})
        z, circle = heights(own, places)
        corner = np.stack([asked[c].to_numpy() for c in ("bx", "by")], axis=1) * edge
        # Beyond the box of all points there is nothing to find.
        inside = (np.maximum(circle[:, :2] - circle[:, 2:], low) >= corner - margin) & (np.minimum(circle[:, :2] + circle[:, 2:], high) <= corner + edge + margin)
        return pa.table({
            "bx": asked["bx"], "by": asked["by"], "id": asked["id"], "z": pa.array(z), **{c: pa.array(np.ascontiguousarray(circle[:, i])) for i, c in enumerate(("cx", "cy", "r"))},
            "sure": pa.array(~np.isfinite(circle).all(axis=1) | inside.all(axis=1)),
        })

    for _ in range(rounds):
        mine = todo.select("bx", "by").distinct()
        near = spread.select("bx", "by", "x", "y", "z") if extra is None else spread.select("bx", "by", "x", "y", "z").unionByName(extra)
        near = near.join(mine, ["bx", "by"], "left_semi")
        made = settle(near.groupBy("bx", "by").cogroup(todo.groupBy("bx", "by")).applyInArrow(run, out_schema))
        open_ = made.where("not sure").select("bx", "by", "cx", "cy", "r").distinct()
        clipped = lambda c, s, f, bound: number_of(f(F.col(c) + s * F.col("r"), F.lit(float(bound))), edge)
        reach = open_.withColumn("px", F.explode(F.sequence(clipped("cx", -1, F.greatest, low[0]), clipped("cx", 1, F.least, high[0]))))
        reach = reach.withColumn("py", F.explode(F.sequence(clipped("cy", -1, F.greatest, low[1]), clipped("cy", 1, F.least, high[1]))))
        # Blocks that the circle does not touch after all, and those around the asking one whose points it has.
        off = lambda p, c: F.greatest(F.lit(0.0), F.col(p) * edge - F.col(c), F.col(c) - (F.col(p) + 1) * edge)
        reach = reach.where((F.sqrt(off("px", "cx") * off("px", "cx") + off("py", "cy") * off("py", "cy")) <= F.col("r")) & ~((F.col("px") == F.col("bx")) & (F.col("py") == F.col("by"))))
        p = by_block.select(F.col("bx").alias("qx"), F.col("by").alias("qy"), "x", "y", "z")
        d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
        known = F.col("bx").between(number("x", -margin), number("x", margin)) & F.col("by").between(number("y", -margin), number("y", margin))
        hit = reach.join(p, (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))).withColumn("d", d).where((F.col("d") < F.col("r")) & ~known)
        # What the block has already is no news: its triangle's own corners lie on the circle, up to rounding.
        hit = hit.join(F.broadcast(on_hull), ["x", "y"], "left_anti")
        hit = hit if extra is None else hit.join(extra.select("bx", "by", "x", "y"), ["bx", "by", "x", "y"], "left_anti")
        deepest = hit.groupBy("bx", "by", "cx", "cy", "r", "px", "py").agg(F.min_by(F.struct("x", "y", "z"), "d").alias("p"))
        deepest = settle(deepest.select("bx", "by", "cx", "cy", "r", "p.x", "p.y", "p.z"))
        wrong = deepest.select("bx", "by", "cx", "cy", "r").distinct()
        keys = ["bx", "by", "cx", "cy", "r"]
        good = settle(made.where("sure").unionByName(made.where("not sure").join(wrong, keys, "left_anti")).where("z is not null and not isnan(z)").select("id", "z"))
        done = good if done is None else done.unionByName(good)
        bad = made.where("not sure").join(wrong, keys, "left_semi").select("id")
        todo = settle(todo.join(bad, "id", "left_semi"))
        if todo.isEmpty():
            return done
        more = deepest.select("bx", "by", "x", "y", "z")
        extra = settle((more if extra is None else extra.unionByName(more)).distinct())
    raise RuntimeError("triangles still change")


def number_of(value: Column, edge: float) -> Column:
    return F.floor(value / edge).cast("long")
