"""Grids as tables of cells (row, col, z): lookup, fill, smoothing and interpolation.

A cell is floor((y - y0) / size), floor((x - x0) / size). A missing cell has no row or a null z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import knn_join
from ..lineage import bounded, settle
from ..quantiles import percentile


def _at(name: str, origin: float, size: float) -> Column:
    return (F.col(name) - F.lit(float(origin))) / F.lit(float(size))


def bilinear(points: DataFrame, cells: DataFrame, size: float, rows: int, columns: int, x0: float = 0.0, y0: float = 0.0, fill: Column | None = None, key: str = "pid") -> DataFrame:
    """points with ``surface``, the grid's height between the four cells about each point, whose numbers are kept inside the grid.

    Weights are not limited, so points off the grid are extrapolated. A missing corner counts as ``fill``, by default the median of the cells.
    The four heights about each place are brought together once a cell, so a point meets one row and its sum has one order: along x first, then along y.
    """
    fx, fy = _at("x", x0, size), _at("y", y0, size)
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    p = points.withColumns({"_c": clip(F.floor(fx), columns), "_r": clip(F.floor(fy), rows)})
    p = p.withColumns({"_wx": fx - F.col("_c"), "_wy": fy - F.col("_r")})
    # A cell is the first or the second one of two in a row; at the far border it is both.
    sides = lambda c, n: F.array(F.struct(F.col(c).alias("at"), F.lit(0).alias("k")), F.struct((F.col(c) - 1).alias("at"), F.lit(1).alias("k")), F.struct(F.when(F.col(c) == n - 1, F.col(c)).alias("at"), F.lit(1).alias("k")))
    spread = cells.select("row", "col", "z").withColumn("_i", F.explode(sides("row", rows))).withColumn("_j", F.explode(sides("col", columns))).where("_i.at is not null and _j.at is not null")
    names = [(i, j) for i in (0, 1) for j in (0, 1)]
    corners = spread.groupBy(F.col("_i.at").alias("_cr"), F.col("_j.at").alias("_cc")).agg(*[F.max(F.when((F.col("_i.k") == i) & (F.col("_j.k") == j), F.col("z"))).alias(f"_z{i}{j}") for i, j in names])
    met = p.join(bounded(settle(corners)), (F.col("_r") == F.col("_cr")) & (F.col("_c") == F.col("_cc")), "left")
    if fill is None:
        fill = F.lit(percentile(cells, "z", 0.5)).cast("double")
    one = F.lit(1.0)
    part = lambda i, j: (F.col("_wy") if i else one - F.col("_wy")) * (F.col("_wx") if j else one - F.col("_wx")) * F.coalesce(F.col(f"_z{i}{j}"), fill)
    surface = part(0, 0) + part(0, 1) + part(1, 0) + part(1, 1)
    return met.withColumn("surface", surface).drop("_c", "_r", "_wx", "_wy", "_cr", "_cc", *[f"_z{i}{j}" for i, j in names])


def dtm_lookup(points: DataFrame, nodes: DataFrame, size: float, rows: int, columns: int, x0: float = 0.0, y0: float = 0.0, key: str = "pid") -> DataFrame:
    """points with ``elevation`` between grid nodes (row, col, z); null off the grid or beside a missing node."""
    fx, fy = _at("x", x0, size), _at("y", y0, size)
    inside = (fx >= 0) & (fx <= columns - 1) & (fy >= 0) & (fy <= rows - 1)
    # The node before the point; on a node it is the one before that.
    before = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 2), F.ceil(c) - 1)).cast("long")
    p = points.where(inside).withColumns({"_c": before(fx, columns), "_r": before(fy, rows)}).withColumns({"_wx": fx - F.col("_c"), "_wy": fy - F.col("_r")})
    pick = lambda i, j: F.struct((F.col("_r") + i).alias("r"), (F.col("_c") + j).alias("c"), ((F.col("_wy") if i else 1.0 - F.col("_wy")) * (F.col("_wx") if j else 1.0 - F.col("_wx"))).alias("w"))
    spread = p.select(key, F.explode(F.array(*[pick(i, j) for i in (0, 1) for j in (0, 1)])).alias("_k"))
    own = nodes.where("z is not null").select(F.col("row").alias("_nr"), F.col("col").alias("_nc"), F.col("z").alias("_z"))
    met = spread.join(own, (F.col("_k.r") == F.col("_nr")) & (F.col("_k.c") == F.col("_nc")))
    sums = met.groupBy(F.col(key).alias("_key")).agg(F.sum(F.col("_k.w") * F.col("_z")).alias("elevation"), F.count(F.lit(1)).alias("_n")).where("_n = 4")
    return points.join(sums.drop("_n"), F.col(key) == F.col("_key"), "left").drop("_key")


def dtm_profile(spark, nodes: DataFrame, size: float, rows: int, columns: int, start: tuple[float, float], end: tuple[float, float], samples: int = 200, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(i, distance, elevation) at equal steps along a line."""
    import math

    t = F.col("id") / F.lit(samples - 1)
    line = spark.range(samples).select(F.col("id").alias("i"), (F.lit(start[0]) + t * (end[0] - start[0])).alias("x"), (F.lit(start[1]) + t * (end[1] - start[1])).alias("y"))
    seen = dtm_lookup(line, nodes, size, rows, columns, x0, y0, key="i")
    return seen.select("i", (F.col("i") / F.lit(samples - 1) * math.hypot(end[0] - start[0], end[1] - start[1])).alias("distance"), "elevation")


def _neighbours(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell's z once for every cell it is a neighbour of."""
    moves = F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in offsets])
    return cells.select(F.explode(moves).alias("o"), F.col("z").alias("nz")).select("o.row", "o.col", "nz")


_SIDES, _RING = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def fill_holes(cells: DataFrame, rows: int, columns: int, passes: int, every: int = 4) -> DataFrame:
    """Cells with a value, and empty ones about them filled pass by pass with the mean of the neighbours at their sides.

    All cells of a pass change at once; passes stop early when nothing is left to fill.
    """
    have = settle(cells.where("z is not null").select("row", "col", "z"))
    for k in range(passes):
        near = _neighbours(have, _SIDES).where(f"row between 0 and {rows - 1} and col between 0 and {columns - 1}")
        fresh = near.join(have, ["row", "col"], "left_anti").groupBy("row", "col").agg(F.avg("nz").alias("z"))
        have = have.unionByName(fresh)
        if k % every == every - 1 or k == passes - 1:
            have = settle(have)
            if have.count() >= rows * columns:
                break
    return have


def median3(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """The median of each cell and its eight neighbours; beyond the border the grid is mirrored."""
    mirror = lambda c, n: F.when(F.col(c) < 0, -F.col(c) - 1).when(F.col(c) >= n, 2 * n - 1 - F.col(c)).otherwise(F.col(c))
    targets = cells.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in _RING])).alias("o"))
    targets = targets.select("tr", "tc", "o.row", "o.col").select("tr", "tc", mirror("row", rows).alias("row"), mirror("col", columns).alias("col"))
    return targets.join(cells, ["row", "col"]).groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.expr("percentile(z, 0.5)").alias("z"))


def extremes3(cells: DataFrame, how: str) -> DataFrame:
    """The least or largest of each cell and its eight neighbours (erosion, dilation by a 3 x 3 square)."""
    near = _neighbours(cells, _RING)
    best = near.groupBy("row", "col").agg((F.min if how == "erode" else F.max)("nz").alias("z"))
    return best.join(cells.select("row", "col"), ["row", "col"], "left_semi")


def idw(targets: DataFrame, known: DataFrame, k: int = 12, most: float = 5.0, power: float = 2.0, key: str = "pid") -> DataFrame:
    """targets with ``z``: the mean of up to k nearest known points nearer than ``most``, by the inverse of the distance; without any, no row."""
    near = knn_join(targets.select(key, "x", "y"), known.select(F.col("pid").alias(key), "x", "y", "z"), k, dims=("x", "y"), key=key, self_join=False)
    w = 1.0 / (F.pow(F.sqrt("d2"), F.lit(power)) + 1e-12)
    near = near.where(F.sqrt("d2") < most).withColumn("w", w)
    sums = near.groupBy(F.col(key).alias("_key")).agg((F.sum(F.col("w") * F.col("n_z")) / F.sum("w")).alias("z"))
    return targets.join(sums, F.col(key) == F.col("_key")).drop("_key")


def dsm_filled(points: DataFrame, size: float, rows: int, columns: int, reach: float = 3.0, k: int = 12) -> DataFrame:
    """The highest point of each cell; empty cells by distance from one point of each cell, its first, within ``reach`` cells. (row, col, z, filled)"""
    keyed = points.withColumns({"row": F.floor(F.col("y") / size).cast("long"), "col": F.floor(F.col("x") / size).cast("long")})
    keyed = keyed.where(f"row between 0 and {rows - 1} and col between 0 and {columns - 1}")
    tops = settle(keyed.groupBy("row", "col").agg(F.max("z").alias("z"), F.min_by(F.struct("x", "y", "z"), "pid").alias("first")))
    spark = points.sparkSession
    every = spark.range(rows * columns).select(F.col("id"), F.expr(f"id div {columns}").alias("row"), F.expr(f"id % {columns}").alias("col"))
    empty = every.join(tops, ["row", "col"], "left_anti").select("id", "row", "col", ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"))
    known = tops.select((F.col("row") * columns + F.col("col")).alias("pid"), "first.x", "first.y", "first.z")
    filled = idw(empty, known, k, reach * size, key="id")
    return tops.select("row", "col", "z", F.lit(False).alias("filled")).unionByName(filled.select("row", "col", "z", F.lit(True).alias("filled")))


def preview_shade(cells: DataFrame, size: float, rows: int, columns: int) -> DataFrame:
    """Shade from 0 to 1 by central differences, one-sided at the border; light from the north-west at 45 degrees."""
    import math

    own = cells.select("row", "col", "z")
    moves = F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(k).alias("k")) for k, (i, j) in zip("ewns", _SIDES)])
    near = own.select(F.explode(moves).alias("o"), F.col("z").alias("v")).select("o.row", "o.col", "o.k", "v")
    side = near.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in "ewns"])
    a = own.join(side, ["row", "col"], "left")
    mid = lambda hi, lo: F.when(F.col(hi).isNotNull() & F.col(lo).isNotNull(), (F.col(hi) - F.col(lo)) / (2 * size)).when(F.col(hi).isNotNull(), (F.col(hi) - F.col("z")) / size).otherwise((F.col("z") - F.col(lo)) / size)
    a = a.withColumns({"dx": mid("e", "w"), "dy": mid("n", "s")})
    steep = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    aspect = F.atan2(F.col("dy"), -F.col("dx"))
    aspect = F.when(aspect < 0, aspect + 2 * math.pi).otherwise(aspect)
    zenith = math.pi / 2 - math.radians(45.0)
    shade = F.lit(math.cos(zenith)) * F.cos(steep) + F.lit(math.sin(zenith)) * F.sin(steep) * F.cos(F.lit(math.radians(315.0)) - aspect)
    return a.select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("shade"))
