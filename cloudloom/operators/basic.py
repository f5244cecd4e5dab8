"""Tiling, grids, selections and catalogue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cells import cell
from ..ranges import running

SURFACE_CLASSES = (2, 3, 4, 5, 6)


def grid(points: DataFrame, size: float, **aggregates: Column) -> DataFrame:
    """One row a cell (row, col) with the aggregates. Partial sums are combined before the shuffle."""
    keyed = points.withColumns({"row": cell("y", size), "col": cell("x", size)})
    return keyed.groupBy("row", "col").agg(*[a.alias(n) for n, a in aggregates.items()])


def dsm(points: DataFrame, size: float) -> DataFrame:
    return grid(points.where(F.col("classification").isin(*SURFACE_CLASSES)), size, z=F.max("z"))


def lowest_seeds(points: DataFrame, size: float) -> DataFrame:
    """The lowest point of each cell, the smaller id at ties."""
    return grid(points, size, pid=F.min(F.struct("z", "pid"))["pid"], z=F.min("z"))


def keep_lowest(points: DataFrame, size: float, share: float, least: int = 3) -> DataFrame:
    """Points no higher than the percentile of their cell; cells of fewer than ``least`` points are skipped."""
    own = Window.partitionBy(cell("x", size), cell("y", size))
    marked = points.withColumns({"p": F.expr(f"percentile(z, {share})").over(own), "n": F.count(F.lit(1)).over(own)})
    return marked.where((F.col("n") >= least) & (F.col("z") <= F.col("p"))).drop("p", "n")


def voxel_centroids(points: DataFrame, size: float) -> DataFrame:
    keyed = points.withColumns({"vx": cell("x", size), "vy": cell("y", size), "vz": cell("z", size)})
    return keyed.groupBy("vx", "vy", "vz").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.min_by("classification", "pid").alias("classification"), F.count(F.lit(1)).alias("n")
    )


def thin_average(points: DataFrame, size: float) -> DataFrame:
    """Of each XY cell the point nearest to the centroid, the smaller id at ties."""
    keyed = points.withColumns({"row": cell("y", size), "col": cell("x", size)})
    centre = keyed.groupBy(F.col("row").alias("r"), F.col("col").alias("c")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    near = keyed.join(centre, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")))
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    return near.groupBy("row", "col").agg(F.min(F.struct(F.round(d2, 6).alias("d"), F.col("pid").alias("pid")))["pid"].alias("pid"))


def effective_density(points: DataFrame, size: float = 1.0) -> DataFrame:
    """One row: points to an occupied cell, and to an area of the box."""
    cells = points.groupBy(cell("x", size), cell("y", size)).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(k + c) for c in "xy" for k, f in (("lo_", F.min), ("hi_", F.max))])
    area = (F.max("hi_x") - F.min("lo_x")) * (F.max("hi_y") - F.min("lo_y"))
    return cells.agg((F.sum("n") / (F.count(F.lit(1)) * size * size)).alias("density"), (F.sum("n") / area).alias("by_box"))


def intensity_scale(points: DataFrame, share: float = 0.97, least: float = 1.0, default: float = 65535.0) -> DataFrame:
    """One row: the intensity that stands for full scale."""
    return points.agg(F.coalesce(F.greatest(F.lit(least), F.expr(f"percentile(intensity, {share})")), F.lit(default)).alias("scale"))


def block_overlap(points: DataFrame, stride: float, times: int = 2) -> DataFrame:
    """(bx, by, n): points of blocks of ``times`` strides that begin every stride, so that a point is in times squared of them."""
    back = F.array(*[F.lit(-i) for i in range(times)])
    own = points.select(cell("x", stride).alias("cx"), cell("y", stride).alias("cy")).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))  # cells first, then blocks
    spread = own.withColumn("i", F.explode(back)).withColumn("j", F.explode(back))
    return spread.groupBy((F.col("cx") + F.col("i")).alias("bx"), (F.col("cy") + F.col("j")).alias("by")).agg(F.sum("n").alias("n"))


def voxel_fragment(points: DataFrame, size: float, fragment: int, dims: str = "xy") -> DataFrame:
    """points with i and n, of each cell the fragment-th of its n points by id, in a circle."""
    own = Window.partitionBy(*[cell(c, size) for c in dims])
    numbered = points.withColumns({"i": F.row_number().over(own.orderBy("pid")).cast("long") - 1, "n": F.count(F.lit(1)).over(own)})
    return numbered.where(F.col("i") == F.lit(fragment) % F.col("n"))


def last_returns(points: DataFrame) -> DataFrame:
    """Last returns of tiles that have multiple returns; of tiles with fewer than three of them, all points."""
    own = Window.partitionBy("tile")
    last = F.col("rn") == F.col("nr")
    marked = points.withColumns({"most": F.max("nr").over(own), "n_last": F.sum(F.when(last, 1).otherwise(0)).over(own)})
    return marked.where((F.col("most") <= 1) | (F.col("n_last") < 3) | last).drop("most", "n_last")


def corridor(points: DataFrame, x1: float, y1: float, x2: float, y2: float, width: float) -> DataFrame:
    """Points within half the width of a segment, with their distance along it; a degenerate segment takes the full width."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    if len2 < 1e-9:
        d2 = (F.col("x") - x1) ** 2 + (F.col("y") - y1) ** 2
        return points.withColumn("along", F.lit(0.0)).where(F.sqrt(d2) <= width)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - x1) * dx + (F.col("y") - y1) * dy) / len2))
    off = F.sqrt((F.col("x") - (F.lit(x1) + t * dx)) ** 2 + (F.col("y") - (F.lit(y1) + t * dy)) ** 2)
    return points.withColumn("along", t * (len2**0.5)).where(off <= width / 2)


def above_line(profile: DataFrame, d1: float, z1: float, d2: float, z2: float) -> DataFrame:
    """Profile points strictly above a line; above a vertical one are those at or beyond it."""
    if abs(d2 - d1) < 1e-9:
        return profile.where(F.col("along") >= d1)
    return profile.where(F.col("z") > F.lit(z1) + (F.col("along") - d1) * ((z2 - z1) / (d2 - d1)))


def tile_catalog(points: DataFrame) -> DataFrame:
    """Box, count, mode flight line (smallest at ties) and dominant sensor of each tile."""
    box = points.groupBy("tile").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("n")
    )
    lines = points.groupBy("tile", "line").count().groupBy("tile").agg(F.min(F.struct((-F.col("count")).alias("c"), "line"))["line"].alias("flight_line"))
    sensors = points.groupBy("tile", "sensor").count().groupBy("tile").agg(F.min(F.struct((-F.col("count")).alias("c"), "sensor"))["sensor"].alias("sensor"))
    return box.join(lines, "tile").join(sensors, "tile")


def confusion(truth_and_guess: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """Intersection, union and target of each class; classes without rows have zeros."""
    sums = truth_and_guess.select(
        F.explode(F.array_distinct(F.array("truth", "guess"))).alias("class"), "truth", "guess"
    ).groupBy("class").agg(
        F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("guess") == F.col("class")), 1).otherwise(0)).alias("inter"),
        F.count(F.lit(1)).alias("uni"),
        F.sum(F.when(F.col("truth") == F.col("class"), 1).otherwise(0)).alias("target"),
    )
    every = truth_and_guess.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    return every.join(sums, "class", "left").na.fill(0)


def processing_stats(log: DataFrame) -> DataFrame:
    """Totals, by step and by batch in one pass; a missing batch is named.

    Quartiles come from running counts of the distinct durations in order, stretch by stretch: no task holds the durations of a group.
    """
    named = log.withColumn("batch", F.coalesce(F.col("batch").cast("string"), F.lit("(no batch)")))
    d, by = "duration", ("level", "step", "batch")
    stats = named.groupingSets([[], ["step"], ["batch"]], "step", "batch").agg(
        F.grouping_id("step", "batch").cast("int").alias("level"),
        F.count(F.lit(1)).alias("n"), F.round(F.sum(d), 2).alias("total"), F.round(F.avg(d), 4).alias("mean"),
        F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.coalesce(F.stddev_samp(d), F.lit(0.0)), 4).alias("std"),
    )
    counted = named.where(F.col(d).isNotNull()).groupBy("step", "batch", d).agg(F.count(F.lit(1)).alias("_c"))
    none = F.lit(None).cast("string")
    sets = F.array(*[F.struct(F.lit(i).alias("level"), s.alias("step"), b.alias("batch")) for i, s, b in ((3, none, none), (1, F.col("step"), none), (2, none, F.col("batch")))])
    spread = counted.select(F.explode(sets).alias("_g"), F.col(d), "_c").groupBy(*[F.col(f"_g.{c}").alias(c) for c in by], d).agg(F.sum("_c").alias("_c"))
    own = running(spread, [d], by, {"_upto": "_c"}, {"_all": "_upto"})
    shares = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    held = lambda r: F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col(d)))
    picks = [held(f(F.lit(s) * (F.col("_all") - 1))).alias(f"_{n}{k}") for n, s in shares.items() for k, f in enumerate((F.floor, F.ceil))]
    ends = own.groupBy(*by).agg(F.max("_all").alias("_all"), *picks)
    at = lambda s: F.lit(s) * (F.col("_all") - 1)
    between = lambda n, s: F.when(F.col(f"_{n}0") == F.col(f"_{n}1"), F.col(f"_{n}0")).otherwise((F.ceil(at(s)) - at(s)) * F.col(f"_{n}0") + (at(s) - F.floor(at(s))) * F.col(f"_{n}1"))
    quartiles = ends.select(*[F.col(c).alias("_" + c) for c in by], *[F.round(between(n, s), 4).alias(n) for n, s in shares.items()])
    same = (F.col("level") == F.col("_level")) & F.col("step").eqNullSafe(F.col("_step")) & F.col("batch").eqNullSafe(F.col("_batch"))
    return stats.join(quartiles, same, "left").select("step", "batch", "level", "n", "total", "mean", "median", "least", "most", "std", "p25", "p75")


def hillshade(cells: DataFrame, size: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade from 1 to 255 by Horn's 3 x 3 slopes; missing neighbours are the mean, border cells of the grid are flat.

    One equi-join on shifted cells gives all eight neighbours.
    """
    import math

    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    stats = cells.agg(F.round(F.avg("z"), 6).alias("m"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("k0"), F.max("col").alias("k1"))
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    spread = cells.select(
        F.explode(F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c"), F.lit(f"{'abc'[i + 1]}{j + 1}").alias("k")) for i, j in offsets])).alias("o"),
        F.col("z").alias("nz"),
    ).select("o.r", "o.c", "o.k", "nz")
    around = cells.join(spread, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left").crossJoin(F.broadcast(stats))
    wide = around.groupBy("row", "col", "z", "m", "r0", "r1", "k0", "k1").agg(
        *[F.coalesce(F.max(F.when(F.col("k") == f"{'abc'[i + 1]}{j + 1}", F.col("nz"))), F.col("m")).alias(f"{'abc'[i + 1]}{j + 1}") for i, j in offsets]
    )
    inner = (F.col("row") > F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") > F.col("k0")) & (F.col("col") < F.col("k1"))
    dx = F.when(inner, F.expr("(a2 + 2.0D * b2 + c2) - (a0 + 2.0D * b0 + c0)") / (8.0 * size)).otherwise(0.0)
    dy = F.when(inner, F.expr("(c0 + 2.0D * c1 + c2) - (a0 + 2.0D * a1 + a2)") / (8.0 * size)).otherwise(0.0)
    sloped = wide.withColumns({"dx": dx, "dy": dy})
    steep = F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    aspect = F.when(steep > 0, F.atan2(F.col("dy"), -F.col("dx"))).otherwise(0.0)
    hs = F.lit(math.cos(alt)) * F.cos(steep) + F.lit(math.sin(alt)) * F.sin(steep) * F.cos(F.lit(az) - aspect)
    return sloped.select("row", "col", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), hs)) * 254.0 + 1.0).alias("shade"))
