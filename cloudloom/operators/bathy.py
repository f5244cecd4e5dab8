"""Trajectories, refraction and water surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..quantiles import percentile

# Fixed value: refractive index of water.
N_WATER = 1.3333


def interpolate(points: DataFrame, trajectory: DataFrame, bucket: float) -> DataFrame:
    """Sensor position sx, sy, sz at each point's time t, linear between trajectory records and clamped at the ends.

    Segments are put into time buckets, so the as-of join is an equi-join on the bucket. Records are ordered by (t, x, y, z) inside buckets
    only; the last record of a bucket gets the first one of the next that has any, from a table of one row a bucket.
    """
    number = lambda c: F.floor(c / F.lit(float(bucket))).cast("long")
    at = F.struct("t", "x", "y", "z")
    records = trajectory.select("t", "x", "y", "z").withColumn("tb", number(F.col("t")))
    ends = trajectory.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    # Firsts of buckets: few rows, so their order is no matter.
    firsts = records.groupBy("tb").agg(F.min(at).alias("head"))
    firsts = firsts.select(F.col("tb").alias("fb"), F.lead("head").over(Window.orderBy("tb")).alias("next"))
    order = Window.partitionBy("tb").orderBy("t", "x", "y", "z")
    seg = records.withColumn("n", F.lead(at).over(order)).join(firsts, F.col("tb") == F.col("fb")).withColumn("n", F.coalesce("n", "next"))
    seg = seg.select("t", "x", "y", "z", *[F.col(f"n.{c}").alias(c + "2") for c in ("t", "x", "y", "z")])
    seg = seg.where("t2 > t").withColumn("b", F.explode(F.sequence(number(F.col("t")), number(F.col("t2")))))
    seg = seg.select("b", *[F.col(c).alias("g" + c) for c in ("t", "x", "y", "z", "t2", "x2", "y2", "z2")])
    keyed = points.withColumn("pb", number(F.col("t")))
    joined = keyed.join(seg, (F.col("pb") == F.col("b")) & (F.col("t") >= F.col("gt")) & (F.col("t") < F.col("gt2")), "left").crossJoin(F.broadcast(ends))
    frac = (F.col("t") - F.col("gt")) / (F.col("gt2") - F.col("gt"))

    def value(axis: str) -> Column:
        inside = F.col("g" + axis) + frac * (F.col(f"g{axis}2") - F.col("g" + axis))
        return F.when(F.col("t") < F.col("first.t"), F.col(f"first.{axis}")).when(F.col("t") >= F.col("last.t"), F.col(f"last.{axis}")).otherwise(inside)

    return joined.select(*[F.col(c) for c in points.columns], *[value(a).alias("s" + a) for a in "xyz"])


def snell(points: DataFrame, n: float = N_WATER) -> DataFrame:
    """Refraction-corrected x, y, z of points below the water ``ws`` seen from sx, sy, sz; others stay."""
    p = points.withColumn("ray_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ws") - F.col("sz")) / F.nullif(F.col("z") - F.col("sz"), F.lit(0.0)))))
    p = p.withColumns({"ix": F.expr("sx + ray_t * (x - sx)"), "iy": F.expr("sy + ray_t * (y - sy)")})
    p = p.withColumns({
        "air": F.expr("sqrt((ix - sx) * (ix - sx) + (iy - sy) * (iy - sy) + (ws - sz) * (ws - sz))"),
        "app": F.expr("sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy) + (z - ws) * (z - ws))"),
    })
    p = p.withColumn("cos_a", F.expr("least(1.0D, greatest(0.0D, abs(ws - sz) / greatest(air, 1e-12D)))"))
    p = p.withColumn("sin_a", F.expr("sqrt(greatest(1.0D - cos_a * cos_a, 0.0D))"))
    p = p.withColumn("sin_w", F.expr(f"least(1.0D, greatest(0.0D, sin_a / {n}D))"))
    p = p.withColumns({
        "far": F.expr(f"app / {n}D"),
        "cos_w": F.expr("sqrt(greatest(1.0D - sin_w * sin_w, 0.0D))"),
        "side": F.expr("CASE WHEN sin_a > 1e-12D THEN sin_w / greatest(sin_a, 1e-12D) ELSE 0.0D END"),
    })
    under = F.col("z") < F.col("ws")
    shift = {"x": "ix + (x - ix) * side * (far / greatest(app, 1e-12D))", "y": "iy + (y - iy) * side * (far / greatest(app, 1e-12D))", "z": "ws - far * cos_w"}
    return p.select(*[F.when(under, F.expr(shift[c])).otherwise(F.col(c)).alias(c) if c in shift else F.col(c) for c in points.columns])


def snell_nadir(points: DataFrame, n: float = N_WATER) -> DataFrame:
    """Depth below the water times the index, straight down."""
    return points.withColumn("z", F.when(F.col("z") < F.col("ws"), F.col("ws") - (F.col("ws") - F.col("z")) * n).otherwise(F.col("z")))


def sample_raster(points: DataFrame, cells: DataFrame, size: float, fill: float | None = None) -> DataFrame:
    """The raster's value at each point by its cell, as ``ws``; ``fill`` outside and where the cell is null."""
    keyed = points.withColumns({"pr": F.floor(F.col("y") / size).cast("long"), "pc": F.floor(F.col("x") / size).cast("long")})
    own = cells.select(F.col("row").alias("cr"), F.col("col").alias("cc"), F.col("z").alias("cz"))
    out = keyed.join(own, (F.col("pr") == F.col("cr")) & (F.col("pc") == F.col("cc")), "left")
    return out.select(*[F.col(c) for c in points.columns], F.coalesce("cz", F.lit(fill).cast("double")).alias("ws"))


def crop_to_water(points: DataFrame, cells: DataFrame, size: float, tolerance: float, steps: int) -> DataFrame:
    """Points over water cells or within ``steps`` cells of one (city blocks), no higher than the water plus tolerance.

    A cell without a value inside the widened area sets no limit.
    """
    reach = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps]
    wet = cells.where("z is not null")
    wide = wet.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for i, j in reach])).alias("o"))
    wide = wide.select(F.col("o.r").alias("wr"), F.col("o.c").alias("wc")).distinct()
    keyed = sample_raster(points, cells, size).withColumns({"pr": F.floor(F.col("y") / size).cast("long"), "pc": F.floor(F.col("x") / size).cast("long")})
    inside = keyed.join(wide, (F.col("pr") == F.col("wr")) & (F.col("pc") == F.col("wc")), "left_semi")
    return inside.where(F.col("ws").isNull() | (F.col("z") <= F.col("ws") + tolerance)).drop("pr", "pc")


def median_position(trajectory: DataFrame) -> DataFrame:
    """One row sx, sy, sz: where the sensor is taken to be if points have no usable time."""
    return trajectory.sparkSession.range(1).select(*[F.lit(percentile(trajectory, c, 0.5)).cast("double").alias("s" + c) for c in "xyz"])


def with_level(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points with ``ws``, one water level for all: the median of the raster."""
    return points.withColumn("ws", F.lit(percentile(cells, "z", 0.5)).cast("double"))


def bathy_only(points: DataFrame, correct, tile: str = "tile", bathy: int = 2) -> DataFrame:
    """correct() applied to a tile's bathymetric points if it has any, else to all of its points."""
    is_bathy = F.col("sensor") == bathy
    marked = points.withColumn("_any", F.max(is_bathy).over(Window.partitionBy(tile)))
    use = is_bathy | ~F.col("_any")
    return correct(marked.where(use)).drop("_any").unionByName(marked.where(~use).drop("_any"))


def water_plane(points: DataFrame, share: float = 0.9, residual: float = 0.3, most: int = 200_000, seed: int = 0) -> DataFrame:
    """One row a, b, c, level, n: a plane through the highest points, by consensus of a sample of at most ``most`` of them, drawn by hash;
    zeros under 50 points or 20 candidates. The sample bounds what one task fits."""
    import numpy as np
    import pyarrow as pa

    from .clean import plane_by_consensus

    cut = percentile(points, "z", share) if points.limit(50).count() == 50 else None
    high = points.select("pid", "x", "y", "z").where(F.col("z") >= F.lit(cut).cast("double"))
    some = high.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(most).select("pid", "x", "y", "z")

    def run(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("pid", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])).sort_by("pid")
        xyz = np.stack([got[c].to_numpy() for c in "xyz"], axis=1)
        plane = plane_by_consensus(xyz, residual, seed, 200) if len(xyz) >= 20 else None
        if plane is None:
            row = [0.0, 0.0, 0.0, 0.0, len(xyz)]
        else:
            near = np.abs(xyz[:, :2] @ plane[:2] + plane[2] - xyz[:, 2]) <= residual
            row = [*map(float, plane), float(np.median(xyz[near, 2])) if near.any() else 0.0, len(xyz)]
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("a", "b", "c", "level", "n"), row)})

    fitted = some.coalesce(1).mapInArrow(run, "a double, b double, c double, level double, n long")
    # Without candidates there may be no task at all.
    return fitted.agg(*[F.coalesce(F.first(c), F.lit(0).cast(t)).alias(c) for c, t in fitted.dtypes])


CHAIN = ("ws_crop", "snells", "water_surface", "river_crop", "benthic")


def chain(points: DataFrame, cells: DataFrame, size: float, steps: list[dict], trajectory: DataFrame | None = None) -> DataFrame:
    """Steps for bathymetric points (sensor 2), in the order given; points of other sensors pass. A tile without bathymetric points
    is left as it is, for these steps change nothing in it."""
    from ..lineage import settle
    from . import clean

    for s in steps:
        if s.get("type") not in CHAIN:
            raise ValueError(f"unknown step {s.get('type')!r}")
    wet, dry = points.where(F.col("sensor") == 2), points.where(F.coalesce(F.col("sensor") != 2, F.lit(True)))
    for s in steps:
        kind = s["type"]
        if kind == "ws_crop":
            wet = crop_to_water(wet, cells, size, s.get("tolerance", 0.5), int(s.get("steps", 0))).select(*points.columns)
        elif kind == "snells":
            n = s.get("n_water", N_WATER)
            at = sample_raster(wet, cells, size, s.get("fallback", -1e9))
            if s.get("mode") == "nadir" or trajectory is None and "sensor_position" not in s:
                at = snell_nadir(at, n)
            elif trajectory is not None and "t" in points.columns:
                at = snell(interpolate(at, trajectory, s.get("bucket", 60.0)), n)
            else:
                spot = s.get("sensor_position") or tuple(median_position(trajectory).first())
                at = snell(at.withColumns({f"s{c}": F.lit(float(v)) for c, v in zip("xyz", spot)}), n)
            wet = at.select(*points.columns)
        elif kind == "water_surface":
            keep = clean.water_ghosts(wet, s.get("tile_length", 40.0), compat=s.get("compat", False)).where("keep")
            wet = settle(wet.join(keep.select("pid"), "pid", "left_semi"))
        elif kind == "river_crop":
            wet = settle(wet.join(clean.river_corridor(wet, s.get("grid_res", 2.0), s.get("water_surface_z")).where("river").select("pid"), "pid", "left_semi"))
        else:
            seeded = wet.withColumn("_certain", F.expr(s["seed"]))
            wet = settle(wet.join(clean.bed_continuity(seeded, "_certain", s.get("search_radius", 0.3), s.get("max_slope", 0.35)).where("bed").select("pid"), "pid", "left_semi"))
    return wet.unionByName(dry)
