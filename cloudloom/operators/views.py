"""Several views of a training scene: crops of the points nearest to drawn centres, which points views share, and pairs of views under different draws.

The first view of a scene, the major one, is about a point whose height lies in a given part of the scene's; the centres of all other views
are points of the major view. Draws are hashes of a seed, the scene, the view and the point, so reruns agree; a column may take their place.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import bounded, settle
from ..ranges import placed
from .transforms import TRANSFORMS, compose


def _lowest(points: DataFrame, draw: Column) -> DataFrame:
    """(scene, view, cx, cy, cz) of the point with the least draw of each scene and view; ties by pid."""
    centre = F.min_by(F.struct("x", "y", "z"), F.struct(draw.alias("d"), F.col("pid").alias("p"))).alias("c")
    return points.groupBy("scene", "view").agg(centre).select("scene", "view", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


def _nearest(points: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """points once for each view they are in, with view and place, their rank by distance from the view's centre (ties by pid)."""
    own = centres.join(sizes, ["scene", "view"]).select(F.col("scene").alias("_scene"), "view", "cx", "cy", "cz", "size")
    met = points.join(bounded(own), F.col("scene") == F.col("_scene")).drop("_scene")
    d2 = reduce_squares(("x", "cx"), ("y", "cy"), ("z", "cz"))
    # Stretches of a range-partitioned order: a scene may be larger than a task.
    ranked = placed(met.withColumn("_d2", d2), ["_d2", "pid"], ("scene", "view"))
    return ranked.where(F.col("place") <= F.col("size")).drop("_d2", "cx", "cy", "cz", "size")


def reduce_squares(*pairs: tuple[str, str]) -> Column:
    out = None
    for a, b in pairs:
        part = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
        out = part if out is None else out + part
    return out


def multi_views(
    points: DataFrame, global_views: int = 2, global_share: tuple[float, float] = (0.4, 1.0), local_views: int = 4, local_share: tuple[float, float] = (0.1, 0.4), most: int = 65536,
    heights: tuple[float, float] = (0.0, 1.0), shared: bool = False, seed: int = 0, draw: Column | None = None, share: Column | None = None,
) -> DataFrame:
    """points (scene, pid, x, y, z, ...) with view and place: view 0 is the major one, then the other global ones, then the local ones.

    A view has a drawn share of the scene's points, or of ``most`` of them, and one at least (ten, where the share is nothing, if there are as many). shared: other
    global views equal the major one. draw: what chooses centres, least first; share: from 0 to 1, where in its bounds a view's share lies; both may use scene, view and, for draw, pid.
    """
    span = points.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    kinds = [(v, *global_share) for v in range(global_views)] + [(global_views + v, *local_share) for v in range(local_views)]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for v, a, b in kinds]))
    draw = F.xxhash64(F.lit(seed), "scene", "view", "pid") if draw is None else draw
    share = F.pmod(F.xxhash64(F.lit(seed + 1), "scene", "view"), F.lit(1 << 40)) / float(1 << 40) if share is None else share
    room = F.least(F.lit(most), F.col("n"))
    asked = span.select("scene", "n", each.alias("e")).select("scene", "n", "e.*").withColumn("size", F.floor((F.col("lo") + (F.col("hi") - F.col("lo")) * share) * room))
    # A share too small for one point: as many as the largest share gives, ten at least.
    sizes = settle(asked.select("scene", "view", F.when(F.col("size") > 0, F.col("size")).otherwise(F.least(F.col("n"), F.greatest(F.lit(10), F.floor(F.col("hi") * room)))).alias("size")))
    low, high = F.col("_z0") + (F.col("_z1") - F.col("_z0")) * heights[0], F.col("_z0") + (F.col("_z1") - F.col("_z0")) * heights[1]
    tall = points.join(bounded(span.select(F.col("scene").alias("_s"), F.col("z0").alias("_z0"), F.col("z1").alias("_z1"))), F.col("scene") == F.col("_s"))
    middle = _lowest(tall.where(F.col("z").between(low, high)).withColumn("view", F.lit(0)), draw)
    major = settle(_nearest(points, middle, sizes))
    others = range(1, global_views + local_views)
    copies = [v for v in others if shared and v < global_views]
    drawn = [v for v in others if v not in copies]
    spread = lambda views: F.explode(F.array(*[F.lit(v) for v in views]))
    out = major
    if copies:
        out = out.unionByName(major.withColumn("view", spread(copies)))
    if drawn:
        centres = _lowest(major.withColumn("view", spread(drawn)), draw)
        out = out.unionByName(_nearest(points, centres, sizes))
    return out


def matches(views: DataFrame) -> DataFrame:
    """(scene, pid, a, b, place_a, place_b): points that two views of a scene share, a before b. A point is in as many rows as pairs of its views, which are few."""
    own = views.groupBy("scene", "pid").agg(F.sort_array(F.collect_list(F.struct("view", "place"))).alias("v"))
    pairs = F.expr("flatten(transform(v, (a, i) -> transform(filter(v, (b, j) -> j > i), b -> struct(a.view AS a, b.view AS b, a.place AS place_a, b.place AS place_b))))")
    return own.select("scene", "pid", F.explode(pairs).alias("m")).select("scene", "pid", "m.*")


def contrastive_views(points: DataFrame, steps: list[dict], seeds: tuple[int, int] = (1, 2), select: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """points twice, as views 1 and 2, each under the same transforms with draws of its own."""
    out = None
    for view, seed in enumerate(seeds, 1):
        own = [s | {"seed": seed * 1000 + i} if s.get("type") in TRANSFORMS and "seed" in inspect.signature(TRANSFORMS[s["type"]]).parameters else s for i, s in enumerate(steps)]
        made = select(compose(own, points)).withColumn("view", F.lit(view))
        out = made if out is None else out.unionByName(made)
    return out
