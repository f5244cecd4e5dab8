"""Noise filters over cell joins: each adds a boolean ``keep``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..balls import aggregate_spots, finite, has_place, linked_spots
from ..cells import ball_aggregate, cell, knn_join, with_groups
from ..graph import components
from ..lineage import bounded, settle
from ..quantiles import percentile


def radius_outliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """keep: at least so many points within the radius, the point itself included."""
    counted = ball_aggregate(points, radius, ("x", "y", "z"), {"n": ("sum", F.lit(1).cast("long"))})
    return counted.withColumn("keep", F.col("n") >= least)


def enough_near(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(pid, keep): what ``radius_outliers`` keeps, without the counts.

    Of a cell no wider than the radius across that holds so many points all stay, so only points of other cells are counted.
    """
    dims, keys = ("x", "y", "z"), ["k0", "k1", "k2"]
    placed = finite(points.select("pid", *dims), dims)
    far = placed.agg(F.max(F.array_max(F.array(*[F.abs(F.col(d)) for d in dims])))).first()[0] or 0.0
    # Beyond that, cells are not exact enough: then each place is one.
    gridded = far < radius * (1 << 28)
    own = placed.withColumns({k: cell(d, radius / 3**0.5 * (1 - 1e-6)) if gridded else F.col(d) for k, d in zip(keys, dims)})
    cells = settle(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    thin = cells.where(F.col("n") < least).select(*keys)
    spots_of = lambda rows: rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")).withColumn("spot", F.monotonically_increasing_id())
    loose = settle(spots_of(own.join(bounded(thin), keys, "left_semi")))
    if gridded:
        blocks = _around(thin, keys, 2)
        near = own.withColumns({b: F.floor(F.col(k) / 2) for k, b in zip(keys, blocks.columns)}).join(bounded(settle(blocks)), blocks.columns, "left_semi")
    else:
        near = own
    counted = aggregate_spots(loose, settle(spots_of(near)), radius, dims, {"n": "sum"})
    counted = settle(loose.select("spot", F.struct(*dims).alias("g")).join(counted, "spot").select("g", "n"))
    rest = with_groups(own.join(bounded(thin), keys, "left_semi").select("pid", F.struct(*dims).alias("g")), counted).select("pid", "n")
    full = own.join(bounded(thin), keys, "left_anti").select("pid", F.lit(least).cast("long").alias("n"))
    return full.unionByName(rest).groupBy("pid").agg((F.sum("n") >= least).alias("keep"))


def low_points(points: DataFrame, radius: float, below: float, above: float, exclude_self: bool = True) -> DataFrame:
    """keep: no lower than the lowest neighbour less ``below``, no higher than the highest plus ``above``.

    With the point among its own neighbours the rule can never fire; ``exclude_self=False`` gives that behaviour.
    """
    small = points.select("pid", "x", "y", "z")
    dims, at = ("x", "y"), F.struct("x", "y").alias("g")
    # Heights over one place in XY are one spot: its extremes meet those of other places, and within a place its second ones stand in for a point's own.
    heights = settle(finite(small, dims).where("z is not null and not isnan(z)").groupBy(*dims, "z").agg(F.count(F.lit(1)).alias("n")))
    first = heights.groupBy(*dims).agg(F.sum("n").alias("n"), F.min(F.struct("z", "n")).alias("a"), F.max(F.struct("z", "n")).alias("b"))
    first = settle(first.select("n", *[F.col(f"{k}.{c}").alias(k + c) for k in "ab" for c in "zn"], at).withColumn("spot", F.monotonically_increasing_id()))
    found = first
    if exclude_self:
        inner = with_groups(heights.select("z", at), first.select("g", "n", "az", "bz"))
        second = inner.groupBy("g").agg(F.min(F.when(F.col("z") > F.col("az"), F.col("z"))).alias("a2"), F.max(F.when(F.col("z") < F.col("bz"), F.col("z"))).alias("b2"))
        found = first.join(second, "g").withColumns({f"{k}2": F.when(F.col(k + "n") > 1, F.col(k + "z")).otherwise(F.col(k + "2")) for k in "ab"})
    spots = first.select("spot", "g.*", F.col("az").alias("lo"), F.col("bz").alias("hi"), F.lit(1).cast("long").alias("n"))
    about = aggregate_spots(spots, spots, radius, dims, {"lo": "min", "hi": "max"}, others=True)
    found = settle(found.join(about, "spot", "left").drop("spot"))
    met = with_groups(finite(small, dims).select("pid", "z", at), found)
    own = lambda k: F.when(F.col("z") == F.col(k + "z"), F.col(k + "2")).otherwise(F.col(k + "z")) if exclude_self else F.col(k + "z")
    odd = (F.col("z") < F.least("lo", own("a")) - below) | (F.col("z") > F.greatest("hi", own("b")) + above)
    gone = settle(met.where(odd).select("pid"))
    return small.join(bounded(gone.withColumnsRenamed({"pid": "p"})), F.col("pid") == F.col("p"), "left").select("pid", "z", F.col("p").isNull().alias("keep"))


def statistical_outliers(points: DataFrame, k: int, ratio: float, size: float | None = None) -> DataFrame:
    """keep: mean distance to the k nearest others at most mean + ratio * deviation over all points."""
    small = points.select("pid", "x", "y", "z")

    def averaged(rows: pa.Table, i: np.ndarray, near: pa.Table, j: np.ndarray, d2: np.ndarray) -> pa.Table:
        return pa.table({"pid": rows["pid"], "mean_d": np.bincount(i, np.sqrt(d2), rows.num_rows) / np.bincount(i, minlength=rows.num_rows)})

    mean = knn_join(small, small, k, size, ("x", "y", "z"), reduce_to=(averaged, f"pid {points.schema['pid'].dataType.simpleString()}, mean_d double"))
    mean = mean.select("pid", F.round("mean_d", 6).alias("mean_d"))
    limit = mean.agg((F.avg("mean_d") + ratio * F.stddev_pop("mean_d")).alias("top"))
    return mean.crossJoin(F.broadcast(limit)).select("pid", "mean_d", (F.col("mean_d") <= F.col("top")).alias("keep"))


def bilateral(points: DataFrame, k: int, sigma_s: float, sigma_r: float, size: float | None = None) -> DataFrame:
    """Each point moved to the mean of its neighbours, weighted by distance and by height difference."""
    small = points.select("pid", "x", "y", "z")
    near = knn_join(small, small, k, size, ("x", "y", "z"))
    dz2 = (F.col("z") - F.col("n_z")) * (F.col("z") - F.col("n_z"))
    w = F.exp(-F.col("d2") / (2 * sigma_s**2)) * F.exp(-dz2 / (2 * sigma_r**2))
    sums = near.withColumn("w", w).groupBy("pid", "x", "y", "z").agg(F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(f"n_{d}")).alias(f"s{d}") for d in "xyz"])
    return sums.select("pid", *[F.when(F.col("sw") > 0, F.col(f"s{d}") / F.col("sw")).otherwise(F.col(d)).alias(d) for d in "xyz"])


def nearest_distance(points: DataFrame, size: float | None = None) -> DataFrame:
    """Distance to the nearest other point in XY."""
    small = points.select("pid", "x", "y")

    def nearest(rows: pa.Table, i: np.ndarray, near: pa.Table, j: np.ndarray, d2: np.ndarray) -> pa.Table:
        return pa.table({"pid": rows["pid"], "nearest": near["n_pid"].take(j), "dist": np.sqrt(d2)})  # one a row

    kind = points.schema["pid"].dataType.simpleString()
    return knn_join(small, small, 1, size, reduce_to=(nearest, f"pid {kind}, nearest {kind}, dist double"))


def low_cleanup(points: DataFrame, k: int, drop: float, size: float | None = None) -> DataFrame:
    """keep: no more than ``drop`` below the median height of the k XY neighbours (one pass)."""
    small = points.select("pid", "x", "y", "z")
    near = knn_join(small, small, k, size)
    mid = near.groupBy("pid", "z").agg(F.expr("percentile(n_z, 0.5)").alias("mid"))
    return mid.select("pid", F.round("mid", 6).alias("mid"), (F.col("z") >= F.col("mid") - drop).alias("keep"))


def _around(cells: DataFrame, keys: list[str], width: int, *values: Column) -> DataFrame:
    """Blocks of ``width`` cells a side that hold any of the cells or touch one that does; values: aggregates over those cells, merged by their names least_, most_ or any_."""
    blocks = [f"b{i}" for i in range(len(keys))]
    out = cells.groupBy(*[F.floor(F.col(k) / width).alias(b) for k, b in zip(keys, blocks)]).agg(F.count(F.lit(1)).alias("_n"), *values).drop("_n")
    for b in blocks:
        out = out.withColumn(b, F.explode(F.array(*[F.col(b) + i for i in (-1, 0, 1)])))
    merge = {"least": F.min, "most": F.max, "any": F.max}
    named = [c for c in out.columns if c not in blocks]
    return out.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"), *[merge[c.split("_")[0]](c).alias(c) for c in named]).drop("_n")


def _clusters(points: DataFrame, eps: float, least: int, dims: tuple[str, ...]) -> DataFrame:
    """points with the label that dbscan gives them.

    Space is cut into cells no wider than eps across: a cell of ``least`` points has core points only, and the core points of any cell are one cluster. So crowded
    cells are never searched. Counted are the few points of other cells, linked are the outermost core points of each cell; only where cells of different
    clusters lie side by side, and some have more points than those, are all of their points linked.
    """
    placed = finite(points, dims)
    keys, width = [f"k{i}" for i in range(len(dims))], int(len(dims) ** 0.5) + 1
    far = placed.agg(F.max(F.array_max(F.array(*[F.abs(F.col(d)) for d in dims])))).first()[0] or 0.0
    # Beyond that, cells are not exact enough: then each place is one.
    gridded = far / eps < 1 << 28
    edge = eps / len(dims) ** 0.5 * (1 - 1e-6)
    own = placed.withColumns({k: cell(d, edge) if gridded else F.col(d) for k, d in zip(keys, dims)})
    spots_of = lambda rows: rows.groupBy(*keys, *dims).agg(F.min("pid").cast("long").alias("spot"), F.count(F.lit(1)).alias("n"))

    def spots_about(cells: DataFrame) -> DataFrame:
        """The spots that may be within eps of some spot of the cells."""
        if not gridded:
            return spots_of(own)
        blocks = _around(cells, keys, width)
        return spots_of(own.withColumns({b: F.floor(F.col(k) / width) for k, b in zip(keys, blocks.columns)}).join(bounded(blocks), blocks.columns, "left_semi"))

    at = F.struct("spot", *dims)
    ends = F.array_distinct(F.array(*[f(at, F.col(d)) for d in dims for f in (F.min_by, F.max_by)]))
    cells = spots_of(own).groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.min("spot").alias("low"), ends.alias("ends"))
    cells = settle(cells.withColumn("ends", F.when(F.col("n") >= least, F.col("ends"))))
    full, thin = cells.where(F.col("n") >= least), cells.where(F.col("n") < least).select(*keys)
    loose = settle(spots_of(own.join(bounded(thin), keys, "left_semi")))
    near = settle(spots_about(thin))
    counted = aggregate_spots(loose, near, eps, dims, {"n": "sum"}).where(F.col("n") >= least)
    lone = settle(loose.join(counted.select("spot"), "spot", "left_semi").select("spot", *dims, *keys))  # core points of thin cells
    nodes = settle(full.select(F.explode("ends").alias("e"), *keys).select("e.*", *keys).unionByName(lone))
    named = nodes.select("spot", *keys).join(linked_spots(nodes, eps, dims), "spot").groupBy(*keys).agg(F.min("label").alias("part"))
    facts = full.select(*keys, "low", (F.col("places") > F.size("ends")).alias("more")).unionByName(lone.groupBy(*keys).agg(F.min("spot").alias("low")).withColumn("more", F.lit(False)))
    parts = settle(named.join(facts, keys))
    if gridded:
        blocks = _around(parts, keys, width, F.min("part").alias("least_part"), F.max("part").alias("most_part"), F.max("more").alias("any_more"))
        blocks = settle(blocks.where("any_more and least_part < most_part").drop("least_part", "most_part", "any_more"))
        if not blocks.isEmpty():
            side = settle(parts.withColumns({b: F.floor(F.col(k) / width) for k, b in zip(keys, blocks.columns)}).join(bounded(blocks), blocks.columns, "left_semi").select(*keys, "part"))
            crowded = spots_of(own.join(bounded(side.join(full, keys, "left_semi").select(*keys)), keys, "left_semi")).select("spot", *dims, *keys)
            open_spots = settle(crowded.unionByName(lone.join(bounded(side.select(*keys)), keys, "left_semi").select("spot", *dims, *keys)))
            met = open_spots.select("spot", *keys).join(linked_spots(open_spots, eps, dims), "spot").join(bounded(side), keys)
            joins = settle(met.select(F.col("part").alias("a"), F.col("label").alias("b")).where("a <> b").distinct())
            if not joins.isEmpty():
                merged = settle(components(joins)).withColumnRenamed("label", "_part")
                parts = settle(parts.join(bounded(merged), F.col("part") == F.col("v"), "left").select(*keys, "low", F.coalesce("_part", "part").alias("part")))
    names = settle(parts.groupBy("part").agg(F.min("low").alias("label"), F.count(F.lit(1)).alias("n")))
    labels = settle(with_groups(parts.select("part", *keys), names, "part").select(*keys, "label"))
    rest = settle(loose.join(lone.select("spot"), "spot", "left_anti").select("spot", *dims))
    seen = settle(near.join(rest.select("spot"), "spot", "left_anti").join(bounded(labels), keys).select(*dims, "label"))
    border = aggregate_spots(rest, seen, eps, dims, {"label": "min"})
    found = lone.join(bounded(labels), keys).select("spot", "label").unionByName(border)
    loose = settle(loose.select("spot", *dims).join(found, "spot", "left").select(*dims, "label"))
    g = F.struct(*keys).alias("g")
    whole = settle(cells.select(g, *keys, "n").join(labels, keys, "left").select("g", "n", (F.col("n") < least).alias("thin"), "label"))
    met = with_groups(own.select(*points.columns, g), whole)
    thick = met.where("not thin").select(*points.columns, "label")
    others = met.where("thin").select(*points.columns).join(loose, list(dims), "left").select(*points.columns, "label")
    return thick.unionByName(others).unionByName(points.where(~has_place(dims)).withColumn("label", F.lit(None).cast("long")))


def dbscan(points: DataFrame, eps: float, least: int, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(pid, label): the smallest core id of each cluster; null for noise."""
    return _clusters(points.select("pid", *dims), eps, least, dims).select("pid", "label")


def dbscan_noise(points: DataFrame, eps: float, least: int, smallest: int, mode: str = "both", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """keep: false for noise points and points of clusters under ``smallest`` that lie ``above``, ``below`` or on either side
    of the median height; a small cluster is judged by its mean height, a noise point by its own."""
    if mode not in ("above", "below", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    labelled = _clusters(points.select("pid", *dict.fromkeys((*dims, "z"))), eps, least, dims)
    mid = F.lit(percentile(points, "z", 0.5)).cast("double").alias("mid")
    means = labelled.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.avg("z").alias("level"))
    small = settle(means.where(F.col("members") < smallest))
    judged = labelled.join(bounded(small), "label", "left").select("*", mid)
    level = F.when(F.col("label").isNull(), F.col("z")).otherwise(F.col("level"))
    off = {"above": level > F.col("mid"), "below": level < F.col("mid"), "both": level.isNotNull()}[mode]
    return judged.select("pid", "label", (~F.coalesce(off, F.lit(False))).alias("keep"))
