"""Filter pipelines: lists of steps, each run on what the steps before kept, and presets of them in JSON."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Stages, settle
from . import clean, ground, noise, selection
from .basic import thin_average

STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def step(*names: str):
    """Register a step: a function of the points kept so far and its parameters, which gives the points it keeps (or moves)."""

    def add(f):
        for name in names:
            STEPS[name] = f
        return f

    return add


def _kept(points: DataFrame, marks: DataFrame, column: str = "keep") -> DataFrame:
    """The points marked to stay. Numbers alone are shuffled first: if few points go, the rows stay where they are."""
    stay = marks.where(F.col(column)).select("pid")
    gone = settle(points.select("pid").join(stay, "pid", "left_anti").where("pid is not null"))
    few = 1 << 17
    if gone.limit(few + 1).count() <= few:
        return points.where("pid is not null").join(F.broadcast(gone), "pid", "left_anti")
    return points.join(gone, "pid", "left_anti").where("pid is not null")


@step("sor")
def _sor(p, o):
    return _kept(p, noise.statistical_outliers(p, int(o.get("nb_neighbors", 20)), float(o.get("std_ratio", 2.0))))


@step("ror")
def _ror(p, o):
    return _kept(p, noise.enough_near(p, o.get("radius", 1.0), int(o.get("min_points", 5))))


@step("isolated")
def _isolated(p, o):
    return _kept(p, noise.enough_near(p, o.get("search_radius", 0.5), int(o.get("min_neighbors", 3))))


@step("low_points")
def _low(p, o):
    return _kept(p, noise.low_points(p, o.get("search_radius", 2.0), o.get("below_threshold", 1.0), o.get("above_threshold", 10.0), not o.get("compat", False)))


@step("surface_noise")
def _surface(p, o):
    return _kept(p, clean.surface_noise(p, o.get("grid_size", 0.5), o.get("tolerance", 0.15), o.get("reference_class"), o.get("proximity")))


@step("surface_cleanup")
def _cleanup(p, o):
    """Noise about the surface of ground points; the points stay, as noise class."""
    marks = clean.surface_noise(p, o.get("grid_size", 0.5), o.get("tolerance", 0.15), int(o.get("reference_class", 2))).select(F.col("pid").alias("_p"), "keep")
    code = F.when(F.col("keep"), F.col("classification")).otherwise(selection.LOW_NOISE).cast("int")
    return p.join(marks, F.col("pid") == F.col("_p")).withColumn("classification", code).drop("_p", "keep")


@step("multipath")
def _multipath(p, o):
    return _kept(p, clean.multipath(p, o.get("depth_threshold", 0.5)))


@step("bilateral")
def _bilateral(p, o):
    """Moves points, keeps all."""
    moved = noise.bilateral(p, int(o.get("knn", 20)), o.get("spatial_sigma", 0.5), o.get("range_sigma", 0.1))
    return p.drop("x", "y", "z").join(moved, "pid")


@step("thin_average")
def _thin(p, o):
    return p.join(thin_average(p, o.get("grid_size", 2.0)).select("pid"), "pid", "left_semi")


@step("topo_discriminator")
def _topo(p, o):
    target = o.get("target", "terrain_only")
    if target not in ("terrain_only", "rock_only", "both"):
        raise ValueError(f"unknown target {target!r}")
    keep = {"terrain_only": F.col("terrain"), "rock_only": F.col("rock")}.get(target, F.col("terrain") | F.col("rock"))
    return _kept(p, clean.discriminate(p, int(o.get("k_neighbors", 15))).withColumn("keep", keep))


@step("bathy_water_surface")
def _ghosts(p, o):
    return _kept(p, clean.water_ghosts(p, o.get("tile_length", 40.0), compat=o.get("compat", False)))


@step("bathy_river_crop")
def _river(p, o):
    marks = clean.river_corridor(p, o.get("grid_res", 2.0), o.get("water_surface_z"))
    flagged = p.join(marks, "pid")
    keep = selection.keep_topo(F.col("river")) if "sensor" in p.columns else F.col("river")
    return flagged.where(keep).drop("river")


@step("benthic_continuity")
def _benthic(p, o):
    if "certain" not in p.columns and "seed" not in o:
        raise ValueError("benthic_continuity needs a seed: an SQL condition for certain bed points")
    own = p.withColumn("_certain", F.expr(o["seed"]) if "seed" in o else F.col("certain"))
    return _kept(p, clean.bed_continuity(own, "_certain", o.get("search_radius", 0.3), o.get("max_slope", 0.35)), "bed")


@step("ground_smrf")
def _smrf(p, o):
    names = {"slope_threshold": "slope", "max_window": "most", "elevation_threshold": "height", "base_window": "base", "window_growth": "growth"}
    return _kept(p, ground.smrf(p, o.get("cell_size"), **{v: o[k] for k, v in names.items() if k in o}), "ground")


@step("ground_tin")
def _tin(p, o):
    names = {
        "max_distance": "distance", "max_angle": "angle", "max_terrain_angle": "steepest", "reduce_iter_angle_when_edge": "reduce_edge", "stop_tri_when_edge": "stop_edge",
        "only_upward": "only_upward", "follow_surface_trend": "follow_slope", "max_building_size": "building", "cell_size": "cell_size", "remove_low_outliers": "low_outliers",
        "low_outlier_neighbors": "neighbours", "low_outlier_threshold": "drop", "exclude_single_returns_in_water": "drop_single_water",
    }
    return _kept(p, ground.densify(p, **{v: o[k] for k, v in names.items() if k in o}), "ground")


def _dbscan(mode: str):
    def run(p, o):
        return _kept(p, noise.dbscan_noise(p, o.get("eps", 2.0), int(o.get("min_samples", 10)), int(o.get("min_cluster_size", 50)), mode))

    return run


for _mode in ("above", "below"):
    step(f"dbscan_{_mode}")(_dbscan(_mode))
step("dbscan")(_dbscan("both"))


def check(pipeline: list[dict]) -> None:
    """Raise for anything but a list of steps with known types."""
    if not isinstance(pipeline, list):
        raise ValueError("a pipeline is a list of steps")
    for s in pipeline:
        if not isinstance(s, dict) or "type" not in s:
            raise ValueError("each step needs a type")
        if s["type"] not in STEPS:
            raise ValueError(f"unknown step {s['type']!r}; known: {', '.join(sorted(STEPS))}")


def run(points: DataFrame, pipeline: list[dict], timings: list | None = None) -> DataFrame:
    """The points that all steps keep. Each step's result is written before the next, so no step is worked out twice.

    timings: gets (type, seconds, rows left) of each step.
    """
    check(pipeline)
    stages = Stages(points)
    for s in pipeline:
        began = time.time()
        stages.put(STEPS[s["type"]](stages.now, s))
        if timings is not None:
            timings.append((s["type"], time.time() - began, stages.now.count()))
    return stages.now


def keep_mask(points: DataFrame, pipeline: list[dict]) -> DataFrame:
    """(pid, keep) over all points."""
    left = run(points, pipeline).select(F.col("pid").alias("_p"), F.lit(True).alias("_k"))
    return points.select("pid").join(left, F.col("pid") == F.col("_p"), "left").select("pid", F.coalesce("_k", F.lit(False)).alias("keep"))


def split(points: DataFrame, pipeline: list[dict]) -> tuple[DataFrame, DataFrame]:
    """What a pipeline keeps, as it left it, and what it drops, as it was, marked as noise."""
    left = run(points, pipeline)
    gone = points.join(left.select("pid"), "pid", "left_anti").withColumn("status", F.lit("NOISE"))
    return left, gone


def save_preset(path: str, pipeline: list[dict], description: str = "filter pipeline preset") -> None:
    check(pipeline)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"description": description, "pipeline": pipeline}, f, indent=2)


def load_preset(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f).get("pipeline", [])
    check(loaded)
    return loaded


def headless(points: DataFrame, active: set[str], o: dict) -> DataFrame:
    """The second family of filters in their fixed order: intensity, radius, statistics, isolated, low points, surface, then a terrain model and
    the filters that need heights over it: floor, and clusters in the air unless they are lines."""
    left, stages = points, Stages(points)
    if "intensity" in active:
        left = selection.intensity_floor(left, o["intensity_min"])
    if "ror" in active:
        left = _kept(left, noise.enough_near(left, o["ror_radius"], int(o["ror_min_points"])))
    if "sor" in active:
        left = _kept(left, noise.statistical_outliers(left, int(o["sor_neighbors"]), o["sor_std_ratio"]))
    left = stages.put(left)
    if "isolated" in active:
        near = noise.nearest_distance(left).where(F.col("dist") <= o.get("isolated_min_dist", 0.5))
        left = stages.put(left.join(near.select("pid"), "pid", "left_semi"))
    if "low_points" in active:
        left = stages.put(_kept(left, noise.low_points(left, o.get("lowpts_radius", 2.0), o.get("lowpts_below", 1.0), o.get("lowpts_above", 10.0))))
    if "surface_noise" in active:
        left = stages.put(_kept(left, clean.surface_noise(left, o.get("surf_grid", 0.5), o.get("surf_tolerance", 0.05), above=o.get("surf_proximity", 0.25))))
    if not active & {"floor", "dbscan"}:
        return left
    size = o.get("dtm_grid_size", 2.0)
    model = ground.ground_model(left, size).select(F.col("tile").alias("_t"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").alias("_g"))
    corner = left.groupBy(F.col("tile").alias("_ct")).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    own = left.join(F.broadcast(corner), F.col("tile") == F.col("_ct"))
    at = (F.col("tile") == F.col("_t")) & (F.floor((F.col("y") - F.col("_y0")) / size) == F.col("_r")) & (F.floor((F.col("x") - F.col("_x0")) / size) == F.col("_c"))
    own = stages.put(own.join(model, at, "left").withColumn("hag", F.coalesce(F.col("z") - F.col("_g"), F.lit(0.0))).drop("_ct", "_x0", "_y0", "_t", "_r", "_c", "_g"))
    if "floor" in active:
        own = stages.put(selection.floor_filter(own, o["floor_buffer"]))
    if "dbscan" in active:
        high = own.where(F.col("hag") > o["dbscan_base_alt"])
        labels = settle(noise.dbscan(high, o["dbscan_eps"], int(o["dbscan_min_points"])).withColumnRenamed("label", "cluster").where("cluster is not null"))
        lines = ground.linearity(high.join(labels, "pid")).where(F.col("linearity") >= o["dbscan_linearity"])
        stay = labels.join(lines.select("cluster"), "cluster", "left_semi").select("pid")
        own = own.where(F.col("hag") <= o["dbscan_base_alt"]).unionByName(high.join(stay, "pid", "left_semi"))
    return own
