"""Sums and extremes over balls against all pairs, and crowded spots without pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cloudloom.cells import ball_aggregate
from cloudloom.operators import noise


def clouds(kind):
    r = random.Random(len(kind))
    u = lambda a, b: r.uniform(a, b)
    if kind == "sparse":
        xyz = [(u(-40, 40), u(-40, 40), u(-40, 40)) for _ in range(300)]
    elif kind == "grid":  # distances that equal the radius
        xyz = [(float(x), float(y), float(z)) for x in range(-3, 4) for y in range(7) for z in range(5)]
    elif kind == "heaps":  # two heaps about one radius apart, and equal points
        xyz = [(u(0, 1), u(0, 1), u(0, 1)) for _ in range(200)] + [(u(3, 4.5), u(0, 1), u(0, 1)) for _ in range(200)] + [(0.5, 0.5, 0.5)] * 60
    else:
        xyz = [(1.0, 2.0, 3.0)]
    return [(i, *p) for i, p in enumerate(xyz)]


@pytest.mark.parametrize("kind", ["sparse", "grid", "heaps", "one"])
@pytest.mark.parametrize("heavy", [1, 1 << 14])
def test_counts_are_all_pairs(spark, kind, heavy):
    pts = clouds(kind)
    radius = {"sparse": 12.0, "grid": 2.0, "heaps": 3.0, "one": 1.0}[kind]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    got = {r.pid: r.n for r in ball_aggregate(df, radius, ("x", "y", "z"), {"n": ("sum", F.lit(1).cast("long"))}, heavy=heavy).collect()}
    inside = lambda a, b: sum((p - q) * (p - q) for p, q in zip(a[1:], b[1:])) <= radius * radius
    assert got == {a[0]: sum(inside(a, b) for b in pts) for a in pts}


@pytest.mark.parametrize("kind", ["sparse", "grid", "heaps", "one"])
@pytest.mark.parametrize("exclude", [True, False])
def test_low_points_are_all_pairs(spark, kind, exclude):
    pts = clouds(kind)
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    got = {r.pid: r.keep for r in noise.low_points(df, 3.0, 0.4, 0.4, exclude_self=exclude).collect()}
    for a in pts:
        near = [b[3] for b in pts if (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) <= 9.0 and not (exclude and a[0] == b[0])]
        assert got[a[0]] == (not near or min(near) - 0.4 <= a[3] <= max(near) + 0.4)


def test_ten_thousand_points_in_one_spot(spark):
    """All pairs would be 10^8: no join hands on more than some rows a point."""
    rest = spark.range(2000).select(F.col("id").alias("pid"), (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"), (F.rand(3) * 100).alias("z"))
    spot = spark.range(10_000).select((F.col("id") + 5000).alias("pid"), F.lit(50.0).alias("x"), (F.lit(50.0) + F.rand(4) / 100).alias("y"), F.lit(50.0).alias("z"))
    got = noise.radius_outliers(rest.unionByName(spot), 5.0, 10)
    assert got.where("pid >= 5000 and n < 10000").isEmpty() and got.count() == 12_000
    assert not math.isnan(got.agg(F.sum("n")).first()[0])
