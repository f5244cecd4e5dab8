"""The triangulation of blocks against one triangulation of everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom import tin
from cloudloom.operators import ground, tiling, triangulate


def scene(kind):
    r = np.random.default_rng(len(kind))
    xy = r.uniform(0, 100, (1500, 2))
    if kind == "lake":  # a hole far wider than a margin
        xy = xy[np.hypot(xy[:, 0] - 50, xy[:, 1] - 45) > 35]
    if kind == "clumps":
        xy = np.concatenate([r.normal(c, 3, (300, 2)) for c in ((5, 5), (95, 10), (50, 90))] + [r.uniform(0, 100, (20, 2))])
    if kind == "grid":  # four points on every circle
        xy = np.stack(np.meshgrid(np.arange(0, 100, 4.0), np.arange(0, 100, 4.0)), axis=-1).reshape(-1, 2)
    z = np.sin(xy[:, 0] / 7) * 5 + xy[:, 1] * 0.1 + r.normal(0, 0.5, len(xy))
    return np.column_stack((xy, z))


@pytest.mark.parametrize("kind", ["even", "lake", "clumps", "grid"])
def test_blocks_agree_with_one_triangulation(spark, kind):
    xyz = scene(kind)
    shift = 1e-4
    asked = np.stack(np.meshgrid(np.arange(1.3, 100, 3), np.arange(1.7, 100, 3)), axis=-1).reshape(-1, 2)
    want, _ = triangulate.heights(np.column_stack((triangulate.moved(xyz[:, :2], shift), xyz[:, 2])), asked)
    df = spark.createDataFrame([tuple(map(float, p)) for p in xyz], "x double, y double, z double")
    df = df.unionByName(df.limit(5).withColumn("z", F.col("z") + 9))  # the lower of two at one place counts
    wanted = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "id long, x double, y double")
    for edge in (1000.0, 50.0, 20.0):
        got = {r.id: r.z for r in triangulate.interpolate(df, wanted, shift, edge, margin=edge / 8).collect()}
        assert set(got) == set(np.flatnonzero(~np.isnan(want)).tolist())
        assert np.allclose([got[i] for i in sorted(got)], want[sorted(got)], atol=1e-6), (kind, edge)


def test_few_points(spark):
    wanted = spark.createDataFrame([(0, 1.0, 1.0)], "id long, x double, y double")
    for pts in ([], [(0.0, 0.0, 1.0)], [(0.0, 0.0, 1.0), (2.0, 2.0, 1.0)], [(0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (2.0, 2.0, 1.0)]):
        assert triangulate.interpolate(spark.createDataFrame(pts, "x double, y double, z double"), wanted, 1e-6).count() == 0
    three = spark.createDataFrame([(0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (0.0, 4.0, 5.0)], "x double, y double, z double")
    assert abs(triangulate.interpolate(three, wanted, 1e-9).first().z - 2.0) < 1e-6


def test_raster_does_not_depend_on_blocks(spark):
    xyz = scene("lake")
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    made = [{(r.row, r.col): (r.how, round(r.z, 6)) for r in ground.terrain_raster(df, 5.0, 20, 20, edge=e).collect()} for e in (500.0, 25.0)]
    assert len(made[0]) == 400 and made[0] == made[1]


def test_block_edge_follows_the_densest(spark):
    even = spark.range(3000).select((F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"))
    heap = even.unionByName(spark.range(3000).select((F.rand(3) * 2).alias("x"), (F.rand(4) * 2).alias("y")))
    assert triangulate.block_edge(heap, 500, 600) < triangulate.block_edge(even, 500, 600)


def test_boxes_by_cells_are_all_pairs(spark):
    r = random.Random(2)
    pts = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(200)] + [(900, 3.0, 3.0)]
    boxes = [(b, x, x + r.choice([0.0, 1, 4]), y, y + r.choice([0.5, 2])) for b in range(30) for x, y in [(r.uniform(0, 9), r.uniform(0, 9))]] + [(99, 3.0, 3.0, 3.0, 3.0)]
    for margin in (0.0, 0.7):
        got = {(x.b, x.id) for x in tiling.in_boxes(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(boxes, "b long, min_x double, max_x double, min_y double, max_y double"), margin).collect()}
        assert got == {(b, i) for b, x0, x1, y0, y1 in boxes for i, x, y in pts if x0 - margin <= x <= x1 + margin and y0 - margin <= y <= y1 + margin}
