"""Queries against DuckDB, cell joins against brute force, analytic scenes."""

import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom import queries as q
from cloudloom.cells import knn_join, radius_join
from cloudloom.operators import bathy, noise, register

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: None if v is None or v is pd.NA or v != v else v if isinstance(v, (str, bool)) else float(v)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


# Several rounds of three-dimensional neighbour joins each: their operators have tests of their own.
SLOW = {"statistical_outliers", "bilateral", "smoothed_classes", "refined_classes", "headless_filter", "ground_probability", "topo_discriminator", "random_transforms", "grouping", "dilated_neighbours", "subtraction", "aggregation", "nearest_thinned", "dbscan_filter"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(q.oracle_sql()) - SLOW))
def test_against_duckdb(spark, duck, name):
    assert rows(q.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(q.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert q.queries()[name](spark, DATA).columns


def cloud(spark, n, seed=1):
    r = random.Random(seed)
    pts = [(i, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-5, 5)) for i in range(n)]
    return pts, spark.createDataFrame(pts, "pid long, x double, y double, z double")


def test_radius_join_is_brute_force(spark):
    pts, df = cloud(spark, 200)
    got = {(r.pid, r.n_pid) for r in radius_join(df, df, 10.0).select("pid", "n_pid").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) <= 10.0}


def test_knn_join_is_brute_force(spark):
    pts, df = cloud(spark, 120)
    got = {}
    for r in knn_join(df, df, 4, 8.0).collect():
        got.setdefault(r.pid, []).append((r.rank, r.n_pid))
    for a in pts:
        near = sorted((math.dist(a[1:3], b[1:3]), b[0]) for b in pts if b[0] != a[0])[:4]
        assert [n for _, n in sorted(got[a[0]])] == [n for _, n in near]


def test_dbscan_two_blobs(spark):
    pts = [(i, float(i % 5), float(i // 5), 0.0) for i in range(25)] + [(100 + i, 60.0 + i % 5, float(i // 5), 0.0) for i in range(25)] + [(999, 30.0, 30.0, 0.0)]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    got = {r.pid: r.label for r in noise.dbscan(df, 1.5, 4).collect()}
    assert {got[i] for i in range(25)} == {min(got[i] for i in range(25))}
    assert len({got[100 + i] for i in range(25)}) == 1 and got[100] != got[0] and got[999] is None


def test_low_points_with_itself_never_fires(spark):
    _, df = cloud(spark, 60)
    assert noise.low_points(df, 20, 0.5, 0.5, exclude_self=False).where(~F.col("keep")).isEmpty()


def test_trajectory_is_clamped(spark):
    traj = spark.createDataFrame([(10.0, 0.0, 0.0, 100.0), (20.0, 10.0, 0.0, 100.0)], "t double, x double, y double, z double")
    pts = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 25.0)], "pid long, t double")
    assert {r.pid: r.sx for r in bathy.interpolate(pts, traj, 5.0).collect()} == {1: 0.0, 2: 5.0, 3: 10.0}


def test_helmert_recovers_parameters(spark):
    r = random.Random(4)
    c, s = math.cos(0.3), math.sin(0.3)
    pairs = []
    for _ in range(12):
        x, y, z = (r.uniform(-10, 10) for _ in range(3))
        pairs.append((x, y, z, 2 * (c * x - s * y) + 5, 2 * (s * x + c * y) - 3, 2 * z + 1))
    scale, rotation, shift = register.estimate_helmert(spark.createDataFrame(pairs, "sx double, sy double, sz double, tx double, ty double, tz double"))
    assert abs(scale - 2) < 1e-9 and abs(rotation[0, 0] - c) < 1e-9 and abs(shift[0] - 5) < 1e-9


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
