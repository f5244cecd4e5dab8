"""Nearest neighbours against all pairs: ties, heaps, outliers, batches, few rows."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from cloudloom.cells import knn_join


def clouds(kind):
    r = random.Random(len(kind))
    if kind == "even":
        return [(i, r.uniform(0, 100), r.uniform(0, 100), r.uniform(0, 10)) for i in range(500)]
    if kind == "grid":
        return [(i, float(i % 20), float(i // 20), 0.0) for i in range(400)]
    if kind == "heaps":  # dense, sparse, equal and far-off points
        pts = [(r.gauss(0, 0.01), r.gauss(0, 0.01), 0.0) for _ in range(300)] + [(50.0, 50.0, 1.0)] * 90 + [(r.uniform(-100, 100), r.uniform(-100, 100), 0.0) for _ in range(60)] + [(1e6, -1e6, 0.0)]
        return [(i, *p) for i, p in enumerate(pts)]
    if kind == "line":
        return [(i, 5.0, r.uniform(0, 9), 0.0) for i in range(80)]
    return [(0, 1.0, 2.0, 3.0), (1, 1.0, 2.5, 3.0)]


@pytest.mark.parametrize("kind", ["even", "grid", "heaps", "line", "two"])
@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
def test_self_join_is_all_pairs(spark, kind, dims):
    pts = clouds(kind)
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double").withColumn("tag", F.concat(F.lit("t"), "pid"))
    for aim in (16, 1024) if kind == "even" else (16,):
        got = {}
        for r in knn_join(df, df, 6, dims=dims, aim=aim).collect():
            assert r.n_tag == f"t{r.n_pid}" and r.tag == f"t{r.pid}"
            got.setdefault(r.pid, []).append((r["rank"], r.d2, r.n_pid))
        n = len(dims) + 1
        for a in pts:
            near = sorted((reduce(lambda s, pq: s + (pq[0] - pq[1]) * (pq[0] - pq[1]), zip(a[1:n], b[1:n]), 0.0), b[0]) for b in pts if b[0] != a[0])[:6]
            assert [(d, i) for _, d, i in sorted(got.get(a[0], []))] == near


def test_two_tables_and_batches(spark):
    r = random.Random(3)
    probe = [(i, r.uniform(0, 50), r.uniform(0, 50), i % 3) for i in range(100)] + [(900, 5000.0, 5000.0, 1), (901, 1.0, 1.0, 7)]
    build = [(i, r.uniform(0, 50), r.uniform(0, 50), i % 3, r.random()) for i in range(200)]
    p = spark.createDataFrame(probe, "pid long, x double, y double, batch int")
    b = spark.createDataFrame(build, "pid long, x double, y double, batch int, v double")
    got = {}
    for x in knn_join(p, b, 4, self_join=False, by="batch", aim=32).collect():
        got.setdefault(x.pid, []).append((x["rank"], x.n_pid, x.n_v))
    for i, x, y, t in probe:
        near = sorted(((x - q[1]) * (x - q[1]) + (y - q[2]) * (y - q[2]), q[0], q[4]) for q in build if q[3] == t)[:4]
        assert [(q, v) for _, q, v in sorted(got.get(i, []))] == [(q, v) for _, q, v in near]
    assert knn_join(p, b.limit(0), 2, self_join=False).count() == 0 and knn_join(p.limit(0), b, 2, self_join=False).count() == 0


def test_a_heap_of_equal_points(spark):
    """Ten thousand points in one place: each finds k others there, and none meets all of them."""
    heap = spark.range(10_000).select(F.col("id").alias("pid"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    rest = spark.range(500).select((F.col("id") + 20_000).alias("pid"), (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"))
    got = knn_join(heap.unionByName(rest), heap.unionByName(rest), 3, aim=64)
    assert got.count() == 3 * 10_500
    first = {(x.pid, x["rank"]): x.n_pid for x in got.where("pid < 5").collect()}
    assert [first[4, i] for i in (1, 2, 3)] == [0, 1, 2] and [first[0, i] for i in (1, 2, 3)] == [1, 2, 3]
