"""Running sums by ranges and exact quantiles against brute force, and plans without one-task windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import evaluation, inference, register
from cloudloom.quantiles import order_statistics, percentiles
from cloudloom.ranges import placed, running


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("groups, n", [(1, 0), (1, 1), (3, 500), (200, 400)])
def test_running_is_brute_force(spark, groups, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, *range(groups)]), r.randint(-5, 5), r.uniform(-1, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g int, v int, w double")
    got = {x.id: (x.upto, x.whole, x.place) for x in running(df, [F.desc("w"), "id"], ("g",), {"upto": "v"}, {"whole": "upto"}, "place").collect()}
    want, sums = {}, {}
    for i, g, v, w in sorted(rows, key=lambda x: (-x[3], x[0])):
        s, k = sums.get(g, (0, 0))
        sums[g] = (s + v, k + 1)
        want[i] = (s + v, g, k + 1)
    assert got == {i: (s, sums[g][0], k) for i, (s, g, k) in want.items()}
    assert {x.id: x.place for x in placed(df, ["w", "id"]).collect()} == {x[0]: k + 1 for k, x in enumerate(sorted(rows, key=lambda x: (x[3], x[0])))}


def test_one_group_spreads(spark):
    """A table of one group fills several partitions."""
    df = spark.range(20_000).withColumn("g", F.lit(1))
    got = running(df, ["id"], ("g",), {"s": "id"})
    assert got.where(F.col("s") != F.col("id") * (F.col("id") + 1) / 2).isEmpty()
    assert "SinglePartition" not in plan(got)


@pytest.mark.parametrize("kind", ["even", "heavy", "ties", "tiny", "one", "huge"])
def test_percentiles_are_exact(spark, kind):
    r = np.random.default_rng(3)
    n = 20_000
    v = {"even": r.uniform(-1, 1, n), "heavy": np.exp(r.normal(0, 12, n)), "ties": r.integers(0, 5, n) * 1.0, "tiny": r.normal(size=7), "one": np.full(50, 2.5), "huge": np.concatenate([r.normal(size=n), [1.7e308, -1.7e308]])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
    shares = [0.0, 0.05, 0.5, 0.68, 0.999, 1.0]
    want = df.agg(F.expr(f"percentile(v, array({', '.join(map(str, shares))}))")).first()[0]
    assert percentiles(df, "v", shares) == want
    stored = df.where("v is not null")
    ranks = [0, len(v) // 3, len(v) - 1]
    assert order_statistics(stored, ranks, buckets=8, few=3) == [float(np.sort(v)[i]) for i in ranks]


def test_percentiles_without_values(spark):
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_no_window_without_a_bounded_key(spark):
    """The losses, the dealing of datasets and the cap by source sort no group in one task."""
    rows = spark.range(300).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("logits"), (F.col("id") % 3).cast("int").alias("target"))
    hinge = spark.range(300).select("id", (F.col("id") % 2).alias("image"), F.rand(4).alias("logit"), (F.col("id") % 3 == 0).cast("double").alias("fg"))
    sets = {"main": (rows.select("id"), 2), "small": (rows.where("id < 7").select("id"), 1)}
    for df in (evaluation.lovasz_softmax(rows), evaluation.lovasz_hinge(hinge), inference.sampled_by_weight(sets, "main")):
        windows = [line for line in plan(df).split("== Physical Plan ==")[-1].split("\n") if "Window " in line or "Window[" in line]
        assert all("_part" in w or "_s0" in w for w in windows), windows


def test_lovasz_is_brute_force(spark):
    r = np.random.default_rng(7)
    p = r.dirichlet(np.ones(3), 200)
    target = r.integers(0, 3, 200)
    df = spark.createDataFrame([(i, [float(x) for x in np.log(p[i])], int(target[i])) for i in range(200)], "id long, logits array<double>, target int")
    losses = []
    for c in range(3):
        fg = (target == c) * 1.0
        err = np.abs(fg - p[:, c])
        order = np.argsort(-err, kind="stable")
        hit, miss = fg[order].cumsum(), (1 - fg[order]).cumsum()
        jaccard = 1 - (fg.sum() - hit) / (fg.sum() + miss)
        losses.append(float(err[order] @ np.diff(np.concatenate(([0.0], jaccard)))))
    assert abs(evaluation.lovasz_softmax(df).first()[0] - np.mean(losses)) < 1e-9


def test_capped_is_the_window_rule(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    got = inference.capped(rows, {"a": 40, "b": 10_000, "d": 3})
    order = {s: sorted((x.h, x.id) for x in rows.where(F.col("source") == s).select("id", F.xxhash64(F.lit(0), "id").alias("h")).collect()) for s in "abc"}
    assert {x.id for x in got.collect()} == {i for s, most in (("a", 40), ("b", 10_000), ("c", 10_000)) for _, i in order[s][:most]}


def test_shift_and_residuals(spark):
    a = spark.range(1000).select((F.col("id") % 31).cast("double").alias("x"), (F.col("id") % 37).cast("double").alias("y"), F.lit(1.0).alias("z"))
    b = a.withColumn("z", F.col("z") + 2.5)
    assert register.vertical_shift(a, b, 5.0).first().asDict() == {"shift": 2.5, "n": 1000}
