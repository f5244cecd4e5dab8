"""Views against loops over scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import views


def scene_points(spark, sizes=(300, 40, 1)):
    r = np.random.default_rng(1)
    rows = [(s, s * 1000 + i, *map(float, r.uniform(0, 10, 3))) for s, n in enumerate(sizes) for i in range(n)]
    return rows, spark.createDataFrame(rows, "scene int, pid long, x double, y double, z double")


@pytest.mark.parametrize("shared", [False, True])
def test_views_are_the_nearest(spark, shared):
    rows, df = scene_points(spark)
    got = views.multi_views(df, 2, (0.4, 1.0), 3, (0.1, 0.4), most=200, heights=(0.2, 0.6), shared=shared, seed=5)
    again = views.multi_views(df.repartition(5), 2, (0.4, 1.0), 3, (0.1, 0.4), most=200, heights=(0.2, 0.6), shared=shared, seed=5)
    held = {}
    for v in got.collect():
        held.setdefault((v.scene, v.view), {})[v.place] = v.pid
    assert sorted(map(tuple, got.select("scene", "view", "pid", "place").collect())) == sorted(map(tuple, again.select("scene", "view", "pid", "place").collect()))
    by_scene = {s: {p: np.array(c) for q, p, *c in rows if q == s} for s in range(3)}
    assert {k[0] for k in held} == {0, 1} or {k[0] for k in held} == {0, 1, 2}  # a scene of one point has none at these heights
    for (scene, view), places in held.items():
        own, n = by_scene[scene], len(places)
        lo, hi = (0.4, 1.0) if view < 2 else (0.1, 0.4)
        assert sorted(places) == list(range(1, n + 1)) and (lo * min(200, len(own)) - 1 <= n <= max(10, hi * min(200, len(own))) or n == len(own))
        centre = own[places[1]]  # the nearest to the centre is the centre itself
        want = sorted(own, key=lambda p: (((own[p] - centre) ** 2).sum(), p))[:n]
        assert [places[i + 1] for i in range(n)] == want
        z = [c[2] for c in own.values()]
        if view == 0:
            assert min(z) + 0.2 * (max(z) - min(z)) <= centre[2] <= min(z) + 0.6 * (max(z) - min(z))
        else:
            assert places[1] in held[scene, 0].values()
    if shared:
        assert all(held[s, 1] == held[s, 0] for s in (0, 1))


def test_matches_are_all_pairs(spark):
    _, df = scene_points(spark, (60, 20))
    own = views.multi_views(df, 2, (0.4, 0.9), 2, (0.2, 0.4), seed=2)
    rows = [(v.scene, v.pid, v.view, v.place) for v in own.collect()]
    want = {(s, p, a, b, i, j) for s, p, a, i in rows for t, q, b, j in rows if (s, p) == (t, q) and a < b}
    assert {tuple(m) for m in views.matches(own).select("scene", "pid", "a", "b", "place_a", "place_b").collect()} == want and want


def test_two_views_differ_by_their_draws(spark):
    _, df = scene_points(spark, (50,))
    steps = [{"type": "random_shift"}, {"type": "center_shift"}, {"type": "random_jitter", "sigma": 0.5, "clip": 2.0}]
    got = views.contrastive_views(df, steps)
    a, b = ({r.pid: r.x for r in got.where(F.col("view") == v).collect()} for v in (1, 2))
    assert set(a) == set(b) and len(a) == 50 and sum(abs(a[i] - b[i]) > 1e-9 for i in a) > 40
    assert {r.pid: r.x for r in views.contrastive_views(df, steps).where("view = 1").collect()} == a
    with pytest.raises(ValueError):
        views.contrastive_views(df, [{"type": "nothing"}])
