"""Operators that SQL can't express, against plain loops and analytic scenes."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom import grids, tin
from cloudloom.cells import knn_join
from cloudloom.functions import codes
from cloudloom.operators import bathy, clean, evaluation, ground, inference, kernels, noise, pipeline, register, selection, tiling

XYZ = "pid long, x double, y double, z double"


def frame(spark, rows, schema=XYZ):
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema)


def cloud(n, seed=1, size=50.0, high=5.0):
    r = random.Random(seed)
    return [(i, r.uniform(-size, size), r.uniform(-size, size), r.uniform(-high, high)) for i in range(n)]


@pytest.mark.parametrize("rows", [[(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1e6, 0.0, 0.0)], [(i, float(i % 3), 0.0, 0.0) for i in range(7)], cloud(80) + [(900, -4e5, 3e5, 0.0)]])
@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
def test_knn_reaches_everything(spark, rows, dims):
    df = frame(spark, rows)
    for size in (1.0, None):
        got = {}
        for r in knn_join(df, df, 3, size, dims).collect():
            got.setdefault(r.pid, []).append((r.rank, r.n_pid))
        for a in rows:
            at = lambda p: p[1 : 1 + len(dims)]
            near = sorted((sum((u - v) * (u - v) for u, v in zip(at(a), at(b))), b[0]) for b in rows if b[0] != a[0])[:3]
            assert [n for _, n in sorted(got[a[0]])] == [n for _, n in near]


def brute_clusters(rows, eps, least):
    near = {a[0]: [b[0] for b in rows if math.dist(a[1:], b[1:]) <= eps] for a in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core and k not in label]
    return {a[0]: label.get(a[0], min((label[k] for k in near[a[0]] if k in core), default=None)) for a in rows}


@pytest.mark.parametrize("eps,least", [(6.0, 3), (20.0, 4)])
def test_dbscan_is_brute_force(spark, eps, least):
    rows = cloud(250, 3, 40.0, 10.0) + [(1000 + i, i * eps * 0.9, 200.0, 0.0) for i in range(60)]  # and a long thin chain
    got = {r.pid: r.label for r in noise.dbscan(frame(spark, rows), eps, least).collect()}
    assert got == brute_clusters(rows, eps, least)


def test_dbscan_filter_modes(spark):
    rows = [(i, float(i % 5), float(i // 5), 0.0) for i in range(25)] + [(100 + i, 50.0, i * 0.5, 30.0) for i in range(4)] + [(200, 90.0, 0.0, -9.0)]
    df = frame(spark, rows)
    gone = lambda mode: {r.pid for r in noise.dbscan_noise(df, 1.6, 3, 10, mode).where("not keep").collect()}
    assert gone("above") == {100, 101, 102, 103} and gone("below") == {200} and gone("both") == {100, 101, 102, 103, 200}


def test_ball_clusters(spark):
    rows = [(i, *p, i % 2, 0) for i, p in enumerate((p[1:] for p in cloud(120, 5, 20.0)))]
    got = {r.pid: (r.cluster, r.size) for r in kernels.ball_clusters(frame(spark, rows, XYZ + ", batch int, label int"), 6.0, 3).collect()}
    want = {}
    for b in (0, 1):
        own = [r[:4] for r in rows if r[4] == b]
        labels = brute_clusters(own, 6.0, 1)
        for i, c in labels.items():
            n = sum(v == c for v in labels.values())
            if n >= 3:
                want[i] = (c, n)
    assert got == want


def test_farthest_points(spark):
    rows = [(*p, 0) for p in cloud(60, 8)]
    got = [r.pid for r in kernels.farthest_points(frame(spark, rows, XYZ + ", batch int"), 8).orderBy("rank").collect()]
    chosen = [0]
    while len(chosen) < 8:
        chosen.append(max(rows, key=lambda p: (min(math.dist(p[1:4], rows[c][1:4]) for c in chosen), -p[0]))[0])
    assert got == chosen


def test_hilbert_neighbours_and_back():
    n = 8
    cells = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    code = codes.hilbert_codes(*cells.T, 3)
    assert sorted(code) == list(range(n**3))
    path = cells[np.argsort(code)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert np.array_equal(np.stack(codes.hilbert_cells(code, 3), axis=1), cells)


def test_instance_precision_against_a_loop(spark):
    r = random.Random(2)
    rows = []
    for scene in range(3):
        for i in range(400):
            t = i // 40
            rows.append((scene, i, t, t if r.random() < 0.8 else r.randrange(10)))
    df = spark.createDataFrame(rows, "scene long, pid long, truth long, guess long")
    truths = df.groupBy("scene", "truth").agg((F.min("truth") % 2).alias("label"), F.count(F.lit(1)).alias("n"))
    guesses = df.groupBy("scene", "guess").agg((F.min("guess") % 2).alias("label"), (F.min("guess") / 10.0 + F.min("scene") / 100.0).alias("confidence"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("void"))
    got = {(x.label, round(x.overlap, 2)): x.ap for x in evaluation.instance_ap(truths, guesses, evaluation.instance_overlaps(df), least=5).collect()}
    size, made, both = {}, {}, {}
    for s, _, t, g in rows:
        size[s, t] = size.get((s, t), 0) + 1
        made[s, g] = made.get((s, g), 0) + 1
        both[s, t, g] = both.get((s, t, g), 0) + 1
    for (label, th), ap in got.items():
        scored, lost, used = [], 0, set()
        for (s, t), n in sorted(size.items()):
            if t % 2 != label:
                continue
            hits = [g for (s2, t2, g), m in sorted(both.items()) if (s2, t2) == (s, t) and g % 2 == label and made[s, g] >= 5 and m / (n + made[s, g] - m) > th]
            hits = [g for g in hits if (s, g) not in used]
            if not hits:
                lost += 1
                continue
            used.add((s, hits[0]))
            best = hits[0] / 10 + s / 100
            for g in hits[1:]:
                c = g / 10 + s / 100
                scored.append((min(best, c), 0))
                best = max(best, c)
            scored.append((best, 1))
        for (s, g), n in made.items():
            if g % 2 == label and n >= 5 and not any(m / (size[s2, t] + n - m) > th for (s2, t, g2), m in both.items() if (s2, g2) == (s, g) and t % 2 == label):
                scored.append((g / 10 + s / 100, 0))
        points = []
        for cut in sorted({c for c, _ in scored}):
            tp = sum(y for c, y in scored if c >= cut)
            points.append((tp / sum(c >= cut for c, _ in scored), tp / (sum(y for _, y in scored) + lost)))
        points.append((1.0, 0.0))
        recall = [points[0][1]] + [p[1] for p in points] + [0.0]
        assert ap == pytest.approx(sum(p[0] * (recall[i] - recall[i + 2]) / 2 for i, p in enumerate(points)))


# Scenes


def plane_scene(n=2000, seed=3):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 60, n), r.uniform(0, 60, n)
    return np.column_stack((x, y, 0.1 * x - 0.05 * y + 3))


def as_points(spark, xyz, **more):
    t = pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "tile": 0, "classification": 1, "intensity": 100, "rn": 1, "nr": 1, "line": 1, "sensor": 1} | more)
    return spark.createDataFrame(t).withColumns({c: F.col(c).cast("int") for c in ("tile", "classification", "intensity", "rn", "nr", "line", "sensor")})


def boxes(xyz, seed=4):
    """Three boxes of 10 m on the plane, and spikes 5 m up and down: (points, is ground)."""
    r = np.random.default_rng(seed)
    out, good = xyz.copy(), np.ones(len(xyz), dtype=bool)
    for cx, cy in ((15, 15), (40, 20), (25, 45)):
        on = (np.abs(out[:, 0] - cx) < 4) & (np.abs(out[:, 1] - cy) < 4)
        out[on, 2] += 10
        good[on] = False
    spikes = r.choice(np.flatnonzero(good), 6, replace=False)
    out[spikes[:3], 2] += 5
    good[spikes[:3]] = False
    return out, good, spikes[3:]


def test_smrf_rejects_boxes(spark):
    xyz, good, _ = boxes(plane_scene())
    got = ground.smrf(as_points(spark, xyz), 2.0, slope=0.8).toPandas().sort_values("pid").ground.to_numpy()
    assert not got[~good].any() and got[good].mean() > 0.93  # openings lower a slope a little
    assert ground.smrf(as_points(spark, xyz[:99]), 2.0).where("not ground").count() == 0


def test_tin_rejects_boxes_and_climbs(spark):
    xyz, good, low = boxes(plane_scene())
    got = ground.densify(as_points(spark, xyz), building=12.0).toPandas().sort_values("pid").ground.to_numpy()
    inner = good & (np.abs(xyz[:, :2] - 30) < 16).all(axis=1)  # triangles reach as far as the outermost seeds
    assert not got[~good].any() and got[inner].mean() > 0.99
    two = as_points(spark, np.vstack((xyz, xyz + [60, 0, 0])), tile=[0] * len(xyz) + [1] * len(xyz))
    alone = ground.densify(two, building=12.0).toPandas().sort_values("pid").ground.to_numpy()
    assert np.array_equal(alone[: len(xyz)], got)
    with_margin = ground.densify(two, building=12.0, halo=10.0)
    assert with_margin.count() == 2 * len(xyz) and with_margin.where("ground").count() >= alone.sum() * 0.98


def test_low_points_in_ground(spark):
    xyz = plane_scene(400)
    xyz[7, 2] -= 5
    left = ground.drop_low(as_points(spark, xyz).select("pid", "x", "y", "z"))
    assert {r.pid for r in as_points(spark, xyz).join(left, "pid", "left_anti").collect()} == {7}


def test_triangles_of_a_plane():
    xyz = plane_scene(500)
    t = tin.triangles(xyz[:, :2])
    a, b, c = (xyz[t[:, k], :2] for k in range(3))
    turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    assert (turn > 0).all()
    for s in t[:50]:  # no point within a circumcircle
        m = 2 * (xyz[s[1:], :2] - xyz[s[0], :2])
        centre = np.linalg.solve(m, (xyz[s[1:], :2] ** 2).sum(axis=1) - (xyz[s[0], :2] ** 2).sum())
        d = np.linalg.norm(xyz[:, :2] - centre, axis=1)
        assert (np.delete(d, s) >= d[s].min() * (1 - 1e-6)).all()
    q = np.random.default_rng(1).uniform(10, 50, (100, 2))
    assert np.allclose(tin.interpolate(xyz[:, :2], xyz[:, 2], q), 0.1 * q[:, 0] - 0.05 * q[:, 1] + 3)
    assert len(tin.triangles(np.zeros((2, 2)))) == 0 and np.isnan(tin.interpolate(xyz[:, :2], xyz[:, 2], np.array([[-9.0, 0.0]]))).all()


def test_terrain_raster_of_a_plane(spark):
    xyz = plane_scene(1500)
    tiles = (xyz[:, 0] >= 30).astype(int)
    got = ground.terrain_raster(as_points(spark, xyz, tile=tiles), 2.0, 32, 32).toPandas()
    assert len(got) == 1024
    inner = got[got.how == "tin"]
    assert np.allclose(inner.z, 0.1 * (inner.col + 0.5) * 2 - 0.05 * (inner.row + 0.5) * 2 + 3) and len(inner) > 700
    assert set(got.how) == {"tin", "idw", "nearest"} or set(got.how) == {"tin", "idw"}


def test_ground_model_and_headless(spark):
    xyz, good, _ = boxes(plane_scene(4000))
    p = as_points(spark, xyz)
    model = ground.ground_model(p, 2.0).toPandas()
    x0, y0 = xyz[:, 0].min(), xyz[:, 1].min()
    want = 0.1 * (x0 + (model.col + 0.5) * 2) - 0.05 * (y0 + (model.row + 0.5) * 2) + 3
    assert np.abs(model.z - want).median() < 0.6 and np.abs(model.z - want).max() < 6
    o = {"floor_buffer": 1.0, "dbscan_base_alt": 4.0, "dbscan_eps": 1.5, "dbscan_min_points": 3, "dbscan_linearity": 0.8}
    left = {r.pid for r in pipeline.headless(p, {"floor", "dbscan"}, o).select("pid").collect()}
    assert len(left & set(np.flatnonzero(~good).tolist())) < 20 and len(left) > 3000


def test_shape_features(spark):
    r = np.random.default_rng(5)
    flat = np.column_stack((r.uniform(0, 10, (300, 2)), np.zeros(300)))
    line = np.column_stack((np.linspace(100, 130, 100), np.zeros((100, 2))))
    bush = r.normal(0, 1, (300, 3)) + [200, 0, 0]
    p = as_points(spark, np.vstack((flat, line, bush)))
    e = ground.eigenvalues(p, 12).toPandas().sort_values("pid")
    xyz = np.vstack((flat, line, bush))
    for i in (0, 350, 500):
        near = np.argsort(np.linalg.norm(xyz - xyz[i], axis=1), kind="stable")[:12]
        want = np.linalg.eigvalsh(np.cov(xyz[near].T))[::-1]
        assert np.allclose(e.iloc[i][["e0", "e1", "e2"]].astype(float), np.maximum(want, 0), atol=1e-9)
    marks = clean.discriminate(p, 12).toPandas().sort_values("pid")
    assert marks.terrain[:300].mean() > 0.9 and marks.terrain[400:].mean() < 0.6
    shapes = p.withColumn("cluster", F.when(F.col("pid") < 300, 0).when(F.col("pid") < 400, 1).otherwise(2))
    lin = {r.cluster: r.linearity for r in ground.linearity(shapes).collect()}
    assert lin[1] == pytest.approx(1.0) and lin[0] < 0.5
    prob = ground.ground_probability(p, 12, 5.0).toPandas().sort_values("pid")
    assert prob.probability[:300].mean() > prob.probability[400:].mean()


def river(seed=6):
    """Banks, a sheet of water 40 m wide and a bed 2 m below it."""
    r = np.random.default_rng(seed)
    bank = np.column_stack((r.uniform(0, 80, 1500), np.concatenate((r.uniform(0, 20, 750), r.uniform(60, 80, 750))), r.normal(5, 0.01, 1500)))
    sheet = np.column_stack((r.uniform(0, 80, 3000), r.uniform(20, 60, 3000), r.normal(0, 0.05, 3000)))
    bed = np.column_stack((r.uniform(0, 80, 1500), r.uniform(20, 60, 1500), r.normal(-2, 0.2, 1500)))
    return bank, sheet, bed


def test_water_filters(spark):
    bank, sheet, bed = river()
    wet = as_points(spark, np.vstack((sheet, bed)), sensor=2)
    keep = clean.water_ghosts(wet, 40.0, 0.3).toPandas().sort_values("pid").keep.to_numpy()
    assert keep[3000:].mean() > 0.95 and keep[:3000].mean() < 0.4  # the bed stays, the surface goes
    other = clean.water_ghosts(wet, 40.0, 0.3, compat=True).toPandas().sort_values("pid").keep.to_numpy()
    assert other[3000:].mean() < 0.05
    everything = as_points(spark, np.vstack((bank, bank, bank, sheet)), intensity=[1000] * 4500 + [100] * 3000)
    in_river = clean.river_corridor(everything, 4.0, least=3).toPandas().sort_values("pid").river.to_numpy()
    assert in_river[4500:].mean() > 0.75 and in_river[:4500].mean() < 0.15
    plane = bathy.water_plane(as_points(spark, sheet), 0.5, 0.3).first()
    assert abs(plane.a) < 0.01 and abs(plane.b) < 0.01 and abs(plane.c) < 0.3 and plane.n == 1500
    assert tuple(bathy.water_plane(as_points(spark, sheet[:40])).first()) == (0.0, 0.0, 0.0, 0.0, 0)
    steps = np.column_stack((np.arange(120) * 0.2, np.zeros(120), np.where(np.arange(120) < 60, 0.0, 3.0)))
    bed_ = clean.bed_continuity(as_points(spark, steps).withColumn("certain", F.col("pid") == 0)).where("bed").count()
    assert bed_ == 60  # the cliff stops it


def test_multipath(spark):
    r = np.random.default_rng(9)
    real = np.column_stack((r.uniform(0, 50, (900, 2)), r.normal(0, 0.02, 900)))
    ghost = np.column_stack((r.uniform(0, 50, (100, 2)), r.normal(-3, 0.02, 100)))
    keep = clean.multipath(as_points(spark, np.vstack((real, ghost))), 0.5).toPandas().sort_values("pid").keep.to_numpy()
    assert keep[:900].all() and not keep[900:].any()


def test_grid_helpers():
    m = np.zeros((8, 9), dtype=bool)
    m[2:6, 2:7], m[3:5, 4], m[0, 8] = True, False, True
    assert grids.fill_enclosed(m).sum() == 21 and grids.largest(m).sum() == 18 and not grids.largest(np.zeros((2, 2), dtype=bool)).any()
    g = np.array([[1.0, np.nan], [3.0, np.nan]])
    assert np.allclose(grids.fill(g), [[1, 1], [3, 3]])
    r = np.random.default_rng(1).uniform(0, 9, (7, 6))
    wide = np.pad(r, 2, mode="symmetric")
    assert np.allclose(grids.sliding(r, 5, "min"), [[wide[i : i + 5, j : j + 5].min() for j in range(6)] for i in range(7)])


def test_pipeline_checks_and_presets(spark, tmp_path):
    p = as_points(spark, plane_scene(300))
    for bad in ({"type": "sor"}, [{"kind": "sor"}], [{"type": "nonsense"}]):
        with pytest.raises(ValueError):
            pipeline.run(p, bad)
    with pytest.raises(ValueError):
        pipeline.run(p, [{"type": "benthic_continuity"}])
    steps = [{"type": "ror", "radius": 8, "min_points": 4}, {"type": "dbscan_above", "eps": 6, "min_samples": 3, "min_cluster_size": 5}]
    pipeline.save_preset(str(tmp_path / "a.json"), steps)
    assert pipeline.load_preset(str(tmp_path / "a.json")) == steps
    timings = []
    left = pipeline.run(p, steps, timings)
    assert [t[0] for t in timings] == ["ror", "dbscan_above"] and timings[-1][2] == left.count()
    mask = pipeline.keep_mask(p, steps)
    clean_, gone = pipeline.split(p, steps)
    assert mask.where("keep").count() == clean_.count() and clean_.count() + gone.count() == 300
    moved = pipeline.run(p, [{"type": "bilateral", "knn": 6, "spatial_sigma": 3.0, "range_sigma": 3.0}])
    assert moved.count() == 300
    assert pipeline.run(p, [{"type": "surface_cleanup", "grid_size": 5.0, "reference_class": 1}]).count() == 300


def test_registration(spark):
    r = random.Random(4)
    c, s = math.cos(0.3), math.sin(0.3)
    pairs = []
    for i in range(12):
        x, y, z = (r.uniform(-10, 10) for _ in range(3))
        pairs.append((i, x, y, z, 2 * (c * x - s * y) + 5, 2 * (s * x + c * y) - 3, 2 * z + 1))
    df = spark.createDataFrame(pairs, "pid long, sx double, sy double, sz double, tx double, ty double, tz double")
    left = register.residuals(df, register.apply_helmert(df, register.estimate_helmert(df)))
    assert register.residual_stats(left).first().most < 1e-9
    assert np.allclose(register.estimate_affine(df), [[2 * c, -2 * s, 0, 5], [2 * s, 2 * c, 0, -3], [0, 0, 2, 1]])
    hills = plane_scene(600)
    hills[:, 2] = np.sin(hills[:, 0] / 6) * 4 + np.cos(hills[:, 1] / 5) * 4
    target = as_points(spark, hills).select("pid", "x", "y", "z")
    m, rms = register.icp(register.shift(target, 0.4, -0.3, 0.2), target, rounds=12, reach=5.0)
    assert np.allclose(m[:3, 3], [-0.4, 0.3, -0.2], atol=0.05) and rms < 0.05
    geo = spark.createDataFrame([(0, 13.4, 52.5), (1, 15.0, 0.0)], "pid long, x double, y double")
    there = register.transform(geo, 4326, 32633)
    assert abs(there.where("pid = 1").first().x - 500000) < 1e-6
    back = register.transform(there, 32633, 4326).orderBy("pid").collect()
    assert abs(back[0].x - 13.4) < 1e-8 and abs(back[0].y - 52.5) < 1e-8
    assert register.transform_or_keep(geo, 4326, 9999)[1]
    corners = spark.createDataFrame([("r", 0.0, 0.0, 6.0), ("r", 4.0, 0.0, 6.0), ("r", 4.0, 4.0, 6.0), ("q", 0.0, 0.0, 1.0)], "surface string, x double, y double, z double")
    roof = as_points(spark, np.column_stack((np.random.default_rng(1).uniform(-1, 6, (200, 2)), np.full(200, 5.5))))
    got = {x.surface: x.dz for x in register.roof_shifts(corners, roof, 5.0).collect()}
    assert got == {"r": pytest.approx(-0.5)}


def test_transfer_and_sampling(spark):
    r = np.random.default_rng(3)
    a = as_points(spark, np.vstack((r.normal(0, 1, (50, 3)), r.normal(9, 1, (50, 3))))).withColumn("label", (F.col("pid") >= 50).cast("int"))
    assert a.join(inference.transfer(a.drop("label"), a.where("pid % 3 = 0"), 3).withColumnRenamed("label", "got"), "pid").where("label <> got").isEmpty()
    for mode in ("voxel", "random", "fps"):
        assert 0 < inference.normalize_density(a, mode, 2.0, samples=10).count() < 100
    with pytest.raises(ValueError):
        inference.normalize_density(a, "nothing")
    rows = spark.range(10)
    got = inference.sampled_by_weight({"main": (rows, 2), "small": (rows.where("id < 3"), 1)}, "main").orderBy("place").collect()
    assert [(x.dataset, x.id) for x in got[:6]] == [("main", 0), ("main", 1), ("small", 0), ("main", 2), ("main", 3), ("small", 1)] and len(got) == 15
    capped = inference.capped(rows.withColumn("source", F.when(F.col("id") < 7, "a").otherwise("b")), {"a": 2})
    assert {x.source: x["count"] for x in capped.groupBy("source").count().collect()} == {"a": 2, "b": 3}


def test_tile_grids():
    g = tiling.TileGrid(0.0, 0.0, 100.0, 50.0, 30.0, 30.0)
    assert (g.stride, g.columns, g.rows) == (30.0, 4, 2)
    assert tiling.auto_tile_size(100, 0.0) == 500.0 and tiling.auto_tile_size(1_000_000, 1e6, 15625) == 100.0  # 2.5 steps of 50 go to the even 2
    whole = tiling.RasterGrid.over(-3.5, 2.0, 11.0, 2.0, 2.0)
    assert (whole.x0, whole.y0, whole.columns, whole.rows) == (-4.0, 2.0, 8, 1)
    part, r0, c0 = whole.slice(1.0, 2.0, 1.1, 2.1)
    assert (part.columns, part.rows, r0, c0, part.x0) == (1, 1, 0, 2, 0.0)


def test_streams(spark, tmp_path):
    from cloudloom.streaming import strips

    xyz = plane_scene(200)
    p = as_points(spark, xyz).select("pid", "x", "y", "z")
    for i in (0, 1):
        p.where(F.col("pid") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    grid = tiling.TileGrid(0.0, 0.0, 60.0, 60.0, 20.0)
    for _ in range(2):  # the second run finds nothing new
        strips.append_tiles(strips.arriving(spark, str(tmp_path / "in"), p.schema, 1), grid, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 200 and got.select("batch").distinct().count() == 2
    events = spark.createDataFrame([("filter", 1.0, f"2024-01-01 00:0{m}:00") for m in (1, 3, 9)], "step string, duration double, moment string").withColumn("moment", F.col("moment").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    for name, out in (("times", strips.step_times(stream)), ("once", strips.without_repeats(stream, ["step", "duration"]))):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 1 and spark.table("times").columns == ["start", "end", "step", "n", "mean"]
    kept = selection.latest(events, 1, ("moment",))
    assert kept.count() == 1


def test_bilinear_sums_in_one_order(spark):
    from cloudloom.operators import surface

    rng = np.random.default_rng(5)
    z = rng.random((6, 7))
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(6) for c in range(7)], "row long, col long, z double").repartition(7)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((2000, 2)) * [6.9, 5.9])]
    pts = spark.createDataFrame(rows, "pid long, x double, y double").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.pid: r.surface for r in surface.bilinear(pts, cells, 1.0, 6, 7).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 2000
    for i, x, y in rows:
        c, r = int(x), int(y)
        u, v, c1, r1 = x - c, y - r, min(c + 1, 6), min(r + 1, 5)
        assert got[i] == (1 - v) * (1 - u) * z[r, c] + (1 - v) * u * z[r, c1] + v * (1 - u) * z[r1, c] + v * u * z[r1, c1]
