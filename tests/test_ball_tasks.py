"""What boxes of space find in their tasks against all pairs; no pair of points leaves a task."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from cloudloom import balls, cells
from cloudloom.functions.codes import xxhash64
from cloudloom.operators import clean, kernels, noise, register


def scattered(n, wide, seed):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, wide), r.uniform(0, wide), r.uniform(0, wide)) for i in range(n)]
    return rows + [(n + i, *rows[i % 7][1:]) for i in range(40)]  # heaps in seven places


def near(a, b, radius):
    return sum((p - q) * (p - q) for p, q in zip(a[1:4], b[1:4])) <= radius * radius


def joined(rows, edge):
    label = {a[0]: a[0] for a in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if label[b[0]] < label[a[0]] and edge(a, b):
                    label[a[0]], changed = label[b[0]], True
    return label


@pytest.fixture
def no_pairs(monkeypatch):
    def refuse(*args, **more):
        raise AssertionError("pairs of points are joined")

    for module in (cells, kernels, register):
        monkeypatch.setattr(module, "radius_join", refuse)


def test_hash_is_sparks(spark):
    ids = [0, 1, -5, 2**40, 2**62]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(ids)], "i long, b long").select(F.xxhash64(F.lit(5), F.lit(77).cast("long"), "b").alias("h")).collect()
    assert [r.h for r in df] == xxhash64(5, 77, ids).tolist()


@pytest.mark.parametrize("seed", [None, 3])
def test_ball_query_is_all_pairs(spark, no_pairs, seed):
    rows = [(*p, p[0] % 2) for p in scattered(300, 20.0, 1)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, batch int")
    got = {}
    for r in kernels.ball_query(df, df.where("pid % 3 = 0"), 3, 6.0, 2.0, seed=seed).collect():
        got.setdefault(r.pid, {})[r.rank] = r.neighbour
    for q in rows:
        if q[0] % 3:
            continue
        d2 = {p[0]: sum((a - b) * (a - b) for a, b in zip(q[1:4], p[1:4])) for p in rows if p[4] == q[4]}
        found = sorted(p for p, d in d2.items() if d <= 1e-5 or 4.0 <= d < 36.0)
        order = dict(zip(found, xxhash64(seed, q[0], found).tolist())) if seed is not None and found else d2
        found.sort(key=lambda p: (order[p], p))
        if len(found) > 3:
            found = [found[int(len(found) / 3.0 * i)] for i in range(3)]
        assert got.get(q[0], {}) == {i + 1: p for i, p in enumerate(found)}


@pytest.mark.parametrize("aim", [1, 50, 1 << 14])
def test_links_are_those_of_all_pairs(spark, no_pairs, aim):
    rows = scattered(250, 25.0, 2)
    df = spark.createDataFrame(rows, "spot long, x double, y double, z double")
    got = {r.spot: r.label for r in balls.linked_spots(df, 3.0, ("x", "y", "z"), aim=aim).collect()}
    assert got == joined(rows, lambda a, b: near(a, b, 3.0))


def test_ball_clusters_and_bed_without_pairs(spark, no_pairs):
    rows = scattered(250, 25.0, 3)
    df = spark.createDataFrame([(*p, 0, p[0] % 2) for p in rows], "pid long, x double, y double, z double, batch int, label int")
    label = joined(rows, lambda a, b: a[0] % 2 == b[0] % 2 and near(a, b, 4.0))
    size = {v: list(label.values()).count(v) for v in label.values()}
    got = {r.pid: (r.cluster, r["size"]) for r in kernels.ball_clusters(df, 4.0, 3).collect()}
    assert got == {p: (v, size[v]) for p, v in label.items() if size[v] >= 3}

    def gentle(a, b):
        flat = ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
        return near(a, b, 4.0) and flat > 0 and abs(a[3] - b[3]) / flat <= 0.5

    label = joined(rows, gentle)
    good = {label[p] for p in label if p < 4}
    bed = {r.pid: r.bed for r in clean.bed_continuity(df.withColumn("certain", F.col("pid") < 4), reach=4.0, slope=0.5).collect()}
    assert bed == {p: v in good for p, v in label.items()}


def test_heaps_cost_no_pairs(spark, no_pairs):
    """60,000 points in 100 places: clusters and counts look at places. Those at either end are no cores."""
    df = spark.range(60_000).select(F.col("id").alias("pid"), (F.col("id") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert noise.dbscan(df, 1.0, 1300).where("label = 1").count() == 60_000
    assert noise.radius_outliers(df, 1.0, 1).agg(F.min("n"), F.max("n")).first() == (1200, 1800)


def test_control_points_without_pairs(spark, no_pairs):
    """Names in one place share its points; a name twice in a place counts them twice."""
    pts = [(i % 10 / 2, i % 7 / 2, float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    marks = [("a", 2.0, 2.0, 5.0), ("b", 2.0, 2.0, 6.0), ("c", 1.0, 1.0, 5.0), ("c", 1.0, 1.0, 5.0)]
    got = {r.name: r for r in register.gcp_dz(spark.createDataFrame(marks, "name string, x double, y double, z double"), df, 1.2).collect()}
    for name, x, y, z in marks:
        own = sorted(p[2] for p in pts if (p[0] - x) ** 2 + (p[1] - y) ** 2 <= 1.44)
        own = sorted(own * (2 if name == "c" else 1))
        mid = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        mean = sum(own) / len(own)
        assert (got[name].n, got[name].mid, got[name].dz) == (len(own), mid, z - mid)
        assert got[name]["std"] == pytest.approx((sum((v - mean) ** 2 for v in own) / len(own)) ** 0.5)


def test_a_name_in_two_places(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 1.0), (9.0, 0.0, 4.0)], "x double, y double, z double")
    row = register.gcp_dz(spark.createDataFrame([("a", 0.0, 0.0, 5.0), ("a", 9.0, 0.0, 5.0)], "name string, x double, y double, z double"), df, 1.0).first()
    assert (row.n, row.mid) == (3, 1.0) and row["std"] == pytest.approx(2**0.5)


def test_many_points_at_a_roof(spark, no_pairs):
    """A plane of 30,000 points: a square matrix of them would be 7 GB."""
    df = spark.range(30_000).select((F.col("id") % 100 / 100).alias("x"), (F.col("id") / 30_000).alias("y"), (F.col("id") % 100 / 100 + 2).alias("z"))
    corners = [(s, x, y, x + 3.0) for s in "ab" for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    got = register.roof_shifts(spark.createDataFrame(corners, "surface string, x double, y double, z double"), df, 5.0).collect()
    assert [(r.surface, r.n) for r in sorted(got)] == [("a", 30_000), ("b", 30_000)]
    assert all(r.offset == pytest.approx(0.5**0.5 , abs=0.01) for r in got)


def test_roughness_of_a_crowd():
    """3,000 points in 50 places within reach of each other: shares of variance as numpy has them, without a table of all pairs."""
    import numpy as np

    spots = np.random.default_rng(4).uniform(0, 1, (50, 3)) * [1.0, 1.0, 0.1]
    p = np.repeat(spots, 60, axis=0)
    e = np.linalg.eigvalsh(np.cov(p.T))
    tracemalloc.start()
    got = clean._roughness(p, 5.0)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # differences of all pairs of points are 216 MB
    tracemalloc.stop()
    assert np.allclose(got, e[0] / e.sum())
    assert (clean._roughness(np.ones((9, 3)), 1.0) == 1).all()


def test_farthest_points_of_heaps(spark):
    """Points in one place count by their smallest key; once all places are taken the smallest key of all comes again, as for a plain loop."""
    df = spark.range(90).select((F.col("id") + 3).alias("pid"), F.lit(1).alias("batch"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = kernels.farthest_points(df, 5).orderBy("rank").collect()
    assert [r.pid for r in got] == [3, 5, 4, 3, 3]


def test_crowded_cells_are_not_searched(spark, monkeypatch):
    """Only points of cells with fewer than ``least`` are counted, and crowded cells are linked by their outermost points."""
    from cloudloom.operators import noise as own

    looked = []
    count, link = own.aggregate_spots, own.linked_spots
    monkeypatch.setattr(own, "aggregate_spots", lambda probe, *a, **k: looked.append(probe.count()) or count(probe, *a, **k))
    monkeypatch.setattr(own, "linked_spots", lambda spots, *a, **k: looked.append(spots.count()) or link(spots, *a, **k))
    rows = scattered(3000, 8.0, 5) + [(5000, 40.0, 0.0, 0.0), (5001, 40.5, 0.0, 0.0)]
    got = {r.pid: r.label for r in own.dbscan(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 4.0, 3).collect()}
    assert got == {p: 0 if p < 5000 else None for p, *_ in rows}
    assert max(looked) < 1500


def test_cells_linked_by_inner_points(spark):
    """The outermost points of two crowded cells are too far apart, inner ones are not; a third cell stays apart."""
    a = [(0.8, 0.8, 0.8), (0.95, 0.1, 0.1), (0.1, 0.95, 0.1), (0.1, 0.1, 0.95), (0.05, 0.05, 0.05)]
    b = [(1.7, 1.7, 1.7), (1.6, 1.9, 1.9), (1.9, 1.6, 1.9), (1.9, 1.9, 1.6), (1.95, 1.95, 1.95)]
    c = [(3.9 + 0.01 * i, 0.5, 0.5) for i in range(5)]
    rows = [(i, *p) for i, p in enumerate(a + b + c)] + [(90, float("nan"), 0.0, 0.0), (91, None, 0.0, 0.0)]
    got = {r.pid: r.label for r in noise.dbscan(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 3**0.5, 4).collect()}
    assert got == {i: 0 for i in range(10)} | {i: 10 for i in range(10, 15)} | {90: None, 91: None}


def test_far_places_are_cells(spark):
    """So far out that a cell's number would not be exact."""
    rows = [(i, 1e12 + i * 0.5, 0.0, 0.0) for i in range(5)] + [(9, -1e12, 0.0, 0.0)]
    got = {r.pid: r.label for r in noise.dbscan(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 0.75, 2).collect()}
    assert got == {i: 0 for i in range(5)} | {9: None}


def test_icp_aligns_all_points(spark, monkeypatch):
    """The query keeps no point back and does not stop before the alignment has settled."""
    import numpy as np

    from cloudloom.plans import terrain

    rows = [(i, float(i % 7), float(i % 5), float(20 * i)) for i in range(20)]
    seen = []
    monkeypatch.setattr(terrain, "points", lambda spark, d: spark.createDataFrame(rows, "pid long, x double, y double, z double"))
    monkeypatch.setattr(register, "icp", lambda source, target, **more: seen.append((source.count(), target.count(), more.get("rounds", 30))) or (np.eye(4), 0.0))
    assert terrain.icp(spark, "").count() == 16
    assert seen == [(20, 20, 30)]


def test_points_of_crowded_cells_are_not_counted(spark, monkeypatch):
    """The same points stay as by counts; only those in cells with too few are counted. Odd places stay nowhere."""
    counted, count = [], noise.aggregate_spots
    monkeypatch.setattr(noise, "aggregate_spots", lambda probe, *a, **k: counted.append(probe.count()) or count(probe, *a, **k))
    rows = scattered(3000, 8.0, 6) + [(5000, 40.0, 0.0, 0.0), (5001, 40.5, 0.0, 0.0), (5002, 43.0, 0.0, 0.0), (5003, -40.0, 0.0, 0.0), (5004, float("nan"), 0.0, 0.0), (5005, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    got = {r.pid: r.keep for r in noise.enough_near(df, 3.0, 3).collect()}
    assert got == {r.pid: r.keep for r in noise.radius_outliers(df, 3.0, 3).collect()} and not got[5003] and got[5000]
    assert counted[0] < 300
    far = spark.createDataFrame([(i, 1e12 + i * 0.5, 0.0, 0.0) for i in range(5)], "pid long, x double, y double, z double")
    assert noise.enough_near(far, 0.75, 3).where("keep").count() == 3


@pytest.mark.parametrize("exclude", [True, False])
def test_columns_are_one_place_to_low_points(spark, monkeypatch, exclude):
    """Many heights over few places: the rule is that of all pairs, and only places meet."""
    met, meet = [], noise.aggregate_spots
    monkeypatch.setattr(noise, "aggregate_spots", lambda probe, *a, **k: met.append(probe.count()) or meet(probe, *a, **k))
    r = random.Random(8)
    rows = [(i, float(i % 6), float(i % 5 * 2), float(r.randrange(40)) - 90 * (i % 97 == 0) + 99 * (i % 89 == 0)) for i in range(400)] + [(900, 50.0, 0.0, 3.0), (901, 50.0, 0.0, 9.0), (902, 80.0, 0.0, 1.0), (903, 50.0, 0.0, None)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    got = {p.pid: p.keep for p in noise.low_points(df, 1.5, 2.0, 3.0, exclude).collect()}
    for p in rows:
        others = [q[3] for q in rows if q[3] is not None and (not exclude or q[0] != p[0]) and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 2.25]
        odd = p[3] is not None and others and (p[3] < min(others) - 2 or p[3] > max(others) + 3)
        assert got[p[0]] == (not odd), p
    assert met == [32]
    assert exclude == (not all(got.values()))


def test_a_crowd_is_joined_by_few_pairs():
    """6,000 points in a ball of each other, of which half of all pairs are steps, and two that none leads to."""
    import numpy as np

    def gentle(p, i, j):
        off = np.abs(p[i] - p[j])
        return (off[:, :2].sum(axis=1) > 0) & (off[:, 2] <= 0.6 * np.sqrt(off[:, 0] ** 2 + off[:, 1] ** 2))

    p = np.vstack((np.random.default_rng(3).uniform(0, 1, (6000, 3)), [[0.5, 0.5, 2.5], [4.0, 0.5, 0.5]]))
    sets = balls.Unions(len(p))
    assert balls.join_steps(sets, p, np.arange(len(p)), 3.0, gentle) < len(p) ** 2 / 4
    assert (sets.settle()[:6000] == 0).all() and sets.parent[6000:].tolist() == [6000, 6001]
