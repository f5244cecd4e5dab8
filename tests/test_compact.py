"""What leaves tasks and stays in the shared folder is a row a point, not one a pair or a stage."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cloudloom import cells
from cloudloom.operators import basic, ground, inference, noise, pipeline, register


def heaped(n, seed):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, 50), r.uniform(0, 50), r.uniform(0, 5), i % 3) for i in range(n)]
    return rows + [(n + i, *rows[i % 5][1:4], i % 2) for i in range(60)]


def test_reduced_neighbours(spark):
    rows = heaped(300, 3)
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, label int").repartition(5)

    def listed(own, i, near, j, d2):
        ends = np.cumsum(np.bincount(i, minlength=own.num_rows))
        ids = near["n_pid"].to_numpy()[j]
        return pa.table({"pid": own["pid"], "ids": pa.array([ids[e - 6 : e].tolist() for e in ends], pa.list_(pa.int64()))})

    got = {r.pid: r.ids for r in cells.knn_join(df, df, 6, dims=("x", "y", "z"), aim=16, reduce_to=(listed, "pid long, ids array<bigint>")).collect()}
    assert len(got) == len(rows)
    for a in rows:
        order = sorted((sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])), b[0]) for b in rows if b[0] != a[0])
        assert got[a[0]] == [b for _, b in order[:6]]


@pytest.mark.parametrize("what", ["smooth", "probability", "normals", "statistics"])
def test_no_pair_leaves_a_task(spark, monkeypatch, what):
    seen, real = [], cells.knn_join

    def watched(probe, build, *args, **options):
        seen.append(options.get("reduce_to"))
        return real(probe, build, *args, **options)

    for module in (inference, ground, noise):
        monkeypatch.setattr(module, "knn_join", watched)
    monkeypatch.setattr(cells, "knn_join", watched)
    rows = [(*r, 2, 100, 1) for r in heaped(60, 4)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, label int, classification int, intensity int, rn int")
    out = {"smooth": lambda: inference.smooth(df, 5), "probability": lambda: ground.ground_probability(df, 6, 10.0), "normals": lambda: register._normals(df, 6), "statistics": lambda: noise.statistical_outliers(df, 5, 2.0)}[what]()
    assert out.count() == 120
    assert len(seen) == 1 and seen[0]


def test_pipeline_leaves_one_stage(spark):
    df = spark.createDataFrame([r[:4] for r in heaped(100, 5)], "pid long, x double, y double, z double")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/cloudloom/*"))
    left = pipeline.run(df, [{"type": "ror", "radius": 5.0, "min_points": 2}, {"type": "isolated", "search_radius": 5.0, "min_neighbors": 2}, {"type": "thin_average", "grid_size": 5.0}])
    assert left.count() > 0
    assert len(set(glob.glob(f"{folder}/cloudloom/*")) - before) == 1
    assert all(os.path.isdir(p) for p in glob.glob(f"{folder}/cloudloom/*"))


def test_quartiles_hold_no_group(spark):
    rows = [("ab"[i % 2], i % 3 or None, float(i * 7 % 50)) for i in range(101)]
    out = basic.processing_stats(spark.createDataFrame(rows, "step string, batch int, duration double"))
    got = {(r.level, r.step, r.batch): r for r in out.collect()}
    for (level, s, b), r in got.items():
        own = [v for step, batch, v in rows if s in (None, step) and b in (None, str(batch) if batch else "(no batch)")]
        assert r.n == len(own)
        assert [r.p25, r.median, r.p75] == [round(float(v), 4) for v in np.percentile(own, [25, 50, 75])]
    assert len(got) == 6
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
