"""Files written by the tests and read back."""

import json
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.sources import las, project, rasters, scenes, tables


def points(n, seed=0):
    r = np.random.default_rng(seed)
    return {
        "x": np.round(r.uniform(-500, 500, n), 3), "y": np.round(r.uniform(0, 900, n), 3), "z": np.round(r.uniform(-5, 5, n), 3), "intensity": r.integers(0, 60000, n), "classification": r.integers(0, 19, n),
        "return_number": r.integers(1, 4, n), "number_of_returns": r.integers(1, 6, n), "point_source_id": r.integers(0, 9, n), "gps_time": np.round(r.uniform(0, 1e6, n), 6), "user_data": r.integers(0, 250, n),
        "scan_direction_flag": r.integers(0, 2, n), "edge_of_flight_line": r.integers(0, 2, n), "synthetic": r.integers(0, 2, n), "key_point": r.integers(0, 2, n), "withheld": r.integers(0, 2, n), "scan_angle": np.round(r.integers(-15, 15, n) * 1.0),
        "red": r.integers(0, 65000, n), "green": r.integers(0, 65000, n), "blue": r.integers(0, 65000, n),
    }


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 6, 7])
def test_las_round_trip(spark, tmp_path, kind):
    own = points(250, kind)
    own["depth"] = np.linspace(0, 9, 250).astype(np.float32)
    las.write_file(str(tmp_path / "a.las"), pa.table(own), {"point_format": kind, "wkt": "PROJCS[\"x\"]", "system_id": "scanner"})
    got = las.read_las(spark, str(tmp_path), chunk=100).orderBy("point_idx").toPandas()
    assert len(got) == 250 and got.point_idx.tolist() == list(range(250))
    for c in ("x", "y", "z", "intensity", "return_number", "number_of_returns", "point_source_id", "user_data", "scan_direction_flag", "edge_of_flight_line", "synthetic", "key_point", "withheld"):
        assert np.allclose(got[c], own[c]), c
    assert np.allclose(got["classification"], own["classification"])
    assert np.allclose(got["scan_angle"], own["scan_angle"], atol=0.004) and np.allclose(got["depth"], own["depth"])
    assert np.allclose(got["gps_time"], own["gps_time"] if kind in (1, 3, 6, 7) else 0)
    assert np.allclose(got["red"], own["red"] if kind in (2, 3, 7) else 0)
    h = las.read_headers(spark, str(tmp_path)).first()
    assert (h.n_points, h.point_format, h.system_id, h.wkt, h.extra) == (250, kind, "scanner", 'PROJCS["x"]', ["depth"])
    assert abs(h.min_x - own["x"].min()) < 1e-9 and las.crs_by_file(spark, str(tmp_path)) == {"a.las": 'PROJCS["x"]'}


def test_las_bytes_by_hand(tmp_path):
    """A file put together from the format's description, not by our writer."""
    raw = bytearray(227)
    raw[:4], raw[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HII", raw, 94, 227, 227, 0)
    struct.pack_into("<BHI", raw, 104, 0, 20, 2)
    struct.pack_into("<6d", raw, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    struct.pack_into("<6d", raw, 179, 101, 100, 202, 200, 3, 1)
    raw += struct.pack("<iiiHBBbBH", 100, 200, 300, 7, 0b10_010_001, 2 | 32, -5, 9, 11) + struct.pack("<iiiHBBbBH", 0, 0, 100, 8, 0b01_001_001, 5, 5, 0, 12)
    (tmp_path / "b.las").write_bytes(bytes(raw))
    h = las.read_header(str(tmp_path / "b.las"))
    p = las.decode(np.frombuffer(bytes(raw[227:]), h.dtype()), h)
    assert p["x"].tolist() == [101.0, 100.0] and p["z"].tolist() == [3.0, 1.0] and p["classification"].tolist() == [2, 5]
    assert p["return_number"].tolist() == [1, 1] and p["number_of_returns"].tolist() == [2, 1] and p["edge_of_flight_line"].tolist() == [1, 0] and p["scan_direction_flag"].tolist() == [0, 1]
    assert p["synthetic"].tolist() == [1, 0] and p["scan_angle_rank"].tolist() == [-5, 5]


def test_bad_and_empty_files(spark, tmp_path):
    (tmp_path / "bad.las").write_bytes(b"nothing")
    las.write_file(str(tmp_path / "ok.las"), pa.table({"x": [1.0], "y": [2.0], "z": [3.0]}))
    las.write_file(str(tmp_path / "none.las"), pa.table({c: pa.array([], pa.float64()) for c in "xyz"}))
    with pytest.warns(UserWarning):
        assert las.headers(str(tmp_path))[1] == [str(tmp_path / "bad.las")]
    assert las.read_las(spark, str(tmp_path)).count() == 1
    assert las.read_las(spark, str(tmp_path), bbox="10,10,20,20").count() == 0


def test_tiles_and_import(spark, tmp_path):
    for i in (1, 2):
        las.write_file(str(tmp_path / f"in/strip{i}.las"), pa.table(points(400, i)))
    own = las.import_folder(spark, str(tmp_path / "in"), size=300.0)
    las.write_tiles(own.drop("file", "point_idx"), str(tmp_path / "out"))
    back = las.read_las(spark, str(tmp_path / "out"))
    assert back.count() == 800 and len(os.listdir(tmp_path / "out")) == own.select("tile").distinct().count()
    sums = lambda d: d.agg(F.round(F.sum("x"), 2), F.sum("intensity")).first()
    assert tuple(sums(own)) == tuple(sums(back))
    with pytest.raises(Exception, match="files already"):
        las.write_tiles(own, str(tmp_path / "out"))
    las.write_split(own.drop("file", "point_idx").withColumn("keep", F.col("z") > 0), str(tmp_path / "split"))
    n = own.where("z > 0").count()
    assert las.read_las(spark, str(tmp_path / "split")).count() == n and las.read_las(spark, str(tmp_path / "split/noise")).count() == 800 - n
    assert las.template(str(tmp_path / "in"))["point_format"] == 7


def test_rasters(spark, tmp_path):
    v = np.arange(12.0).reshape(3, 4)
    v[1, 2] = np.nan
    for kind in ("f4", "f8"):
        g = rasters.parse_geotiff(rasters.geotiff(v, 100.0, 200.0, 0.5, kind, 32633))
        assert np.array_equal(g["values"], v, equal_nan=True) and (g["x0"], g["y0"], g["size"], g["epsg"]) == (100.0, 200.0, 0.5, 32633)
    text = rasters.ascii_grid(v, 100.0, 200.0, 0.5)
    assert text.splitlines()[6].split()[0] == "8.000"  # the northern row comes first
    assert np.array_equal(rasters.parse_ascii_grid(text)[0], v, equal_nan=True)
    cells = rasters.cells_of(spark, v)
    made = rasters.write_rasters(cells, str(tmp_path / "r"), 0.5, tile_cells=2, form="tif").collect()
    assert len(made) == 4
    back, geo = rasters.read_geotiff(spark, str(tmp_path / "r/raster_0_0.tif"))
    assert geo["x0"] == 0 and {(r.row, r.col): r.z for r in back.collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 4, (1, 1): 5}
    with pytest.raises(ValueError):
        rasters.check_config(0)
    with pytest.raises(ValueError):
        rasters.parse_geotiff(b"no")


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# run 1\n3;1.5;2;9\n\n1;0;0;8\nbad;1;2;3\n2;1;1\n")
    (tmp_path / "t2.txt").write_text("time x y z\n2 1 1 1\n1 0 0 0\n")
    assert [tuple(r) for r in tables.read_trajectory(spark, str(tmp_path / "t.txt"), separator=";").collect()] == [(1, 0, 0, 8), (3, 1.5, 2, 9)]
    assert [r.t for r in tables.read_trajectory(spark, str(tmp_path / "t2.txt"), has_header=True).collect()] == [1, 2]
    (tmp_path / "g.csv").write_text('﻿Point,"Easting",Northing,Elev\n"A, 1",10,20,3\nB,x,2,3\nC,1,2,3\n')
    got = sorted(tuple(r) for r in tables.read_control_points(spark, str(tmp_path / "g.csv")).collect())
    assert got == [("A, 1", 10, 20, 3), ("C", 1, 2, 3)]
    (tmp_path / "h.csv").write_text("1.5,2,3\n4,5,6\n")
    assert sorted(tuple(r) for r in tables.read_control_points(spark, str(tmp_path / "h.csv")).collect()) == [("1", 1.5, 2, 3), ("2", 4, 5, 6)]
    (tmp_path / "r.txt").write_text("id x y z\nr1 0 0 5\nr1 1 0 5\nr1 1 1 5\nr2 0 0 1\n")
    assert {r.surface for r in tables.read_roofs(spark, str(tmp_path / "r.txt"), " ").collect()} == {"r1"}


def test_scenes(spark, tmp_path):
    for name, n in (("s1", 5), ("s2", 3)):
        os.makedirs(tmp_path / "train" / name)
        np.save(tmp_path / "train" / name / "coord.npy", np.arange(3 * n).reshape(n, 3).astype("f8"))
    np.save(tmp_path / "train/s1/segment.npy", np.arange(5)[:, None])
    got = scenes.read_scenes(spark, str(tmp_path), "train", batch=2).orderBy("scene", "i").collect()
    assert [(r.scene, r.x, r.segment, r.instance, r.color) for r in got[:6]] == [("s1", 3.0 * i, i, -1, None) for i in range(5)] + [("s2", 0.0, -1, -1, None)]
    np.save(tmp_path / "train/s2/coord.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="pickle"):
        scenes.read_scenes(spark, str(tmp_path), "train").collect()
    (tmp_path / "list.json").write_text(json.dumps(["train/s1"]))
    assert scenes.resolve_split(str(tmp_path), ["list.json", "tra*/"[:3] + "*"])[0].endswith("train/s1")
    np.arange(8, dtype="<f4").tofile(tmp_path / "a.bin")
    np.array([40 | 7 << 16, 99], dtype="<i4").tofile(tmp_path / "a.label")
    got = scenes.read_scans(spark, [str(tmp_path / "a.bin")], [str(tmp_path / "a.label")], {40: 8}).orderBy("i").collect()
    assert [(r.x, r.strength, r.segment) for r in got] == [(0.0, 3.0, 8), (4.0, 7.0, -1)]
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty double y\nproperty uchar sem_class\nend_header\n" + struct.pack("<fdBfdB", 1, 2, 3, 4, 5, 6)
    (tmp_path / "a.ply").write_bytes(ply)
    got = scenes.read_ply(spark, [str(tmp_path / "a.ply")], ("x", "y", "sem_class", "z")).orderBy("i").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2, 3, None), (4, 5, 6, None)]
    (tmp_path / "c.txt").write_text("1,2,3\nx,y,z\n4,5,6\n")
    assert scenes.read_text_clouds(spark, str(tmp_path / "c.txt"), ("x", "y", "z")).orderBy("x").collect()[1].scene == "c"
    with pytest.raises(ValueError):
        scenes.read_scan_infos(spark, "x.pkl", "")


def test_project_and_editor(spark, tmp_path):
    p = project.Project.create(spark, str(tmp_path / "p"), "Survey")
    with pytest.raises(FileExistsError):
        project.Project.create(spark, str(tmp_path / "p"))
    p.metadata["name"] = "Other"
    p.save()
    p = project.Project(spark, str(tmp_path / "p"))
    assert p.metadata["name"] == "Other" and p.validate() == []
    p.add_tiles(spark.createDataFrame([("t1", 10, "IMPORTED"), ("t2", 5, "IMPORTED")], "id string, point_count long, status string"))
    p.update("t1", qc_status="QC_PASSED")
    pts = spark.createDataFrame([(i, "t1", float(i), 1) for i in range(6)], "pid long, tile string, z double, classification int")
    e = project.Editor(p, "t1", pts)
    assert e.select(F.col("z") >= 3) == 3 and e.assign(6) == 1
    state = lambda: [r.classification for r in e.points().orderBy("pid").collect()]
    assert state() == [1, 1, 1, 6, 6, 6] and {r.id: (r.status, r.qc_status) for r in p.tiles().collect()} == {"t1": ("EDITED", "QC_PASSED"), "t2": ("IMPORTED", None)}
    assert e.undo() and state() == [1] * 6 and e.redo() and state() == [1, 1, 1, 6, 6, 6] and e.can_undo() and not e.can_redo()
    p.record_time("t1", "filter", 1.5, 10)
    p.delete_tile("t1")
    assert [r.id for r in p.tiles().collect()] == ["t2"] and p.edits().count() == 0 and p.table("times").count() == 1


def test_editor_keeps_points_in_tables(spark, tmp_path, monkeypatch):
    """A selection of many points neither comes to the driver nor goes into one row of the log; undo and redo take it from there."""
    p = project.Project.create(spark, str(tmp_path / "p"))
    p.add_tiles(spark.createDataFrame([("t", 5000, "IMPORTED")], "id string, point_count long, status string"))
    pts = spark.range(5000).select(F.col("id").alias("pid"), F.lit("t").alias("tile"), (F.col("id") % 3).cast("int").alias("classification"))
    log, collect = project.Project.log_changes, type(pts).collect
    monkeypatch.setattr(project.Project, "log_changes", lambda self, tile, changes: log(self, tile, changes, most=1000))
    held = []
    monkeypatch.setattr(type(pts), "collect", lambda self: held.append(collect(self)) or held[-1])
    e = project.Editor(p, "t", pts)
    assert e.select(F.col("pid") < 4000) == 4000 and e.assign(6) == 1
    classes = lambda: {(r.classification, r["count"]) for r in e.points().groupBy("classification").count().collect()}
    assert classes() == {(6, 4000), (0, 333), (1, 334), (2, 333)}
    assert e.undo() and classes() == {(0, 1667), (1, 1667), (2, 1666)}
    assert sorted(r.id for r in p.edits("t").select("id").distinct().collect()) == [1, 2, 3, 4]
    assert e.redo() and classes() == {(6, 4000), (0, 333), (1, 334), (2, 333)} and not e.redo()
    assert p.edits("t", newest=1).select("id").distinct().count() == 1 and p.edits("t").where("size(points) > 1200").isEmpty()
    assert max(map(len, held)) < 50
    e.select(F.col("pid") < 0)
    assert e.assign(2) is None


def test_control_points_with_empty_fields(spark, tmp_path):
    """An empty field keeps its place; a first line of numbers is data though a header was announced."""
    (tmp_path / "a.csv").write_text("p1,,1,2,3\n,5,4,5,6\np3,,7,x,9\n")
    got = tables.read_control_points(spark, str(tmp_path / "a.csv"), has_header=False, columns={"name": 0, "x": 2, "y": 3, "z": 4}).orderBy("x").collect()
    assert [(r.name or "", r.x, r.y, r.z) for r in got] == [("p1", 1.0, 2.0, 3.0), ("", 4.0, 5.0, 6.0)]
    (tmp_path / "b.csv").write_text("1.5;2;3\n4;5;6\n")
    assert [r.x for r in tables.read_control_points(spark, str(tmp_path / "b.csv"), ";").orderBy("x").collect()] == [1.5, 4.0]
    (tmp_path / "c.csv").write_text("Elev,,North,East,ID\n1,,2,3,a b\n")
    row = tables.read_control_points(spark, str(tmp_path / "c.csv")).first()
    assert (row["name"], row.x, row.y, row.z) == ("a b", 3.0, 2.0, 1.0)
    (tmp_path / "d.csv").write_text("")
    assert tables.read_control_points(spark, str(tmp_path / "d.csv")).count() == 0
