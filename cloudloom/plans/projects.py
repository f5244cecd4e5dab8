"""Projects, editor sessions, presets and files in the forms that surveys and training sets come in, over the adapter's points."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapter import gcp, points, read
from ..functions import arrays
from ..operators import basic, inference, pipeline, register
from ..sources import las, scenes, tables
from ..sources.files import open_write
from ..sources.project import Editor, Project
from .registry import query
from .registry import rounded as _r
from .storage import scratch, tiles


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def saved_by_tile(df: DataFrame, root: str, name: str, form) -> list[str]:
    """One file a tile, made by form(table) in the tile's task; their paths in order of tiles."""

    def save(table: pa.Table) -> pa.Table:
        path = f"{root}/{name.format(table['tile'][0].as_py())}"
        with open_write(path) as f:
            f.write(form(table))
        return pa.table({"path": [path], "tile": pa.array([table["tile"][0].as_py()], pa.int64())})

    made = df.groupBy("tile").applyInArrow(save, "path string, tile long").collect()  # a row a file
    return [r["path"] for r in sorted(made, key=lambda r: r["tile"])]


# Points


@query("-- ctes m AS (SELECT *, max(nr) OVER (PARTITION BY tile) AS most, sum((rn = nr)::INT) OVER (PARTITION BY tile) AS n_last FROM pts) SELECT pid, tile FROM m WHERE most <= 1 OR n_last < 3 OR rn = nr")
def last_returns(spark, d):
    """Last returns where a tile has several a pulse, else all points."""
    return basic.last_returns(points(spark, d)).select("pid", "tile")


@query("SELECT pid, round(exp(-(z * z) / (2 * 80.0 * 80.0)), 9) AS w FROM pts")
def gaussian_weights(spark, d):
    return points(spark, d).select("pid", F.round(arrays.gaussian(F.col("z"), 80.0), 9).alias("w"))


@query("-- ctes n AS (SELECT line, pid, row_number() OVER (PARTITION BY line ORDER BY pid) - 1 AS r, count(*) OVER (PARTITION BY line) AS size FROM pts WHERE line <= 3), g AS (SELECT CAST(ceil(count(*) / 2) AS BIGINT) AS rounds FROM n WHERE line = 1), w AS (SELECT line, pid, lap * size + r AS n, CASE WHEN line = 1 THEN 2 ELSE 1 END AS ratio FROM n, g, range(100) l(lap) WHERE lap * size + r < rounds * CASE WHEN line = 1 THEN 2 ELSE 1 END) SELECT 'line' || line AS dataset, pid, n // ratio AS turn, CAST(line - 1 AS INTEGER) AS part, n % ratio AS i FROM w")
def weighted_rounds(spark, d):
    """Three lines dealt in turn, two rows of the first to one of each other, the shorter ones over again until the first is through."""
    p = points(spark, d)
    dealt = inference.sampled_by_weight({f"line{i}": (p.where(F.col("line") == i).select("pid"), 2 if i == 1 else 1) for i in (1, 2, 3)}, "line1", "pid")
    return dealt.select("dataset", "pid", "place.turn", "place.part", "place.i")


@query("SELECT line, CASE line WHEN 1 THEN least(count(*), 40) WHEN 2 THEN least(count(*), 7) WHEN 3 THEN 0 ELSE count(*) END AS n FROM pts GROUP BY line HAVING line <> 3")
def capped_sources(spark, d):
    """At most so many points of some lines; which ones a hash says, so only their number is compared here."""
    own = points(spark, d).select("pid", F.col("line").cast("string").alias("source"))
    return inference.capped(own, {"1": 40, "2": 7, "3": 0}, key="pid").groupBy(F.col("source").cast("int").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# Filter pipelines

STEPS = [{"type": "thin_average", "grid_size": 20}, {"type": "thin_average", "grid_size": 60}]
_THIN = "SELECT arg_min(pid, (round((x-cx)**2 + (y-cy)**2 + (z-cz)**2, 6), pid)) AS pid FROM {t} JOIN (SELECT floor(y / {s}) AS r, floor(x / {s}) AS c, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {t} GROUP BY 1, 2) ON r = floor(y / {s}) AND c = floor(x / {s}) GROUP BY r, c"
_TWICE = f"t1 AS ({_THIN.format(t='pts', s=20)}), p1 AS (SELECT pts.* FROM pts JOIN t1 USING (pid)), t2 AS ({_THIN.format(t='p1', s=60)})"


@query(f"-- ctes {_TWICE} SELECT pid FROM t2")
def preset_filter(spark, d):
    """A pipeline saved as a preset, loaded and run."""
    path = local(scratch(spark, "preset")) + ".json"
    pipeline.save_preset(path, STEPS, "two thinnings")
    return pipeline.run(points(spark, d), pipeline.load_preset(path)).select("pid")


@query(f"-- ctes {_TWICE} SELECT 1 AS step, 'thin_average' AS type, count(*) AS n, true AS timed FROM t1 UNION ALL SELECT 2, 'thin_average', count(*), true FROM t2")
def timed_pipeline(spark, d):
    """Rows left after each step, and that each was timed."""
    times: list = []
    pipeline.run(points(spark, d), STEPS, times)
    return spark.createDataFrame([(i + 1, kind, n, seconds > 0) for i, (kind, seconds, n) in enumerate(times)], "step int, type string, n long, timed boolean")


# LAS


@query("SELECT DISTINCT 'tile_' || CAST(tile AS VARCHAR) || '.las' AS file, 'LOCAL_CS[\"plane\"]' AS crs FROM pts")
def crs_of_files(spark, d):
    """The reference system of each file of a folder."""
    return spark.createDataFrame(sorted(las.crs_by_file(spark, tiles(spark, d)).items()), "file string, crs string")


@query("SELECT DISTINCT '1.4' AS version, 6 AS point_format, '0.01,0.01,0.01' AS scale, 'LOCAL_CS[\"plane\"]' AS wkt, 'pid <i8' AS extra FROM pts")
def header_template(spark, d):
    """What files made from a folder take over from it."""
    t = las.template(local(tiles(spark, d)))
    row = (".".join(map(str, t["version"])), t["point_format"], t["scale"], t["wkt"], ";".join(f"{k} {v}" for k, v in t["extra"].items()))
    return spark.createDataFrame([row], "version string, point_format int, scale string, wkt string, extra string")


@query("SELECT pid, round(z, 2) AS z, rn, 0.0 AS t, 0 AS red, 0 AS nothing FROM pts")
def safe_attributes(spark, d):
    """Format 0 has neither times nor colours: they read as what stands for them."""
    path = scratch(spark, "plain")
    own = points(spark, d).select("pid", "x", "y", "z", "tile", F.col("rn").alias("return_number"), F.col("nr").alias("number_of_returns"), F.col("t").alias("gps_time"))
    las.write_tiles(own, path, scale="0.01,0.01,0.01", point_format="0")
    back = las.read_las(spark, path)
    return back.select("pid", _r("z", 2), F.col("return_number").alias("rn"), F.col("gps_time").alias("t"), "red", F.col("overlap").alias("nothing"))


# Text


@query("SELECT CAST(s_suppkey % 4 AS VARCHAR) AS surface, (s_suppkey * 7919 % 1000) * 1.0E0 AS x, (s_suppkey * 104729 % 1000) * 1.0E0 AS y, round(s_acctbal % 500, 2) AS z FROM supplier WHERE s_suppkey % 4 IN (SELECT s_suppkey % 4 FROM supplier GROUP BY 1 HAVING count(*) >= 3)", pts=False)
def roof_corners(spark, d):
    """Corners of surfaces from text; surfaces of fewer than three go."""
    path = scratch(spark, "roofs")
    own = read(spark, d, "supplier").select("s_suppkey").join(gcp(spark, d).withColumn("s_suppkey", F.regexp_extract("name", r"(\d+)$", 1).cast("long")), "s_suppkey")
    own.select((F.col("s_suppkey") % 4).alias("name"), "x", "y", F.round("z", 2).alias("z")).coalesce(1).write.option("header", True).csv(path)
    return tables.read_roofs(spark, path).select("surface", "x", "y", _r("z", 2))


@query("SELECT pid, round(t, 3) AS t, x, y FROM pts WHERE pid % 50 = 0")
def trajectory_columns(spark, d):
    """The columns of a trajectory guessed from the names in its header, whatever their order."""
    path = scratch(spark, "shuffled")
    own = points(spark, d).where("pid % 50 = 0").select(F.col("z").alias("Altitude"), F.col("y").alias("Northing"), F.round("t", 3).cast("string").alias("GPS_Time"), F.col("x").alias("Easting"), F.col("pid").alias("Label"))
    own.withColumn("GPS_Time", F.format_string("%.3f", F.col("GPS_Time").cast("double"))).coalesce(1).write.option("header", True).csv(path)
    head = spark.read.option("header", True).csv(path)
    at = tables.guess_columns(head.columns, ("name", "x", "y", "z", "time"))
    pick = lambda name, kind: F.col(head.columns[at[name]]).cast(kind)
    return head.select(pick("name", "long").alias("pid"), F.round(pick("time", "double"), 3).alias("t"), pick("x", "double").alias("x"), pick("y", "double").alias("y"))


@query("SELECT o_orderkey % 3 AS step, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", pts=False)
def timing_csv(spark, d):
    """A log written as CSV and read again."""
    path = scratch(spark, "times")
    tables.write_csv(read(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("step"), F.col("o_totalprice").alias("duration")), path)
    back = spark.read.option("header", True).schema("step long, duration double").csv(path)
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 2).alias("total"))


# Scenes

_BY_SCENE = "SELECT CAST(tile AS VARCHAR) AS scene, count(*) AS n, round(avg(z), 2) AS z, CAST(sum(classification) AS BIGINT) AS classes FROM pts {w}GROUP BY tile"


def by_scene(df: DataFrame) -> DataFrame:
    return df.groupBy(F.regexp_replace("scene", r"\.[a-z]+$", "").alias("scene")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 2).alias("z"), F.sum("classification").cast("long").alias("classes"))


def _npy(values: np.ndarray) -> bytes:
    import io

    held = io.BytesIO()
    np.save(held, values)
    return held.getvalue()


@query(_BY_SCENE.format(w="WHERE tile % 2 = 0 "))
def split_list(spark, d):
    """A split given as a list of folders in JSON."""
    root = local(scratch(spark, "split"))
    p = points(spark, d).select("tile", "x", "y", "z", "classification")
    saved_by_tile(p, root, "all/{}/coord.npy", lambda t: _npy(np.stack([t[c].to_numpy() for c in "xyz"], axis=1).astype("<f4")))
    made = saved_by_tile(p, root, "all/{}/segment.npy", lambda t: _npy(t["classification"].to_numpy().astype("<i4")[:, None]))
    names = [path.split("/")[-2] for path in made]
    with open_write(f"{root}/even.json") as f:
        f.write(json.dumps([f"all/{n}" for n in names if int(n) % 2 == 0]).encode())
    own = scenes.read_scenes(spark, root, "even.json")
    return by_scene(own.withColumnRenamed("segment", "classification"))


@query(_BY_SCENE.format(w=""))
def ply_scenes(spark, d):
    """A PLY file a tile, binary."""
    kinds = [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("sem_class", "<i4")]

    def form(t: pa.Table) -> bytes:
        own = np.zeros(t.num_rows, dtype=kinds)
        for name, c in (("x", "x"), ("y", "y"), ("z", "z"), ("sem_class", "classification")):
            own[name] = t[c].to_numpy()
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {t.num_rows}\nproperty double x\nproperty double y\nproperty double z\nproperty int sem_class\nend_header\n"
        return head.encode() + own.tobytes()

    files = saved_by_tile(points(spark, d), local(scratch(spark, "ply")), "{}.ply", form)
    return by_scene(scenes.read_ply(spark, files).withColumnRenamed("sem_class", "classification"))


@query(_BY_SCENE.format(w="").replace("sum(classification)", "sum(CASE WHEN classification = 7 THEN -1 ELSE classification * 10 END)"))
def scan_files(spark, d):
    """Binary scans and their labels; a class that the mapping lacks is ignored."""
    root = local(scratch(spark, "scans"))
    p = points(spark, d)
    scans = saved_by_tile(p, root, "{}.bin", lambda t: np.stack([t[c].to_numpy() for c in ("x", "y", "z", "intensity")], axis=1).astype("<f4").tobytes())
    labels = saved_by_tile(p, root, "{}.label", lambda t: (t["classification"].to_numpy().astype("<i4") | (5 << 16)).tobytes())
    own = scenes.read_scans(spark, scans, labels, {1: 10, 2: 20, 5: 50, 6: 60})
    return by_scene(own.withColumnRenamed("segment", "classification"))


@query(_BY_SCENE.format(w=""))
def text_clouds(spark, d):
    """A text file a tile, with lines that don't parse."""

    def form(t: pa.Table) -> bytes:
        lines = [f"{x!r},{y!r},{z!r},{c}" for x, y, z, c in zip(*(t[n].to_pylist() for n in ("x", "y", "z", "classification")))]
        return "\n".join(["x,y,z,class", *lines, "1,2"]).encode()

    root = local(scratch(spark, "text"))
    saved_by_tile(points(spark, d), root, "{}.txt", form)
    return by_scene(scenes.read_text_clouds(spark, root, ("x", "y", "z", "classification")))


# Projects

_TILES = "tiles AS (SELECT CAST(tile AS VARCHAR) AS id, count(*) AS n, min(x) AS min_x, max(y) AS max_y FROM pts GROUP BY 1)"


def project_of(spark, d) -> Project:
    p = Project.create(spark, local(scratch(spark, "project")), "survey", tile_size_m=200.0)
    box = basic.tile_catalog(points(spark, d))
    p.add_tiles(box.select(F.col("tile").cast("string").alias("id"), "min_x", "min_y", "max_x", "max_y", F.col("n").alias("point_count"), F.lit("IMPORTED").alias("status")))
    return p


@query(f"-- ctes {_TILES} SELECT id, n, round(min_x, 2) AS min_x, round(max_y, 2) AS max_y, CASE WHEN id = '7' THEN 'FILTERED' ELSE 'IMPORTED' END AS status, 'renamed' AS project, 0 AS problems FROM tiles")
def project_tiles(spark, d):
    """A project created, filled, renamed, saved and opened again."""
    p = project_of(spark, d)
    p.update("7", status="FILTERED")
    p.metadata["name"] = "renamed"
    p.save()
    again = Project(spark, p.root)
    # A tile that the table lacks was updated, not imported: it has no count.
    own = again.tiles().where("point_count is not null")
    return own.select("id", F.col("point_count").alias("n"), _r("min_x", 2), _r("max_y", 2), "status", F.lit(again.metadata["name"]).alias("project"), F.lit(len(again.validate())).alias("problems"))


@query(f"-- ctes {_TILES} SELECT id, n FROM tiles WHERE id NOT IN ('3', '11')")
def deleted_tiles(spark, d):
    """Tiles deleted from a project; their times stay, which recorded_times counts."""
    p = project_of(spark, d)
    for tile in ("3", "11"):
        p.delete_tile(tile)
    return p.tiles().select("id", F.col("point_count").alias("n"))


@query("SELECT CAST(o_custkey % 50 AS VARCHAR) AS tile, count(*) AS n, round(sum(o_totalprice / 1000.0E0), 6) AS duration FROM orders GROUP BY 1", pts=False)
def recorded_times(spark, d):
    """Times of steps recorded in a project, and what each tile took."""
    p = Project.create(spark, local(scratch(spark, "project")), "times")
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("tile"), F.lit("filter").alias("step"), F.expr("o_totalprice / 1000.0D").alias("duration"), F.lit(1).alias("points"))
    p.append("times", rows)
    p.delete_tile("7")
    return p.table("times").groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 6).alias("duration"))


@query("SELECT pid, CASE WHEN pid % 3 = 0 THEN 6 ELSE classification END AS classification, true AS undone, false AS more FROM pts WHERE tile = 12")
def editor_session(spark, d):
    """Some points of a tile marked as buildings; then others marked and that undone, twice, where only the last two steps are kept."""
    p = project_of(spark, d)
    own = points(spark, d).select("pid", "tile", "z", "classification").withColumn("tile", F.col("tile").cast("string"))
    e = Editor(p, "12", own, most=2)
    e.select(F.col("pid") % 3 == 0)
    e.assign(6)
    e.select(F.col("pid") >= 0)
    e.assign(1)
    e.select(F.col("pid") % 2 == 0)
    e.assign(18)
    done = [e.undo(), e.undo()]
    return e.points().select("pid", "classification", F.lit(all(done)).alias("undone"), F.lit(e.undo()).alias("more")).where("pid is not null")


@query("SELECT s_name AS name, round((s_suppkey * 7919 % 1000) * 1.0E0 + 500000, 3) AS x, round((s_suppkey * 104729 % 1000) * 1.0E0 + 5300000, 3) AS y, kind, kind = 'unknown' AS warned FROM supplier, (VALUES ('there and back'), ('unknown')) k(kind)", pts=False)
def control_point_transform(spark, d):
    """Control points taken to longitude and latitude and back; to a system that isn't known they stay, with a warning."""
    own = gcp(spark, d).withColumns({"x": F.col("x") + 500000, "y": F.col("y") + 5300000})
    there, no = register.transform_or_keep(own, 32632, 4326)
    back, none = register.transform_or_keep(there, 4326, 32632)
    same, warned = register.transform_or_keep(own, 32632, 99999)
    pick = lambda df, kind, flag: df.select("name", _r("x", 3), _r("y", 3), F.lit(kind).alias("kind"), F.lit(flag).alias("warned"))
    return pick(back, "there and back", bool(no or none)).unionByName(pick(same, "unknown", bool(warned)))
