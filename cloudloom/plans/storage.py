"""Round trips of the adapter's points through files, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapter import points
from ..lineage import shared_folder
from ..operators import surface
from ..sources import las, rasters, scenes, tables
from .registry import query
from .registry import rounded as _r


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def tiles(spark, d) -> str:
    """The points as one LAS file a tile."""
    path = scratch(spark, "tiles")
    own = points(spark, d).select("pid", "x", "y", "z", "classification", "intensity", "tile", F.col("rn").alias("return_number"), F.col("nr").alias("number_of_returns"), F.col("line").alias("point_source_id"), F.col("t").alias("gps_time"))
    las.write_tiles(own, path, scale="0.01,0.01,0.01", wkt='LOCAL_CS["plane"]')
    return path


@query("SELECT pid, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, classification, intensity, rn, nr, line, round(t, 3) AS t, 'tile_' || CAST(tile AS VARCHAR) || '.las' AS file FROM pts")
def las_tiles(spark, d):
    """Written as tiles and read again, an extra dimension included."""
    back = las.read_las(spark, tiles(spark, d))
    return back.select("pid", _r("x", 2), _r("y", 2), _r("z", 2), "classification", "intensity", F.col("return_number").alias("rn"), F.col("number_of_returns").alias("nr"), F.col("point_source_id").alias("line"), F.round("gps_time", 3).alias("t"), "file")


@query("SELECT pid, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, classification, intensity, rn, nr, line, round(t, 3) AS t, 'tile_' || CAST(tile AS VARCHAR) || '.laz' AS file, row_number() OVER (PARTITION BY tile ORDER BY pid) - 1 AS point_idx FROM pts")
def laz_tiles(spark, d):
    """Written as compressed tiles and read again by chunks of 500 points, each decoded on its own; points keep their places."""
    path = scratch(spark, "packed")
    own = points(spark, d).select("pid", "x", "y", "z", "classification", "intensity", "tile", F.col("rn").alias("return_number"), F.col("nr").alias("number_of_returns"), F.col("line").alias("point_source_id"), F.col("t").alias("gps_time"))
    spark.dataSource.register(las.LasSource)
    dealt = own.repartition("tile").sortWithinPartitions("tile", "pid")
    dealt.write.format("las").mode("append").options(scale="0.01,0.01,0.01", compress="true", chunk="500").save(path)
    back = las.read_las(spark, path, chunk="500")
    return back.select("pid", _r("x", 2), _r("y", 2), _r("z", 2), "classification", "intensity", F.col("return_number").alias("rn"), F.col("number_of_returns").alias("nr"), F.col("point_source_id").alias("line"), F.round("gps_time", 3).alias("t"), "file", "point_idx")


@query("SELECT 'tile_' || CAST(tile AS VARCHAR) || '.las' AS file, count(*) AS n_points, round(min(x), 2) AS min_x, round(max(y), 2) AS max_y, round(max(z), 2) AS max_z, 'LOCAL_CS[\"plane\"]' AS wkt FROM pts GROUP BY tile")
def las_headers(spark, d):
    """Boxes and counts without reading points."""
    return las.read_headers(spark, tiles(spark, d)).select("file", "n_points", _r("min_x", 2), _r("max_y", 2), _r("max_z", 2), "wkt")


@query("-- ctes b AS (SELECT tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1) SELECT count(*) AS n, count(DISTINCT tile) AS files FROM pts JOIN b USING (tile) WHERE x1 >= 250 AND x0 <= 350 AND y1 >= 250 AND y0 <= 550")
def las_box(spark, d):
    """Files whose box misses a box are not opened for their points."""
    own = las.read_las(spark, tiles(spark, d), bbox="250,250,350,550")
    return own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query("-- ctes g AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM pts), e AS (SELECT *, greatest(50.0, round_even(sqrt(500 / (n / ((x1 - x0) * (y1 - y0)))) / 50, 0) * 50) AS s FROM g), t AS (SELECT least(CAST(ceil((y1 - y0) / s) AS BIGINT) - 1, CAST(trunc((y - y0) / s) AS BIGINT)) * CAST(ceil((x1 - x0) / s) AS BIGINT) + least(CAST(ceil((x1 - x0) / s) AS BIGINT) - 1, CAST(trunc((x - x0) / s) AS BIGINT)) AS tile FROM pts CROSS JOIN e) SELECT tile, count(*) AS n FROM t GROUP BY 1")
def las_import(spark, d):
    """Strips dealt to tiles of a size that follows from their headers."""
    own = las.import_folder(spark, tiles(spark, d), target=500)
    return own.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


@query("-- ctes n AS (SELECT 'tile_' || CAST(tile AS VARCHAR) || CASE WHEN z > 100 THEN '.las' ELSE '_noise.las' END AS file FROM pts) SELECT regexp_replace(file, '^tile_(\\d+)_noise', '\\1_noise') AS file, count(*) AS n FROM n GROUP BY 1")
def las_split(spark, d):
    """Kept points as tiles, dropped ones as noise files beside them."""
    path = scratch(spark, "split")
    own = points(spark, d).select("pid", "x", "y", "z", "classification", "tile", (F.col("z") > 100).alias("keep"))
    las.write_split(own, path)
    both = las.read_las(spark, path).select("file").unionByName(las.read_las(spark, f"{path}/noise").select("file"))
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(y / 20) AS BIGINT) AS row, CAST(floor(x / 20) AS BIGINT) AS col, round(max(z), 2) AS z FROM pts GROUP BY 1, 2")
def raster_files(spark, d):
    """A grid written as GeoTIFF files of 25 squared cells and put together again."""
    path = scratch(spark, "rasters")
    cells = points(spark, d).groupBy(F.floor(F.col("y") / 20).cast("long").alias("row"), F.floor(F.col("x") / 20).cast("long").alias("col")).agg(F.max("z").alias("z"))
    made = rasters.write_rasters(cells, path, 20.0, 25, "tif", kind="f8").collect()
    out = None
    for r in made:
        own, geo = rasters.read_geotiff(spark, r["path"])
        own = own.select((F.col("row") + int(geo["y0"] // 20)).alias("row"), (F.col("col") + int(geo["x0"] // 20)).alias("col"), _r("z", 2))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT round(t, 6) AS t, x, y, z FROM (SELECT t, x, y, z, pid FROM pts WHERE pid % 50 = 0)")
def trajectory_text(spark, d):
    """A trajectory as text with comments and broken rows, read back."""
    path = scratch(spark, "trajectory")
    own = points(spark, d).where("pid % 50 = 0").select(F.format_string("%.6f;%.2f;%.2f;%s", "t", "x", "y", F.col("z").cast("string")).alias("value"))
    junk = spark.createDataFrame([("# comment",), ("",), ("1;2",), ("a;b;c;d",)], "value string")
    own.unionByName(junk).write.text(path)
    return tables.read_trajectory(spark, path, separator=";").select(F.round("t", 6).alias("t"), "x", "y", "z")


@query("SELECT s_name AS name, (s_suppkey * 7919 % 1000) * 1.0E0 AS x, (s_suppkey * 104729 % 1000) * 1.0E0 AS y, round(s_acctbal % 500, 2) AS z FROM supplier", pts=False)
def control_point_csv(spark, d):
    from ..adapter import gcp

    path = scratch(spark, "gcp")
    gcp(spark, d).select("name", "x", "y", F.round("z", 2).alias("z")).coalesce(1).write.option("header", True).csv(path)
    return tables.read_control_points(spark, path).select("name", "x", "y", _r("z", 2))


@query("SELECT CAST(tile AS VARCHAR) AS scene, count(*) AS n, round(avg(z), 3) AS z, CAST(sum(classification) AS BIGINT) AS classes FROM pts GROUP BY tile")
def scene_arrays(spark, d):
    """Scenes as folders of arrays, one a tile."""
    import io

    import numpy as np
    import pyarrow as pa

    from ..sources.files import open_write

    root = scratch(spark, "scenes")

    def save(table: pa.Table) -> pa.Table:
        scene = str(table["tile"][0].as_py())
        for name, values in (("coord", np.stack([table[c].to_numpy() for c in "xyz"], axis=1).astype("<f4")), ("segment", table["classification"].to_numpy().astype("<i4")[:, None])):
            held = io.BytesIO()
            np.save(held, values)
            with open_write(f"{root}/all/{scene}/{name}.npy") as f:
                f.write(held.getvalue())
        return pa.table({"scene": [scene]})

    points(spark, d).select("tile", "x", "y", "z", "classification").groupBy("tile").applyInArrow(save, "scene string").write.format("noop").mode("overwrite").save()
    own = scenes.read_scenes(spark, root.removeprefix("file://").removeprefix("file:"), "all")
    return own.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 3).alias("z"), F.sum("segment").alias("classes"))
