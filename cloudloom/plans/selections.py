"""Filters, selections, samples and set operations over the adapter's points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import points
from ..operators import basic, selection
from ..ranges import placed
from .registry import query
from .registry import rounded as _r

CORRIDOR = """c AS (SELECT *, greatest(0.0, least(1.0, ((x - 100.0) * 700.0 + (y - 100.0) * 500.0) / 740000.0)) AS f FROM pts),
 prof AS (SELECT *, f * sqrt(740000.0E0) AS along FROM c WHERE sqrt((x - (100.0 + f * 700.0))**2 + (y - (100.0 + f * 500.0))**2) <= 20)"""


def profile(spark, d):
    return basic.corridor(points(spark, d), 100.0, 100.0, 800.0, 600.0, 40.0)


@query("SELECT pid, classification FROM pts WHERE classification IN (2, 6)")
def class_filter(spark, d):
    return selection.class_filter(points(spark, d), (2, 6)).select("pid", "classification")


@query("SELECT pid, intensity * 2 AS extra_0, line + 0.5E0 AS extra_1 FROM pts WHERE z > 100")
def keep_mask(spark, d):
    """A mask applied to all columns, extra dimensions included."""
    p = points(spark, d).withColumns({"extra_0": F.col("intensity") * 2, "extra_1": F.col("line") + 0.5, "keep": F.col("z") > 100})
    return selection.apply_mask(p).select("pid", "extra_0", "extra_1")


@query("SELECT pid, classification, tile FROM (SELECT *, max(classification = 2 AND tile % 3 <> 0) OVER (PARTITION BY tile) AS has FROM pts) WHERE (classification = 2 AND tile % 3 <> 0) OR NOT has")
def ground_or_all(spark, d):
    """Ground points by tile; every third tile has its ground class changed, so that it falls back on all points."""
    changed = F.when((F.col("classification") == 2) & (F.col("tile") % 3 == 0), 12).otherwise(F.col("classification"))
    p = points(spark, d).withColumn("was", F.col("classification")).withColumn("classification", changed)
    return selection.ground_or_all(p).select("pid", F.col("was").alias("classification"), "tile")


@query("SELECT pid FROM pts WHERE NOT (sensor = 2 AND nr <= 1)")
def water_single_returns(spark, d):
    return selection.drop_single_water_returns(points(spark, d)).select("pid")


@query("SELECT pid, (z > 100) OR sensor <> 2 AS keep FROM pts")
def sensor_override(spark, d):
    return points(spark, d).select("pid", selection.keep_other_sensors(F.col("z") > 100).alias("keep"))


@query("-- ctes s AS (SELECT *, CASE WHEN line = 8 THEN 0 ELSE sensor END AS sn FROM pts) SELECT pid, (z > 100) OR sn = 1 AS keep FROM s")
def river_override(spark, d):
    p = points(spark, d).withColumn("sensor", F.when(F.col("line") == 8, 0).otherwise(F.col("sensor")))
    return p.select("pid", selection.keep_topo(F.col("z") > 100).alias("keep"))


@query("""-- ctes b AS (SELECT tile, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1)
SELECT tile FROM b WHERE x1 >= 150 AND x0 <= 450 AND y1 >= 150 AND y0 <= 420""")
def bbox_tiles(spark, d):
    return selection.boxes_meet(basic.tile_catalog(points(spark, d)), 150, 150, 450, 420).select("tile")


@query(f"-- ctes {CORRIDOR} SELECT pid, round(along, 6) AS along, z FROM prof")
def profile_corridor(spark, d):
    return profile(spark, d).select("pid", _r("along"), "z")


@query("SELECT pid, 0.0E0 AS along FROM pts WHERE sqrt((x - 500)**2 + (y - 500)**2) <= 40")
def profile_degenerate(spark, d):
    """A corridor whose ends fall together takes the full width as radius."""
    return basic.corridor(points(spark, d), 500.0, 500.0, 500.0, 500.0, 40.0).select("pid", "along")


@query(f"-- ctes {CORRIDOR} SELECT pid FROM prof WHERE z > 50.0 + (along - 100.0) * 0.25")
def profile_above_line(spark, d):
    return basic.above_line(profile(spark, d), 100.0, 50.0, 500.0, 150.0).select("pid")


@query(f"-- ctes {CORRIDOR} SELECT pid FROM prof WHERE z < 50.0 + (along - 100.0) * 0.25")
def profile_below_line(spark, d):
    return selection.below_line(profile(spark, d), 100.0, 50.0, 500.0, 150.0).select("pid")


@query(f"-- ctes {CORRIDOR} SELECT pid, CASE WHEN z > 50.0 + (along - 100.0) * 0.25 THEN 'above' ELSE 'below' END AS side FROM prof WHERE along BETWEEN 100 AND 500 AND z <> 50.0 + (along - 100.0) * 0.25")
def profile_segment(spark, d):
    both = [selection.beside_segment(profile(spark, d), 100.0, 50.0, 500.0, 150.0, s).select("pid", F.lit(s).alias("side")) for s in ("above", "below")]
    return both[0].unionByName(both[1])


@query(f"-- ctes {CORRIDOR} SELECT pid FROM prof WHERE (along BETWEEN 100 AND 300 AND z BETWEEN 50 AND 200) OR sqrt((along - 400)**2 + (z - 120)**2) <= 60")
def profile_select(spark, d):
    """Two selections added up."""
    return profile(spark, d).where(selection.in_rectangle(100, 300, 200, 50) | selection.in_brush(400, 120, 60)).select("pid")


@query(f"-- ctes {CORRIDOR} SELECT pid FROM prof WHERE along BETWEEN 380 AND 420 AND z BETWEEN 20 AND 220")
def profile_rect_brush(spark, d):
    return profile(spark, d).where(selection.in_rect_brush(400, 120, 20, 100)).select("pid")


@query(f"-- ctes {CORRIDOR} SELECT pid, round(along, 6) AS along, z, row_number() OVER (ORDER BY along, pid) AS place FROM prof")
def profile_ordered(spark, d):
    """A profile's points from its start to its end."""
    return placed(profile(spark, d), ["along", "pid"]).select("pid", _r("along"), "z", "place")


@query(f"-- ctes {CORRIDOR} SELECT pid, round(sqrt((along - 400)**2 + (z - 120)**2), 6) AS dist FROM prof WHERE sqrt((along - 400)**2 + (z - 120)**2) <= 60 ORDER BY sqrt((along - 400)**2 + (z - 120)**2), pid LIMIT 1")
def profile_pick(spark, d):
    return selection.pick_profile(profile(spark, d), 400, 120, 20).select("pid", _r("dist"))


@query("SELECT pid, CASE WHEN classification = 2 THEN 2 WHEN classification IN (5, 6) THEN 3 ELSE 0 END AS mapped FROM pts")
def class_remap(spark, d):
    return selection.remap(points(spark, d), {2: 2, 5: 3, 6: 3}, 0).select("pid", "mapped")


@query("SELECT pid, x FROM pts WHERE ((pid - 1) % 1000) % 7 = 0")
def stride_sample(spark, d):
    """Every seventh row, counted anew in each chunk of 1,000."""
    return selection.stride_sample(points(spark, d), 7, chunk=1000).select("pid", "x")


@query("SELECT pid FROM pts WHERE (SELECT count(*) FROM pts) <= 1500 OR (pid - 1) % greatest(1, (SELECT count(*) FROM pts) // 1500) = 0")
def budget_stride(spark, d):
    return selection.budget_stride(points(spark, d), 1500).select("pid")


@query("SELECT pid, intensity FROM pts WHERE intensity / ((SELECT max(intensity) FROM pts) + 1e-6) >= 0.25")
def intensity_floor(spark, d):
    return selection.intensity_floor(points(spark, d), 0.25).select("pid", "intensity")


@query("-- ctes g AS (SELECT floor(y / 50) AS r, floor(x / 50) AS c, avg(z) AS g FROM pts GROUP BY 1, 2) SELECT pid FROM pts JOIN g ON r = floor(y / 50) AND c = floor(x / 50) WHERE z - g >= -20")
def floor_filter(spark, d):
    p = points(spark, d)
    means = basic.grid(p, 50, g=F.avg("z"))
    with_height = p.join(means, (F.floor(F.col("y") / 50).cast("long") == F.col("row")) & (F.floor(F.col("x") / 50).cast("long") == F.col("col")))
    return selection.floor_filter(with_height.withColumn("hag", F.col("z") - F.col("g")), 20.0).select("pid")


@query("SELECT pid, greatest(100.0, least(800.0, x)) AS x, greatest(50.0, least(900.0, y)) AS y, greatest(10.0, least(300.0, z)) AS z FROM pts")
def point_clip(spark, d):
    return selection.clip_to_box(points(spark, d), (100, 50, 10), (800, 900, 300)).select("pid", "x", "y", "z")


@query("SELECT pid, classification FROM pts WHERE classification NOT IN (1, 7)")
def crop_boundary(spark, d):
    return selection.drop_segments(points(spark, d), (1, 7)).select("pid", "classification")


@query("SELECT pid FROM pts WHERE z - (x * 0.1 + y * (-0.05) + 40) > -60 AND z - (x * 0.1 + y * (-0.05) + 40) < 60")
def plane_prune(spark, d):
    return selection.prune_by_plane(points(spark, d), 0.1, -0.05, 40.0, 60.0).select("pid")


@query("-- ctes a AS (SELECT floor(y / 50) AS r, floor(x / 50) AS c, round(quantile_cont(z, 0.05), 6) AS a FROM pts GROUP BY 1, 2) SELECT pid FROM pts JOIN a ON r = floor(y / 50) AND c = floor(x / 50) WHERE z > a - 1.5003 AND z < a + 2.5003")
def anchor_band(spark, d):
    p = points(spark, d)
    return selection.anchor_band(p, basic.grid(p, 50, z=F.round(F.expr("percentile(z, 0.05)"), 6)), 50, 1.5003, 2.5003).select("pid")


@query("SELECT pid, classification IN (1, 2) AS two, classification = 5 AS one, true AS every FROM pts")
def ground_source(spark, d):
    return points(spark, d).select("pid", selection.source_mask(-2).alias("two"), selection.source_mask(5).alias("one"), selection.source_mask(-1).alias("every"))


@query("SELECT pid, CAST(CASE WHEN classification IN (1, 2) THEN CASE WHEN z < 60 THEN 2 ELSE 1 END ELSE classification END AS INTEGER) AS classification FROM pts")
def apply_ground_mask(spark, d):
    return selection.apply_ground(points(spark, d).withColumn("ground", F.col("z") < 60), source=-2).select("pid", "classification")


@query("SELECT line, count(*) AS n FROM pts WHERE line NOT IN (2, 5) GROUP BY 1")
def shown_lines(spark, d):
    return selection.hide_lines(points(spark, d), (2, 5)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pid, x AS coord_x, z AS height, z AS strength, 0 AS split FROM pts")
def shape_fields(spark, d):
    p = selection.shape_fields(points(spark, d), ["pid", "coord_x", "height", "strength", "split"], copy={"z": "strength"}, update={"split": 0}, rename={"x": "coord_x", "z": "height"})
    return p


@query("SELECT pid, z FROM pts WHERE pid IN (SELECT DISTINCT pid * 3 FROM pts WHERE pid % 5 = 0)")
def index_operator(spark, d):
    p = points(spark, d)
    return selection.take_index(p, p.where("pid % 5 = 0").selectExpr("pid * 3")).select("pid", "z")


@query("SELECT pid FROM pts WHERE pid NOT IN (SELECT DISTINCT pid * 3 FROM pts WHERE pid % 5 = 0)")
def anti_index(spark, d):
    p = points(spark, d)
    return selection.drop_index(p, p.where("pid % 5 = 0").selectExpr("pid * 3")).select("pid")


@query("SELECT pid, round((x - 500)**2 + (y - 500)**2 + (z - 100)**2, 6) AS d2 FROM pts ORDER BY (x - 500)**2 + (y - 500)**2 + (z - 100)**2, pid LIMIT 300")
def sphere_crop(spark, d):
    return selection.nearest_to(points(spark, d), 500, 500, 300, 100).select("pid", _r("d2"))


@query()
def preview_cluster(spark, d):
    """A top-k sample about a centre that a seed picks by Spark's own hash."""
    return selection.preview_cluster(points(spark, d), 500, 7).select("pid")


@query()
def interactive_crop(spark, d):
    return selection.central_crop(points(spark, d), 2000, 7).select("pid")


@query()
def shuffled_points(spark, d):
    return selection.shuffled(points(spark, d), 7).select("pid")


# Set operations


@query("SELECT line, count(*) AS n, CAST(sum(pid) AS BIGINT) AS ids FROM pts GROUP BY 1")
def union_strips(spark, d):
    """Flight strips as separate tables, put together again."""
    p = points(spark, d)
    strips = [p.where(F.col("line") == i) for i in range(1, 9)]
    return selection.union_all(strips).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("ids"))


@query("SELECT tile, count(*) AS n, min(z) AS low FROM pts WHERE tile IN (0, 1, 5, 6) GROUP BY 1")
def merge_tiles(spark, d):
    p = points(spark, d)
    merged = selection.union_all(p.where(F.col("tile") == t) for t in (0, 1, 5, 6))
    return merged.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"))


@query("SELECT pid, CASE WHEN line = 1 THEN intensity END AS amplitude, CASE WHEN line = 2 THEN nr END AS width FROM pts WHERE line IN (1, 2)")
def union_extra_dims(spark, d):
    """Files with different extra dimensions; what a file lacks is null."""
    p = points(spark, d)
    return selection.union_all([p.where("line = 1").select("pid", F.col("intensity").alias("amplitude")), p.where("line = 2").select("pid", F.col("nr").alias("width"))])


@query("-- ctes n AS (SELECT line, list_sort(CASE WHEN line % 2 = 0 THEN ['amplitude', 'refracted_depth', 'user'] ELSE ['reflectance', 'water_depth'] END) AS own FROM (SELECT DISTINCT line FROM pts)) SELECT line, array_to_string(list_filter(own, lambda e: e IN ('refracted_depth', 'water_depth', 'turbidity')), ',') AS bathy FROM n")
def common_dims(spark, d):
    """Which of a line's dimension names are bathymetric."""
    names = F.when(F.col("line") % 2 == 0, F.array(*map(F.lit, ("amplitude", "refracted_depth", "user")))).otherwise(F.array(*map(F.lit, ("reflectance", "water_depth"))))
    lines = points(spark, d).select("line").distinct()
    return lines.select("line", F.array_join(selection.common_names(names, ("refracted_depth", "water_depth", "turbidity")), ",").alias("bathy"))


@query("SELECT z > 100 AS clean, count(*) AS n, CAST(sum(pid) AS BIGINT) AS ids FROM pts GROUP BY 1")
def noise_split(spark, d):
    """Clean and noise rows of a mask as two tables."""
    clean, noise = selection.split_by_mask(points(spark, d).withColumn("keep", F.col("z") > 100))
    sums = lambda t, flag: t.agg(F.lit(flag).alias("clean"), F.count(F.lit(1)).alias("n"), F.sum("pid").alias("ids"))
    return sums(clean, True).unionByName(sums(noise, False))


@query("SELECT pid FROM pts WHERE classification = 2 EXCEPT SELECT pid FROM pts WHERE z > 100")
def except_high(spark, d):
    p = points(spark, d)
    return p.where("classification = 2").select("pid").exceptAll(p.where("z > 100").select("pid"))


@query("SELECT pid FROM pts WHERE x < 600 INTERSECT SELECT pid FROM pts WHERE x > 400")
def intersect_views(spark, d):
    """The rows that two views of a scene share."""
    p = points(spark, d)
    return p.where("x < 600").select("pid").intersect(p.where("x > 400").select("pid"))


@query("SELECT CAST(line - 1 AS INTEGER) AS batch, count(*) AS n, CAST(sum(pid) AS BIGINT) AS ids FROM pts WHERE line <= 3 GROUP BY 1")
def concat_batches(spark, d):
    p = points(spark, d)
    parts = selection.union_all([p.where(F.col("line") == i) for i in (1, 2, 3)], number="batch")
    return parts.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("ids"))
