"""Catalogue, edits, logs and tiling over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import points, read
from ..operators import basic, catalog, selection, tiling
from .registry import query
from .registry import rounded as _r

LOG = "log AS (SELECT o_custkey % 50 AS tile_id, CASE o_orderkey % 3 WHEN 0 THEN 'filter' WHEN 1 THEN 'model' ELSE 'ground' END AS step, o_totalprice / 1000.0E0 AS duration, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE month(o_orderdate) END AS batch, o_orderkey AS id, o_orderdate AS moment FROM orders)"


def log(spark, d):
    return read(spark, d, "orders").select(
        F.expr("o_custkey % 50").alias("tile_id"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'filter' WHEN 1 THEN 'model' ELSE 'ground' END").alias("step"),
        F.expr("o_totalprice / 1000.0D").alias("duration"),
        F.expr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE month(o_orderdate) END").alias("batch"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("moment"),
    )


@query(f"""WITH {LOG}, n AS (SELECT step, coalesce(CAST(batch AS VARCHAR), '(no batch)') AS batch, duration FROM log)
SELECT step, batch, CAST(grouping(step, batch) AS INTEGER) AS level, count(*) AS n, round(sum(duration), 2) AS total, round(avg(duration), 4) AS mean, round(quantile_cont(duration, 0.5), 4) AS median, min(duration) AS least, max(duration) AS most, round(coalesce(stddev_samp(duration), 0), 4) AS std, round(quantile_cont(duration, 0.25), 4) AS p25, round(quantile_cont(duration, 0.75), 4) AS p75 FROM n GROUP BY GROUPING SETS ((), (step), (batch))""", pts=False)
def processing_stats(spark, d):
    return basic.processing_stats(log(spark, d))


@query(f"WITH {LOG} SELECT coalesce(CAST(tile_id AS VARCHAR), '(unknown)') AS key, count(*) AS n, round(sum(duration), 4) AS total, round(avg(duration), 4) AS mean, round(coalesce(stddev_samp(duration), 0), 4) AS std, min(duration) AS least, max(duration) AS most FROM log GROUP BY 1", pts=False)
def timing_by_tile(spark, d):
    t = catalog.timing_table(log(spark, d), "tile_id")
    return t.select("key", "n", _r("total", 4), _r("mean", 4), _r("std", 4), "least", "most")


@query(f"WITH {LOG} SELECT coalesce(CAST(batch AS VARCHAR), '(unknown)') AS key, count(*) AS n, round(sum(duration), 4) AS total, round(avg(duration), 4) AS mean FROM log GROUP BY 1", pts=False)
def timing_by_batch(spark, d):
    return catalog.timing_table(log(spark, d), "batch").select("key", "n", _r("total", 4), _r("mean", 4))


@query(f"WITH {LOG} SELECT CAST(batch AS INTEGER) AS batch, min(duration) AS least, max(duration) AS most, count(*) AS n, string_agg(DISTINCT step, ',' ORDER BY step) AS steps FROM log WHERE batch IS NOT NULL GROUP BY 1", pts=False)
def distinct_batches(spark, d):
    own = log(spark, d).where("batch is not null")
    return own.groupBy("batch").agg(F.min("duration").alias("least"), F.max("duration").alias("most"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("step")), ",").alias("steps"))


@query(f"WITH {LOG} SELECT tile_id, id, duration, row_number() OVER (ORDER BY moment DESC, id DESC) AS place FROM log WHERE step = 'ground' AND tile_id IN (1, 2, 3) AND batch = 6 AND moment >= TIMESTAMP '1995-01-01 00:00:00'", pts=False)
def timing_filter(spark, d):
    """All bounds at once, the newest first."""
    from pyspark.sql.window import Window

    own = catalog.timing_filter(log(spark, d), (1, 2, 3), "ground", 6, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    return own.select("tile_id", "id", "duration", F.row_number().over(Window.orderBy(F.desc("moment"), F.desc("id"))).cast("long").alias("place"))


@query(f"WITH {LOG} SELECT tile_id, id FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY id DESC) AS r FROM log) WHERE r <= 3", pts=False)
def latest_entries(spark, d):
    return selection.latest(log(spark, d), 3, by=("tile_id",)).select("tile_id", "id")


@query(f"WITH {LOG} SELECT tile_id, id FROM log ORDER BY id DESC LIMIT 100", pts=False)
def newest_entries(spark, d):
    """The newest 100 rows of a history, as an undo stack holds them."""
    return selection.latest(log(spark, d), 100).select("tile_id", "id")


@query("SELECT CASE WHEN s < 0.001 THEN '0.00 s' WHEN s < 1 THEN format('{:.0f} ms', s * 1000) WHEN s < 60 THEN format('{:.2f} s', s) WHEN s < 3600 THEN format('{}m {:.1f}s', CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) ELSE format('{}h {}m {:.0f}s', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) END AS text, id FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey / 4096.0E0 WHEN 1 THEN (o_custkey % 240) / 4.0E0 + 0.25 WHEN 2 THEN o_custkey * 2.0E0 + 60.0 ELSE o_custkey * 16.0E0 + 3600 END AS s FROM orders)", pts=False)
def duration_text(spark, d):
    s = F.expr("CASE o_orderkey % 4 WHEN 0 THEN o_custkey / 4096.0D WHEN 1 THEN (o_custkey % 240) / 4.0D + 0.25 WHEN 2 THEN o_custkey * 2.0D + 60.0 ELSE o_custkey * 16.0D + 3600 END")
    return read(spark, d, "orders").select(catalog.duration_text(s).alias("text"), F.col("o_orderkey").alias("id"))


# Edits

EDITS = "WITH e AS (SELECT l_partkey AS point, l_orderkey AS at_, l_linenumber AS line, l_suppkey AS who, l_quantity AS q FROM lineitem WHERE l_returnflag = 'A')"


@query(EDITS + " SELECT point, arg_max(CAST(q AS BIGINT), (at_, line, who, q)) AS class FROM e GROUP BY 1", pts=False)
def last_edit_wins(spark, d):
    e = read(spark, d, "lineitem").where("l_returnflag = 'A'").withColumn("class", F.col("l_quantity").cast("long"))
    return catalog.last_edit_wins(e, ("l_partkey",), ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "class").withColumnRenamed("l_partkey", "point")


# Commands as rows, one for each customer k: edit k + 1 changes the points 37 (k + 1), 500 and 1000 further ones to one class.
COMMANDS = "h AS (SELECT CAST(k AS BIGINT) AS edit, k % 25 AS tile, (k * 37 + j * 500) % 1000 AS point, CAST(1 + (k + j) % 7 AS INTEGER) AS old_class, CAST(2 + k % 5 AS INTEGER) AS new_class FROM (SELECT c_custkey + 1 AS k FROM customer) a, range(3) b(j)), l AS (SELECT max(edit) AS last FROM h)"


def history(spark, d):
    """(id, tile, points, old, new): commands with lists, as the log keeps them."""
    at = "transform(sequence(0, 2), j -> (id * 37 + j * 500) % 1000)"
    ids = read(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))
    return ids.select("id", F.expr("id % 25").alias("tile"), F.expr(at).alias("points"), F.expr("transform(sequence(0, 2), j -> int(1 + (id + j) % 7))").alias("old"), F.expr("int(2 + id % 5)").alias("new"))


@query(f"WITH {COMMANDS} SELECT edit, tile, point, old_class, new_class FROM h", pts=False)
def edit_commands(spark, d):
    """Commands read back from JSON text, one row a point."""
    text = history(spark, d).select("id", F.to_json(F.struct("tile", "points", "old", "new")).alias("command"))
    back = text.select("id", F.from_json("command", "tile bigint, points array<bigint>, old array<int>, new int").alias("c")).select("id", "c.*")
    return catalog.flatten_edits(back)


@query(f"-- ctes {COMMANDS}, w AS (SELECT point, arg_max(new_class, edit) AS c FROM h GROUP BY 1) SELECT pid, coalesce(c, classification) AS classification, classification AS backup FROM pts LEFT JOIN w ON point = pid")
def reclassify(spark, d):
    """Edits laid over points that stay as they are."""
    last = catalog.last_edit_wins(catalog.flatten_edits(history(spark, d))).withColumnRenamed("point", "pid")
    return catalog.reclassify(points(spark, d), last).select("pid", "classification", "backup")


@query(f"WITH {COMMANDS} SELECT point, arg_max(new_class, edit) AS new_class FROM h, l WHERE edit <= last - 10 GROUP BY 1", pts=False)
def undo_edits(spark, d):
    """The state after ten commands were undone."""
    return catalog.last_edit_wins(catalog.undone(catalog.flatten_edits(history(spark, d)), 10))


@query(f"WITH {COMMANDS}, b AS (SELECT last + (last + 1 - edit) AS edit, tile, point, new_class AS old_class, old_class AS new_class FROM h, l WHERE edit > last - 10) SELECT edit, tile, point, old_class, new_class FROM b", pts=False)
def undo_as_commands(spark, d):
    """Undoing logged as new commands that swap the classes."""
    return catalog.undo_commands(catalog.flatten_edits(history(spark, d)), 10)


TILES = "tiles AS (SELECT tile AS id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n, CASE WHEN tile % 7 = 6 THEN 'OLD' ELSE ['IMPORTED', 'FILTERED', 'CLASSIFIED', 'EDITED', 'NOISE', 'ERROR'][1 + tile % 6] END AS status FROM pts GROUP BY 1)"


def tiles(spark, d):
    box = basic.tile_catalog(points(spark, d)).withColumnRenamed("tile", "id")
    status = F.element_at(F.array(*map(F.lit, catalog.STATUSES)), F.col("id") % 6 + 1)
    return box.withColumn("status", F.when(F.col("id") % 7 == 6, "OLD").otherwise(status))


@query(f"-- ctes {TILES} SELECT id, status, row_number() OVER (ORDER BY status, id) AS place FROM tiles")
def tile_list(spark, d):
    from pyspark.sql.window import Window

    return tiles(spark, d).select("id", "status", F.row_number().over(Window.orderBy("status", "id")).cast("long").alias("place"))


@query(f"-- ctes {TILES} SELECT id, n FROM tiles WHERE id = 7 OR status = 'FILTERED'")
def tile_lookup(spark, d):
    return tiles(spark, d).where("id = 7 OR status = 'FILTERED'").select("id", "n")


@query(f"-- ctes {TILES} SELECT s.place, s.status, count(id) AS n, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS ids FROM (SELECT CAST(i - 1 AS INTEGER) AS place, ['IMPORTED', 'FILTERED', 'CLASSIFIED', 'EDITED', 'NOISE', 'ERROR'][i] AS status FROM range(1, 7) r(i)) s LEFT JOIN tiles USING (status) GROUP BY 1, 2")
def status_groups(spark, d):
    g = catalog.status_groups(tiles(spark, d).withColumn("id", F.col("id").cast("long")))
    return g.select("place", "status", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"-- ctes {TILES} SELECT id, CASE WHEN id % 4 = 0 THEN 'REPLACED' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 0 ELSE n END AS n FROM tiles UNION ALL SELECT 100, 'REPLACED', 0")
def insert_or_replace(spark, d):
    t = tiles(spark, d).select(F.col("id").cast("long").alias("id"), "status", "n")
    new = t.where("id % 4 = 0").select("id").unionByName(spark.createDataFrame([(100,)], "id long"))
    new = new.select("id", F.lit("REPLACED").alias("status"), F.lit(0).cast("long").alias("n"))
    return catalog.insert_or_replace(t, new)


# Updates of single fields, one event a row.
EVENTS = "u AS (SELECT l_orderkey % 40 AS id, l_orderkey AS v1, l_linenumber AS v2, l_partkey AS v3, l_suppkey AS v4, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus || l_returnflag END AS status, CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END AS point_count, CASE WHEN l_linenumber % 3 = 2 THEN l_shipdate END AS seen FROM lineitem)"


@query(f"WITH {EVENTS} SELECT id, arg_max(status, (v1, v2, v3, v4)) FILTER (status IS NOT NULL) AS status, arg_max(point_count, (v1, v2, v3, v4)) FILTER (point_count IS NOT NULL) AS point_count FROM u GROUP BY 1", pts=False)
def tile_updates(spark, d):
    u = read(spark, d, "lineitem").select(
        F.expr("l_orderkey % 40").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("version"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus || l_returnflag END").alias("status"), F.expr("CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END").alias("point_count"),
    )
    return catalog.current_state(u, fields=("status", "point_count"))


@query(f"-- ctes {COMMANDS}, {TILES}, t AS (SELECT id FROM tiles WHERE id % 5 <> 0), e AS (SELECT edit FROM h WHERE tile % 5 <> 0) SELECT 'tiles' AS tab, count(*) AS n FROM t UNION ALL SELECT 'edits', count(*) FROM e UNION ALL SELECT 'times', 50")
def delete_tiles(spark, d):
    """A tile goes with its edits; its processing times stay."""
    t = tiles(spark, d).withColumn("id", F.col("id").cast("long"))
    tables = {"tiles": t, "edits": catalog.flatten_edits(history(spark, d)), "times": spark.range(50)}
    left = catalog.delete(tables, t.where("id % 5 = 0"), cascade={"tiles": "id", "edits": "tile"})
    out = [left[k].agg(F.lit(k).alias("tab"), F.count(F.lit(1)).alias("n")) for k in ("tiles", "edits", "times")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"-- ctes {TILES}, q AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'QC_PASSED' WHEN id % 3 = 1 THEN 'NEEDS_REWORK' END AS qc, CASE WHEN id % 3 = 1 THEN 'gap' END AS note FROM tiles) SELECT CAST(id AS BIGINT) AS id, qc, note FROM q WHERE qc IS NOT NULL")
def batch_qc(spark, d):
    """Two batches of quality marks; the third is cleared again by a later event with an empty mark."""
    ids = tiles(spark, d).select(F.col("id").cast("long").alias("id"))
    first = ids.select("id", F.lit(1).alias("version"), F.when(F.col("id") % 3 == 1, "NEEDS_REWORK").otherwise("QC_PASSED").alias("qc"), F.when(F.col("id") % 3 == 1, "gap").alias("note"))
    clear = ids.where("id % 3 = 2").select("id", F.lit(2).alias("version"), F.lit("").alias("qc"), F.lit(None).cast("string").alias("note"))
    return catalog.current_state(first.unionByName(clear), fields=("qc", "note")).where("qc <> ''")


@query(f"-- ctes {TILES} SELECT round(sum(n) / sum((max_x - min_x) * (max_y - min_y)), 9) AS density FROM tiles WHERE status <> 'OLD'")
def shown_density(spark, d):
    return catalog.box_density(tiles(spark, d).where("status <> 'OLD'")).select(_r("density", 9))


@query("SELECT count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 9) AS density FROM pts")
def global_bounds(spark, d):
    p = points(spark, d)
    box = p.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"])
    return box.withColumn("density", F.round(F.col("n") / ((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))), 9))


@query("-- ctes c AS (SELECT tile, line, count(*) AS n FROM pts GROUP BY 1, 2) SELECT tile, line, n, CAST(sum(n) OVER (PARTITION BY tile ORDER BY line) AS BIGINT) AS upto FROM c")
def running_counts(spark, d):
    """Points of each tile by strip, with the running total that an import reports."""
    from pyspark.sql.window import Window

    c = points(spark, d).groupBy("tile", "line").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("upto", F.sum("n").over(Window.partitionBy("tile").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


@query("-- ctes s AS (SELECT tile, CASE WHEN line % 4 = 0 THEN '' ELSE 'unit' || CAST(line % 4 AS VARCHAR) END AS scanner, count(*) AS n FROM pts GROUP BY 1, 2) SELECT tile, string_agg(scanner, ',' ORDER BY n DESC, scanner) AS scanners FROM s WHERE scanner <> '' GROUP BY 1")
def all_scanners(spark, d):
    p = points(spark, d).withColumn("scanner", F.expr("CASE WHEN line % 4 = 0 THEN '' ELSE 'unit' || CAST(line % 4 AS STRING) END"))
    return catalog.by_count(p, "tile", "scanner").select("tile", F.array_join("ranked", ",").alias("scanners"))


@query("SELECT pid, CASE line WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS sensor FROM pts")
def line_sensors(spark, d):
    return catalog.sensor_of_line(points(spark, d), {1: 2, 2: 1, 3: 2, 4: 1}).select("pid", "sensor")


@query("-- ctes l AS (SELECT DISTINCT tile, line, CASE sensor WHEN 1 THEN 'topo' ELSE 'bathy' END AS s FROM pts) SELECT tile, string_agg(CAST(line AS VARCHAR) || ' (' || s || ')', ', ' ORDER BY line) AS summary FROM l GROUP BY 1")
def line_summary(spark, d):
    return catalog.line_summary(points(spark, d))


@query("SELECT pid, x, y, z, intensity, classification, CASE classification WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 5 THEN 'High Vegetation' WHEN 6 THEN 'Building' WHEN 7 THEN 'Low Point (Noise)' END AS class_name FROM pts WHERE pid = 137")
def point_info(spark, d):
    return points(spark, d).where("pid = 137").select("pid", "x", "y", "z", "intensity", "classification", catalog.class_name(F.col("classification")).alias("class_name"))


SCANNER_SQL = r"lower(regexp_extract({0}, '(?i)(?:^|[^a-zA-Z0-9])(vq\d{{3,4}}(?:-[a-z])?[a-z]?|vux-\d+(?:-[a-z])?[a-z]?|vq-\d+(?:-[a-z])?[a-z]?|als\d+)(?:[^a-zA-Z0-9]|$)', 1))"
FILES = "f AS (SELECT CAST(i AS BIGINT) AS i, ['1 - vq820g - 210430_vq820g - points', 'vq580_flight03', 'ALS70_hd_strip_01', 'strip_x', 'vux-240_a', 'survey', 'czmil_line', 'vq-880-g_9'][1 + i % 8] AS stem, ['vq1560i', 'tiles'][1 + (i // 8) % 2] AS parent FROM (SELECT p_partkey AS i FROM part))"


@query("WITH " + FILES + ", s AS (SELECT i, CASE WHEN " + SCANNER_SQL.format("stem") + " <> '' THEN " + SCANNER_SQL.format("stem") + " ELSE " + SCANNER_SQL.format("parent") + r" END AS scanner FROM f) SELECT i, scanner, CASE WHEN regexp_matches(scanner, 'vq-?\d{3,4}-?g\b') THEN 'bathy' WHEN scanner <> '' THEN 'topo' ELSE '' END AS sensor FROM s", pts=False)
def scanner_names(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    f = read(spark, d, "part").select(F.col("p_partkey").alias("id")).select(
        F.col("id").alias("i"), pick(("1 - vq820g - 210430_vq820g - points", "vq580_flight03", "ALS70_hd_strip_01", "strip_x", "vux-240_a", "survey", "czmil_line", "vq-880-g_9"), F.col("id") % 8).alias("stem"),
        pick(("vq1560i", "tiles"), F.floor(F.col("id") / 8) % 2).alias("parent"),
    )
    f = f.withColumn("scanner", catalog.scanner_of(F.col("stem"), F.col("parent")))
    return f.select("i", "scanner", catalog.sensor_name(F.col("scanner")).alias("sensor"))


@query("SELECT n_nationkey AS code, n_name AS name FROM nation WHERE contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1') ORDER BY 1 LIMIT 5", pts=False)
def name_search(spark, d):
    """A search over a (code, name) table with a limit."""
    table = read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return catalog.search_names(table, "1", 5)


@query(f"-- ctes {TILES} SELECT crs FROM (SELECT id, CASE WHEN id % 3 = 1 THEN 'EPSG:' || CAST(32600 + id AS VARCHAR) WHEN id % 3 = 2 THEN '' END AS crs FROM tiles) WHERE crs <> '' ORDER BY id LIMIT 1")
def first_crs(spark, d):
    """The first tile's reference system that is given."""
    t = tiles(spark, d).withColumn("crs", F.expr("CASE WHEN id % 3 = 1 THEN 'EPSG:' || CAST(32600 + id AS STRING) WHEN id % 3 = 2 THEN '' END"))
    return t.where(catalog.epsg_code(F.col("crs")).isNotNull()).orderBy("id").limit(1).select("crs")


# Tiling


@query("-- ctes b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts), g AS (SELECT *, CAST(ceil((x1 - x0) / 150) AS BIGINT) AS nc, CAST(ceil((y1 - y0) / 150) AS BIGINT) AS n_rows FROM b) SELECT least(n_rows - 1, CAST(trunc((y - y0) / 150) AS BIGINT)) * nc + least(nc - 1, CAST(trunc((x - x0) / 150) AS BIGINT)) AS tile, count(*) AS n FROM pts CROSS JOIN g GROUP BY 1")
def tile_index(spark, d):
    p = points(spark, d)
    grid = tiling.grid_over(p, size=150.0)
    return p.groupBy(grid.index().alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query("-- ctes b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts), g AS (SELECT *, CAST(ceil((x1 - x0) / 130) AS BIGINT) AS nc, CAST(ceil((y1 - y0) / 130) AS BIGINT) AS nr FROM b) SELECT r * nc + c AS tile, round(x0 + c * 130, 6) AS min_x, round(y0 + r * 130, 6) AS min_y, round(least(x0 + c * 130 + 150, x1), 6) AS max_x, round(least(y0 + r * 130 + 150, y1), 6) AS max_y FROM g, range(40) a(r), range(40) b2(c) WHERE r < nr AND c < nc")
def tile_boxes(spark, d):
    grid = tiling.grid_over(points(spark, d), size=150.0, overlap=20.0)
    return grid.boxes(spark).select("tile", *[_r(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("SELECT target, greatest(50.0, round_even(sqrt(target / d) / 50, 0) * 50) AS edge FROM (SELECT unnest([20, 77, 156, 400, 900, 2500]) AS target), (SELECT count(*) / ((max(x) - min(x)) * (max(y) - min(y))) AS d FROM pts)")
def auto_tile_size(spark, d):
    box = points(spark, d).agg(F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    targets = spark.createDataFrame([(t,) for t in (20, 77, 156, 400, 900, 2500)], "target int")
    edge = F.sqrt(F.col("target") / (F.col("n") / F.col("area")))
    return targets.crossJoin(F.broadcast(box)).select("target", F.greatest(F.lit(50.0), F.bround(edge / 50.0) * 50.0).alias("edge"))


@query(f"-- ctes {TILES}, m AS (SELECT floor(min(min_x) / 12) * 12 AS x0, floor(min(min_y) / 12) * 12 AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM tiles), g AS (SELECT x0, y0, greatest(1, CAST(ceil((x1 - x0) / 12) AS BIGINT)) AS nc, greatest(1, CAST(ceil((y1 - y0) / 12) AS BIGINT)) AS nr FROM m), s AS (SELECT id, nc, nr, greatest(0, CAST(round_even((min_x - x0) / 12, 0) AS BIGINT)) AS c0, greatest(0, CAST(round_even((min_y - y0) / 12, 0) AS BIGINT)) AS r0, CAST(round_even((max_x - x0) / 12, 0) AS BIGINT) AS c, CAST(round_even((max_y - y0) / 12, 0) AS BIGINT) AS r FROM tiles CROSS JOIN g) SELECT id, c0, r0, least(nc, greatest(c0 + 1, c)) AS c1, least(nr, greatest(r0 + 1, r)) AS r1 FROM s")
def grid_slices(spark, d):
    """Each tile's part of the one raster grid over all."""
    t = tiles(spark, d)
    b = t.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    return tiling.slices(t, tiling.RasterGrid.over(*b, 12.0)).select("id", "c0", "r0", "c1", "r1")


@query("SELECT CAST(floor((x - 500) / 30) AS BIGINT) AS floored, CAST(trunc((x - 500) / 30) AS BIGINT) AS truncated, count(*) AS n FROM pts GROUP BY 1, 2")
def cell_indexes(spark, d):
    """Cells by floor and by truncation, which differ left of the origin."""
    p = points(spark, d).select((F.col("x") - 500).alias("x"))
    return p.groupBy(basic.cell("x", 30).alias("floored"), tiling.truncated_cell("x", 30).alias("truncated")).agg(F.count(F.lit(1)).alias("n"))


@query(f"-- ctes {TILES}, gcp AS (SELECT s_name AS name, (s_suppkey * 7919 % 1000) * 1.0E0 AS x, (s_suppkey * 104729 % 1000) * 1.0E0 AS y FROM supplier) SELECT id, name FROM tiles JOIN gcp ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def gcp_tiles(spark, d):
    """Control points and the tiles whose box holds them: both tables are small."""
    gcp = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.expr("(s_suppkey * 7919 % 1000) * 1.0D").alias("x"), F.expr("(s_suppkey * 104729 % 1000) * 1.0D").alias("y"))
    return tiling.in_boxes(gcp, tiles(spark, d)).select("id", "name")


@query("-- ctes c AS (SELECT tile, count(*) AS n FROM pts GROUP BY 1) SELECT tile, n, CAST(sum(n) OVER (ORDER BY tile) AS BIGINT) AS upto FROM c")
def batch_offsets(spark, d):
    return tiling.batch_offsets(points(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT tile, count(*) AS n FROM pts GROUP BY 1")
def offset_counts(spark, d):
    """Running ends turned back into sizes."""
    ends = tiling.batch_offsets(points(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))).select("tile", "upto")
    return tiling.offset_counts(ends).select("tile", "n")
