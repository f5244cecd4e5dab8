"""Grids, rasters and interpolation over the adapter's points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..adapter import points
from ..cells import knn_join
from ..functions import arrays
from ..operators import basic, catalog, selection, surface
from .registry import query
from .registry import rounded as _r

# Least heights of 40 m cells with every eleventh missing.
GRID = "g0 AS (SELECT CAST(floor(y / 40) AS BIGINT) AS row, CAST(floor(x / 40) AS BIGINT) AS col, min(z) AS z FROM pts GROUP BY 1, 2), gr AS (SELECT * FROM g0 WHERE (row * 7 + col) % 11 <> 0)"
SIZE, N = 40.0, 25


def grid(spark, d):
    means = basic.grid(points(spark, d), SIZE, z=F.min("z"))
    return means.where("(row * 7 + col) % 11 <> 0")


CORNERS = "kc AS (SELECT pid, x, y, z, (x - 0.0123) / 40 AS fx, (y - 0.0457) / 40 AS fy, greatest(0, least(24, CAST(floor((x - 0.0123) / 40) AS BIGINT))) AS c0, greatest(0, least(24, CAST(floor((y - 0.0457) / 40) AS BIGINT))) AS r0 FROM pts), k4 AS (SELECT *, least(24, r0 + i) AS r, least(24, c0 + j) AS c, (CASE WHEN i = 1 THEN fy - r0 ELSE 1 - (fy - r0) END) * (CASE WHEN j = 1 THEN fx - c0 ELSE 1 - (fx - c0) END) AS w FROM kc, range(2) a(i), range(2) b(j))"
BILINEAR = f"{GRID}, {CORNERS}, md AS (SELECT quantile_cont(z, 0.5) AS m FROM gr), sf AS (SELECT pid, any_value(k4.z) AS z, sum(w * coalesce(gr.z, m)) AS s FROM k4 CROSS JOIN md LEFT JOIN gr ON row = r AND col = c GROUP BY 1)"


@query(f"-- ctes {BILINEAR} SELECT pid, round(s, 6) AS surface FROM sf")
def bilinear_lookup(spark, d):
    out = surface.bilinear(points(spark, d).select("pid", "x", "y"), grid(spark, d), SIZE, N, N, 0.0123, 0.0457)
    return out.select("pid", _r("surface"))


@query(f"-- ctes {BILINEAR} SELECT pid, round(greatest(0.0, least(100.0, z - s)), 6) AS hag FROM sf")
def height_above_ground(spark, d):
    out = surface.bilinear(points(spark, d).select("pid", "x", "y", "z"), grid(spark, d), SIZE, N, N, 0.0123, 0.0457)
    return out.select("pid", F.round(arrays.height_above_ground(F.col("z"), F.col("surface")), 6).alias("hag"))


NODES = "nd AS (SELECT a.i AS row, b.j AS col, CASE WHEN (a.i * 5 + b.j) % 13 = 0 THEN NULL ELSE (a.i * a.i % 17) + b.j * 0.5E0 END AS z FROM range(21) a(i), range(21) b(j))"
MEANS = "nd AS (SELECT CAST(floor(y / 45) AS BIGINT) AS row, CAST(floor(x / 45) AS BIGINT) AS col, round(avg(z), 6) AS z FROM pts GROUP BY 1, 2)"
LOOKUP = "q AS (SELECT {k} AS k, {x} / 45 AS fx, {y} / 45 AS fy FROM {t}), q2 AS (SELECT *, greatest(0, least(19, CAST(ceil(fx) AS BIGINT) - 1)) AS c0, greatest(0, least(19, CAST(ceil(fy) AS BIGINT) - 1)) AS r0 FROM q WHERE fx BETWEEN 0 AND 20 AND fy BETWEEN 0 AND 20), q4 AS (SELECT k, r0 + i AS r, c0 + j AS c, (CASE WHEN i = 1 THEN fy - r0 ELSE 1 - (fy - r0) END) * (CASE WHEN j = 1 THEN fx - c0 ELSE 1 - (fx - c0) END) AS w FROM q2, range(2) a(i), range(2) b(j)), el AS (SELECT k, sum(w * z) AS e FROM q4 JOIN nd ON row = r AND col = c WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) = 4)"


def nodes(spark):
    cells = spark.range(21).select(F.col("id").alias("row")).crossJoin(spark.range(21).select(F.col("id").alias("col")))
    return cells.withColumn("z", F.expr("CASE WHEN (row * 5 + col) % 13 = 0 THEN NULL ELSE (row * row % 17) + col * 0.5D END"))


@query(f"-- ctes {NODES}, {LOOKUP.format(k='pid', x='x', y='y', t='pts')} SELECT pid, round(e, 5) AS elevation FROM pts LEFT JOIN el ON k = pid")
def dtm_lookup(spark, d):
    return surface.dtm_lookup(points(spark, d).select("pid", "x", "y"), nodes(spark), 45.0, 21, 21).select("pid", _r("elevation", 5))


@query(f"-- ctes {MEANS}, line AS (SELECT i, 50 + i / 199 * 900.0E0 AS px, 20 + i / 199 * 700.0E0 AS py FROM range(200) r(i)), {LOOKUP.format(k='i', x='px', y='py', t='line')} SELECT i, round(i / 199 * sqrt(900.0E0 * 900 + 700.0E0 * 700), 5) AS distance, round(e, 4) AS elevation FROM line LEFT JOIN el ON k = i")
def dtm_profile(spark, d):
    """200 samples along a line over a terrain of mean heights."""
    means = points(spark, d).groupBy(F.floor(F.col("y") / 45).cast("long").alias("row"), F.floor(F.col("x") / 45).cast("long").alias("col")).agg(F.round(F.avg("z"), 6).alias("z"))
    out = surface.dtm_profile(spark, means, 45.0, 21, 21, (50.0, 20.0), (950.0, 720.0))
    return out.select("i", _r("distance", 5), _r("elevation", 4))


def _fill_sql(passes: int) -> str:
    ctes, last = [GRID, "f0 AS (SELECT row, col, z FROM gr)"], "f0"
    for k in range(1, passes + 1):
        near = " UNION ALL ".join(f"SELECT row + {i} AS row, col + {j} AS col, z FROM {last}" for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        ctes.append(f"f{k} AS (SELECT row, col, z FROM {last} UNION ALL SELECT row, col, avg(z) AS z FROM ({near}) n WHERE row BETWEEN 0 AND 24 AND col BETWEEN 0 AND 24 AND NOT EXISTS (SELECT 1 FROM {last} o WHERE o.row = n.row AND o.col = n.col) GROUP BY 1, 2)")
        last = f"f{k}"
    return ", ".join(ctes)


FILLED = _fill_sql(2)


@query(f"-- ctes {FILLED} SELECT row, col, round(z, 9) AS z FROM f2")
def grid_fill(spark, d):
    return surface.fill_holes(grid(spark, d), N, N, 2).select("row", "col", _r("z", 9))


MIRROR = "CASE WHEN {0} < 0 THEN -{0} - 1 WHEN {0} >= 25 THEN 49 - {0} ELSE {0} END"


@query(f"-- ctes {FILLED}, t AS (SELECT row AS tr, col AS tc, row + i AS r, col + j AS c FROM f2, range(-1, 2) a(i), range(-1, 2) b(j)), u AS (SELECT tr, tc, {MIRROR.format('r')} AS row, {MIRROR.format('c')} AS col FROM t) SELECT tr AS row, tc AS col, round(quantile_cont(z, 0.5), 9) AS z FROM u JOIN f2 USING (row, col) GROUP BY 1, 2")
def grid_median(spark, d):
    return surface.median3(surface.fill_holes(grid(spark, d), N, N, 2), N, N).select("row", "col", _r("z", 9))


@query(f"-- ctes {GRID} SELECT a.row, a.col, round(min(b.z), 9) AS eroded, round(max(b.z), 9) AS dilated FROM gr a JOIN gr b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2")
def grid_extremes(spark, d):
    g = grid(spark, d)
    low, high = surface.extremes3(g, "erode").withColumnRenamed("z", "eroded"), surface.extremes3(g, "dilate").withColumnRenamed("z", "dilated")
    return low.join(high, ["row", "col"]).select("row", "col", _r("eroded", 9), _r("dilated", 9))


IDW = "nr AS (SELECT t.id, k.z, sqrt((t.x - k.x)**2 + (t.y - k.y)**2) AS dist, row_number() OVER (PARTITION BY t.id ORDER BY (t.x - k.x)**2 + (t.y - k.y)**2, k.pid) AS rank FROM tg t JOIN kn k ON abs(t.x - k.x) <= {m} AND abs(t.y - k.y) <= {m} QUALIFY rank <= 12), iw AS (SELECT id, sum(z / (dist * dist + 1e-12)) / sum(1 / (dist * dist + 1e-12)) AS z FROM nr WHERE dist < {m} GROUP BY 1)"


@query("-- ctes tg AS (SELECT pid AS id, x, y FROM pts WHERE pid % 20 = 0), kn AS (SELECT pid, x, y, z FROM pts WHERE classification = 2), " + IDW.format(m=60) + " SELECT id, round(z, 5) AS z FROM iw")
def idw_fill(spark, d):
    p = points(spark, d)
    targets = p.where("pid % 20 = 0").select(F.col("pid").alias("id"), "x", "y")
    return surface.idw(targets, p.where("classification = 2").select("pid", "x", "y", "z"), most=60.0, key="id").select("id", _r("z", 5))


@query("-- ctes p AS (SELECT *, CAST(floor(y / 8) AS BIGINT) AS row, CAST(floor(x / 8) AS BIGINT) AS col FROM pts WHERE classification IN (2,3,4,5,6)), tp AS (SELECT row, col, max(z) AS z, arg_min(x, pid) AS fx, arg_min(y, pid) AS fy, arg_min(p.z, pid) AS fz FROM p WHERE row BETWEEN 0 AND 124 AND col BETWEEN 0 AND 124 GROUP BY 1, 2), tg AS (SELECT i AS id, (i % 125 + 0.5) * 8 AS x, (i // 125 + 0.5) * 8 AS y FROM range(15625) r(i) WHERE NOT EXISTS (SELECT 1 FROM tp WHERE row = i // 125 AND col = i % 125)), kn AS (SELECT row * 125 + col AS pid, fx AS x, fy AS y, fz AS z FROM tp), " + IDW.format(m=24) + " SELECT row, col, round(z, 5) AS z, false AS filled FROM tp UNION ALL SELECT id // 125, id % 125, round(z, 5), true FROM iw")
def dsm_filled(spark, d):
    own = points(spark, d).where(F.col("classification").isin(*basic.SURFACE_CLASSES))
    return surface.dsm_filled(own, 8.0, 125, 125).select("row", "col", _r("z", 5), "filled")


SIDES = "sd AS (SELECT a.row, a.col, any_value(a.z) AS z, max(CASE WHEN b.col = a.col + 1 THEN b.z END) AS e, max(CASE WHEN b.col = a.col - 1 THEN b.z END) AS w, max(CASE WHEN b.row = a.row + 1 THEN b.z END) AS n, max(CASE WHEN b.row = a.row - 1 THEN b.z END) AS s FROM f2 a LEFT JOIN f2 b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2)"
DIFF = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN ({0} - {1}) / 80.0E0 WHEN {0} IS NOT NULL THEN ({0} - z) / 40.0E0 ELSE (z - {1}) / 40.0E0 END"


@query(f"-- ctes {FILLED}, {SIDES}, dd AS (SELECT row, col, {DIFF.format('e', 'w')} AS dx, {DIFF.format('n', 's')} AS dy FROM sd), ss AS (SELECT *, atan(sqrt(dx * dx + dy * dy)) AS st, CASE WHEN atan2(dy, -dx) < 0 THEN atan2(dy, -dx) + 2 * pi() ELSE atan2(dy, -dx) END AS asp FROM dd) SELECT row, col, round(greatest(0, least(1, cos(pi() / 4) * cos(st) + sin(pi() / 4) * sin(st) * cos(radians(315.0) - asp))), 5) AS shade FROM ss")
def preview_shade(spark, d):
    return surface.preview_shade(surface.fill_holes(grid(spark, d), N, N, 2), SIZE, N, N).select("row", "col", _r("shade", 5))


# Views and block scores


def _camera():
    import numpy as np

    eye, center, up = np.array([500.0, 500.0, 100.0]), np.array([300.0, 200.0, 50.0]), np.array([0.0, 0.0, 1.0])
    axis = (eye - center) / np.linalg.norm(eye - center)
    right = np.cross(axis, up)
    right = right / (np.linalg.norm(right) + 1e-12)
    above = np.cross(right, axis)
    above = above / (np.linalg.norm(above) + 1e-12)
    along = lambda v: " + ".join(f"({c} - {e!r}) * {float(w)!r}" for c, e, w in zip("xyz", map(float, eye), v))
    half_h = math.tan(math.radians(22.5))
    return f"cm AS (SELECT pid, {along(axis)} AS t, {along(right)} AS r, {along(above)} AS u FROM pts), sc AS (SELECT pid, t > 0.01 AS front, (CASE WHEN t > 0.01 THEN r / t ELSE 0.0 END / {half_h * 800 / 600!r} * 0.5 + 0.5) * 800 AS sx, (0.5 - CASE WHEN t > 0.01 THEN u / t ELSE 0.0 END / {half_h!r} * 0.5) * 600 AS sy FROM cm)"


def on_screen(spark, d):
    sx, sy, front = arrays.project((500.0, 500.0, 100.0), (300.0, 200.0, 50.0), (0.0, 0.0, 1.0), 45.0, 800, 600)
    return points(spark, d).select("pid", sx.alias("screen_x"), sy.alias("screen_y"), front.alias("front"))


@query(f"-- ctes {_camera()} SELECT pid, front, round(sx, 4) AS screen_x, round(sy, 4) AS screen_y FROM sc")
def screen_projection(spark, d):
    return on_screen(spark, d).select("pid", "front", _r("screen_x", 4), _r("screen_y", 4))


@query("-- ctes s AS (SELECT pid, x * 0.8 AS screen_x, y * 0.6 AS screen_y FROM pts) SELECT pid, round(sqrt((screen_x - 400)**2 + (screen_y - 300)**2), 6) AS pixels FROM s WHERE sqrt((screen_x - 400)**2 + (screen_y - 300)**2) <= 20 ORDER BY sqrt((screen_x - 400)**2 + (screen_y - 300)**2), pid LIMIT 1")
def screen_pick(spark, d):
    """The point nearest to a click on a view from above."""
    seen = points(spark, d).select("pid", (F.col("x") * 0.8).alias("screen_x"), (F.col("y") * 0.6).alias("screen_y"))
    return selection.pick_screen(seen, 400.0, 300.0).select("pid", _r("pixels"))


@query("SELECT pid, round(greatest(0.01, least(1.0, (1 - greatest(abs(x % 50 - 25), abs(y % 50 - 25)) / 25)**2)), 6) AS weight, round(greatest(0.0, least(1.0, intensity / 4000.0)), 6) AS strength FROM pts")
def block_weights(spark, d):
    """How much a point counts in its block, and its scaled intensity."""
    w = arrays.blend_weight(F.expr("x % 50 - 25"), F.expr("y % 50 - 25"), 25.0)
    return points(spark, d).select("pid", F.round(w, 6).alias("weight"), F.round(arrays.normalized(F.col("intensity"), F.lit(4000.0)), 6).alias("strength"))


COLORS = {1: (0.8, 0.8, 0.8), 2: (0.55, 0.27, 0.07), 5: (0.2, 1.0, 0.2), 6: (0.8, 0.2, 0.2)}


@query("-- ctes m AS (SELECT min(z) AS lo, max(z) AS hi FROM pts), t AS (SELECT pid, classification, (z - lo) / (hi - lo) * 2 AS t FROM pts CROSS JOIN m), u AS (SELECT *, least(floor(t), 1) AS f FROM t) SELECT pid, round(CASE WHEN f = 0 THEN 0.0 + t * 0.5 ELSE 0.5 + (t - 1) * 0.5 END, 6) AS red, round(CASE WHEN f = 0 THEN t ELSE 1 - (t - 1) END, 6) AS green, CASE classification WHEN 1 THEN 0.8 WHEN 2 THEN 0.07 WHEN 5 THEN 0.2 WHEN 6 THEN 0.2 ELSE 0.0 END AS class_blue FROM u")
def colors(spark, d):
    """A height ramp over three stops, and class colours with black for the rest."""
    p = points(spark, d)
    m = p.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    rgb = arrays.ramp(F.col("z"), F.col("lo"), F.col("hi"), [(0.0, 0.0, 1.0), (0.5, 1.0, 0.5), (1.0, 0.0, 0.0)])
    out = p.crossJoin(F.broadcast(m)).withColumns({"rgb": rgb, "own": arrays.class_color(F.col("classification"), COLORS)})
    return out.select("pid", F.round(F.col("rgb")[0], 6).alias("red"), F.round(F.col("rgb")[1], 6).alias("green"), F.col("own")[2].alias("class_blue"))


# Refinement of predicted classes


KNN3 = "nn AS (SELECT a.pid, a.z, a.classification AS c, b.classification AS bc, b.z AS bz, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), (a.pid <> b.pid), b.pid) AS rank FROM {t} a JOIN {t} b ON abs(a.x - b.x) <= 250 AND abs(a.y - b.y) <= 250 AND abs(a.z - b.z) <= 300 QUALIFY rank <= {k})"


@query("-- ctes " + KNN3.format(t="pts", k=8) + ", v AS (SELECT pid, bc, count(*) AS n FROM nn WHERE abs(bz - z) < 20 GROUP BY 1, 2) SELECT pid, arg_min(bc, (-n, bc)) AS label FROM v GROUP BY 1")
def smoothed_classes(spark, d):
    from ..operators import inference

    return inference.smooth(points(spark, d).select("pid", "x", "y", "z", F.col("classification").alias("label")), 8, 20.0).select("pid", "label")


BLEED = "bl AS (SELECT pid, x, y, z, z - 60 AS h, CASE classification WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 7 ELSE 3 END AS c FROM pts), b1 AS (SELECT * REPLACE (CASE WHEN c = 0 AND h > 1.5 THEN 7 ELSE c END AS c) FROM bl), b2 AS (SELECT * REPLACE (CASE WHEN c = 7 AND h < 0.15 THEN 0 ELSE c END AS c) FROM b1)"


def predicted(spark, d):
    label = F.expr("CASE classification WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 7 ELSE 3 END")
    return points(spark, d).select("pid", "x", "y", "z", (F.col("z") - 60).alias("hag"), label.alias("label"))


@query(f"-- ctes {BLEED} SELECT pid, c AS label FROM b2")
def ground_bleed(spark, d):
    from ..operators import inference

    return inference.fix_bleed(predicted(spark, d)).select("pid", "label")


CONFUSED = "tt AS (SELECT pid, x, y, z, h, c AS classification FROM {src} WHERE c IN (1, 7)), " + KNN3.format(t="tt", k=5) + ", cn AS (SELECT pid, count(*) FILTER (bc = 1) AS veg, count(*) FILTER (bc = 7) AS bld FROM nn GROUP BY 1), fx AS (SELECT s.pid, CASE WHEN c = 1 AND h > 2.0 AND bld > 3.0 THEN 7 WHEN c = 7 AND veg > 3.0 THEN 1 ELSE c END AS label FROM {src} s LEFT JOIN cn USING (pid))"


@query(f"-- ctes {BLEED}, {CONFUSED.format(src='b2')} SELECT pid, label FROM fx")
def refined_classes(spark, d):
    """Ground and buildings told apart by height, then vegetation and buildings by their neighbours."""
    from ..operators import inference

    return inference.refine(predicted(spark, d), k=5, share=0.6).select("pid", "label")


@query("SELECT pid, [2, 5, 20, 20, 14, 19, 15, 6][pid % 8 + 1] AS code FROM pts WHERE pid % 9 <> 0 UNION ALL SELECT pid, 7 FROM pts WHERE pid % 9 = 0")
def standard_codes(spark, d):
    """Model classes as standard codes; dropped points are noise."""
    from ..operators import inference

    own = points(spark, d).select("pid", F.when(F.col("pid") % 9 != 0, (F.col("pid") % 8).cast("int")).alias("label"))
    return inference.to_standard(own).select("pid", "code")


@query("-- ctes bk AS (SELECT pid, x, y, z, bx, by_ FROM (SELECT pid, x - x0 AS x, y - y0 AS y, z, floor((x - x0) / 25) AS cx, floor((y - y0) / 25) AS cy, nx, ny FROM pts CROSS JOIN (SELECT min(x) AS x0, min(y) AS y0, ceil((max(x) - min(x)) / 25) AS nx, ceil((max(y) - min(y)) / 25) AS ny FROM pts)), range(2) a(i), range(2) b(j), LATERAL (SELECT cx - i AS bx, cy - j AS by_) WHERE bx >= 0 AND by_ >= 0 AND bx < nx AND by_ < ny), ok AS (SELECT bx, by_ FROM bk GROUP BY 1, 2 HAVING count(*) >= 10), lp AS (SELECT pid, c, greatest(0.01, least(1.0, (1 - greatest(abs(x - bx * 25 - 25), abs(y - by_ * 25 - 25)) / 25)**2)) * ((c + 1) * (1 + pid % 3)) / (CASE pid % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 18 END) AS v FROM bk JOIN ok USING (bx, by_), range(3) r(c)), sm AS (SELECT pid, c, sum(v) AS v FROM lp GROUP BY 1, 2) SELECT pid, round(max(v), 6) AS top, CAST(arg_max(c, (round(v, 9), -c)) AS INTEGER) AS label FROM sm GROUP BY 1")
def block_inference(spark, d):
    """Overlapping blocks scored by a plain function and blended; small blocks are skipped."""
    from ..operators import inference

    def model(table):
        import numpy as np

        p = table["pid"].to_numpy() % 3 + 1
        scores = np.outer(p, [1.0, 2.0, 3.0])
        return scores / scores.sum(axis=1, keepdims=True)

    out = inference.predict_blocks(points(spark, d).select("pid", "x", "y", "z"), model, 3)
    return out.select("pid", F.round(F.array_max("votes"), 6).alias("top"), "label")


@query("SELECT count(*) AS n, round(sum(x), 4) AS x FROM (SELECT CAST(floor(x / 15) AS BIGINT) AS a, CAST(floor(y / 15) AS BIGINT) AS b, CAST(floor(z / 15) AS BIGINT) AS c, avg(x) AS x FROM pts GROUP BY 1, 2, 3)")
def density_normalized(spark, d):
    from ..operators import inference

    return inference.normalize_density(points(spark, d), "voxel", 15.0).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x"))


@query("-- ctes g AS (SELECT pid, x, y, z FROM pts WHERE classification = 2), n AS (SELECT a.pid, b.pid AS q, b.z AS gz, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.pid) AS rank FROM pts a JOIN g b ON abs(a.x - b.x) <= 500 AND abs(a.y - b.y) <= 500 WHERE a.classification <> 2 QUALIFY rank <= 3) SELECT pid, CAST(rank AS INTEGER) AS rank, q AS ground FROM n")
def ground_neighbours(spark, d):
    p = points(spark, d).select("pid", "x", "y", "z", "classification")
    near = knn_join(p.where("classification <> 2").select("pid", "x", "y"), p.where("classification = 2").select("pid", "x", "y", "z"), 3, self_join=False)
    return near.select("pid", "rank", F.col("n_pid").alias("ground"))


@query("-- ctes t AS (SELECT pid, x, y, z FROM pts WHERE pid % 5 = 0), n AS (SELECT a.pid, b.pid AS q, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid) AS rank FROM pts a JOIN t b ON abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 AND abs(a.z - b.z) <= 300 QUALIFY rank <= 1) SELECT pid, q AS nearest FROM n")
def nearest_thinned(spark, d):
    """The nearest point of a thinned cloud."""
    p = points(spark, d).select("pid", "x", "y", "z")

    def nearest(rows, i, near, j, d2):
        import pyarrow as pa

        return pa.table({"pid": rows["pid"], "nearest": near["n_pid"].take(j)})

    return knn_join(p, p.where("pid % 5 = 0"), 1, dims=("x", "y", "z"), self_join=False, reduce_to=(nearest, "pid long, nearest long"))
