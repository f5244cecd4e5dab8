"""Noise filters, ground, terrain, bathymetry and registration over the adapter's points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import gcp, points, water
from ..operators import bathy, clean, ground, noise, pipeline, register
from .registry import query
from .registry import rounded as _r


@query("SELECT a.pid, count(*) >= 3 AS keep FROM pts a JOIN pts b ON abs(a.x - b.x) <= 25 AND abs(a.y - b.y) <= 25 AND abs(a.z - b.z) <= 25 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 625 GROUP BY 1")
def isolated_points(spark, d):
    return noise.enough_near(points(spark, d), 25, 3)


LOW_GRID = """lg AS (SELECT min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) - min(x)) / 61.37) AS BIGINT) + 1 AS nc, CAST(ceil((max(y) - min(y)) / 61.37) AS BIGINT) + 1 AS nr FROM pts),
 lc AS (SELECT CAST(floor((y - y0) / 61.37) AS BIGINT) AS row, CAST(floor((x - x0) / 61.37) AS BIGINT) AS col, min(z) AS z FROM pts CROSS JOIN lg GROUP BY 1, 2),
 f1 AS (SELECT row, col, z FROM lc UNION ALL SELECT row, col, avg(z) FROM (SELECT row + i AS row, col + j AS col, z FROM lc, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(i, j)) n, (SELECT nc, n_r FROM (SELECT nc, nr AS n_r FROM lg)) WHERE row BETWEEN 0 AND n_r - 1 AND col BETWEEN 0 AND nc - 1 AND NOT EXISTS (SELECT 1 FROM lc o WHERE o.row = n.row AND o.col = n.col) GROUP BY 1, 2)"""


@query(f"""-- ctes {LOW_GRID}, tg AS (SELECT row AS tr, col AS tc, row + i AS r, col + j AS c FROM f1, range(-1, 2) a(i), range(-1, 2) b(j)), lm AS (SELECT nc, nr AS n_r, x0, y0 FROM lg),
 mi AS (SELECT tr, tc, CASE WHEN r < 0 THEN -r - 1 WHEN r >= n_r THEN 2 * n_r - 1 - r ELSE r END AS row, CASE WHEN c < 0 THEN -c - 1 WHEN c >= nc THEN 2 * nc - 1 - c ELSE c END AS col FROM tg CROSS JOIN lm),
 md AS (SELECT tr AS row, tc AS col, quantile_cont(z, 0.5) AS z FROM mi JOIN f1 USING (row, col) GROUP BY 1, 2),
 pc AS (SELECT pid, z AS pz, (x - x0) / 61.37 AS fx, (y - y0) / 61.37 AS fy, CAST(floor((x - x0) / 61.37) AS BIGINT) AS c0, CAST(floor((y - y0) / 61.37) AS BIGINT) AS r0, nc, n_r FROM pts CROSS JOIN lm),
 pk AS (SELECT pid, pz, least(n_r - 1, r0 + i) AS row, least(nc - 1, c0 + j) AS col, (CASE WHEN i = 1 THEN fy - r0 ELSE 1 - (fy - r0) END) * (CASE WHEN j = 1 THEN fx - c0 ELSE 1 - (fx - c0) END) AS w FROM pc, range(2) a(i), range(2) b(j)),
 hh AS (SELECT pid, any_value(pz) - sum(w * coalesce(z, (SELECT quantile_cont(z, 0.5) FROM md))) AS h FROM pk LEFT JOIN md USING (row, col) GROUP BY 1)
 SELECT pid, round(h, 6) AS height, NOT (abs(h) <= 3.0003 AND abs(h) > 0.01) AS keep, NOT (h > 3.0003 AND h <= 9.0007) AS keep_band FROM hh""")
def surface_noise(spark, d):
    """Noise on either side of a smooth lowest surface, and in a band above it."""
    p = points(spark, d)
    near = clean.surface_noise(p, 61.37, 3.0003, passes=1)
    band = clean.surface_noise(p, 61.37, 3.0003, above=9.0007, passes=1).select("pid", F.col("keep").alias("keep_band"))
    return near.join(band, "pid").select("pid", _r("height"), "keep", "keep_band")


@query()
def dbscan(spark, d):
    """Clusters have no plain SQL; tests compare them with a search over all pairs."""
    return noise.dbscan(points(spark, d), 25.0, 4)


@query()
def dbscan_filter(spark, d):
    return noise.dbscan_noise(points(spark, d), 25.0, 4, 30, "above").select("pid", "keep")


@query()
def multipath(spark, d):
    return clean.multipath(points(spark, d), 60.0, 2000)


@query()
def topo_discriminator(spark, d):
    return clean.discriminate(points(spark, d), 12)


@query()
def water_ghosts(spark, d):
    return clean.water_ghosts(points(spark, d), 80.0, 0.3)


@query()
def river_corridor(spark, d):
    p = points(spark, d).withColumn("z", F.col("z") / 400.0)
    return clean.river_corridor(p, 25.0, least=3)


@query()
def benthic_continuity(spark, d):
    p = points(spark, d).withColumn("certain", F.col("z") < 5)
    return clean.bed_continuity(p, reach=25.0, slope=0.6)


PIPELINE = [{"type": "isolated", "search_radius": 25, "min_neighbors": 2}, {"type": "low_points", "search_radius": 15, "below_threshold": 60, "above_threshold": 300}, {"type": "thin_average", "grid_size": 20}]

_NEAR = "abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {r2}"


@query(f"""-- ctes s1 AS (SELECT p.* FROM pts p JOIN (SELECT a.pid FROM pts a JOIN pts b ON abs(a.x - b.x) <= 25 AND abs(a.y - b.y) <= 25 AND abs(a.z - b.z) <= 25 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 625 GROUP BY 1 HAVING count(*) >= 2) USING (pid)),
 nb AS (SELECT a.pid, min(b.z) AS lo, max(b.z) AS hi FROM s1 a JOIN s1 b ON {_NEAR.format(r=15, r2=225)} AND a.pid <> b.pid GROUP BY 1),
 s2 AS (SELECT s1.* FROM s1 LEFT JOIN nb USING (pid) WHERE NOT coalesce(z < lo - 60 OR z > hi + 300, false)),
 ce AS (SELECT floor(y / 20) AS r, floor(x / 20) AS c, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM s2 GROUP BY 1, 2)
 SELECT arg_min(pid, (round((x-cx)**2 + (y-cy)**2 + (z-cz)**2, 6), pid)) AS pid FROM s2 JOIN ce ON r = floor(y / 20) AND c = floor(x / 20) GROUP BY r, c""")
def filter_pipeline(spark, d):
    """Three steps, each on what the one before kept."""
    return pipeline.run(points(spark, d), PIPELINE).select("pid")


@query()
def headless_filter(spark, d):
    o = {"intensity_min": 0.01, "ror_radius": 40.0, "ror_min_points": 3, "sor_neighbors": 6, "sor_std_ratio": 4.0, "isolated_min_dist": 12.0, "lowpts_radius": 15.0, "lowpts_below": 200.0, "lowpts_above": 400.0, "floor_buffer": 50.0, "dtm_grid_size": 25.0, "dbscan_base_alt": 100.0, "dbscan_eps": 40.0, "dbscan_min_points": 3, "dbscan_linearity": 0.8}
    return pipeline.headless(points(spark, d), {"intensity", "ror", "sor", "isolated", "low_points", "floor", "dbscan"}, o).select("pid")


# Ground


@query()
def smrf(spark, d):
    """Openings of a tile's surface: tests compare them with analytic scenes."""
    return ground.smrf(points(spark, d), 20.0, slope=0.5, most=60.0, height=10.0, base=20.0)


@query()
def tin_densify(spark, d):
    return ground.densify(points(spark, d), 60.0, distance=15.0, angle=25.0)


LOWEST = "g AS (SELECT pid, x, y, z FROM pts WHERE classification = 2), q1 AS (SELECT a.pid, a.z, quantile_cont(b.z, 0.5) AS mid FROM (SELECT a.pid, b.pid AS q, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.pid) AS rank FROM g a JOIN g b ON a.pid <> b.pid AND abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 QUALIFY rank <= 8) n JOIN g a USING (pid) JOIN g b ON b.pid = q GROUP BY 1, 2), p1 AS (SELECT * FROM g WHERE pid NOT IN (SELECT pid FROM q1 WHERE z < mid - 30.0003))"


@query(f"-- ctes {LOWEST}, q2 AS (SELECT a.pid, a.z, quantile_cont(b.z, 0.5) AS mid FROM (SELECT a.pid, b.pid AS q, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.pid) AS rank FROM p1 a JOIN p1 b ON a.pid <> b.pid AND abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 QUALIFY rank <= 8) n JOIN p1 a USING (pid) JOIN p1 b ON b.pid = q GROUP BY 1, 2) SELECT pid FROM p1 WHERE pid NOT IN (SELECT pid FROM q2 WHERE z < mid - 30.0003)")
def low_outliers(spark, d):
    """Two passes, the second over what the first left."""
    return ground.drop_low(points(spark, d).where("classification = 2"), 8, 30.0003).select("pid")


@query("-- ctes c AS (SELECT *, quantile_cont(z, 0.05) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS p, count(*) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS n FROM pts) SELECT pid FROM c WHERE n >= 3 AND z <= p")
def alignment_ground(spark, d):
    return ground.ground_points(points(spark, d), 50).select("pid")


@query()
def ground_probability(spark, d):
    out = ground.ground_probability(points(spark, d), 12, 40.0)
    return out.select("pid", _r("probability"), "suggested")


@query()
def adaptive_spacing(spark, d):
    return spark.createDataFrame([(round(ground.spacing(points(spark, d), 2000), 6),)], "spacing double")


@query()
def ground_model(spark, d):
    return ground.ground_model(points(spark, d), 25.0, 50.0).select("tile", "row", "col", _r("z"))


@query()
def terrain_raster(spark, d):
    """Triangles of ground points, then distances, then the nearest point."""
    return ground.terrain_raster(points(spark, d).where("classification = 2"), 25.0, 40, 40).select("row", "col", _r("z"), "how")


@query()
def eigen_features(spark, d):
    e = ground.eigenvalues(points(spark, d), 12)
    return e.select("pid", _r("e0", 4), _r("e1", 4), _r("e2", 4), "n")


@query()
def cluster_linearity(spark, d):
    return ground.linearity(points(spark, d).withColumn("cluster", F.col("tile"))).select("cluster", _r("linearity"), "n")


# Bathymetry


@query("""-- ctes sn AS (SELECT pid, x, y, z, sensor, 200.0E0 AS ws, max(sensor = 2 AND tile % 2 = 0) OVER (PARTITION BY tile) AS any_bathy, sensor = 2 AND tile % 2 = 0 AS is_bathy FROM pts)
 SELECT pid, round(CASE WHEN z < ws AND (is_bathy OR NOT any_bathy) THEN ws - (ws - z) * 1.3333E0 ELSE z END, 6) AS z FROM sn""")
def snell_bathy_only(spark, d):
    """Refraction limited to a tile's bathymetric points, if it has any."""
    p = points(spark, d).withColumn("sensor", F.when((F.col("sensor") == 2) & (F.col("tile") % 2 == 0), 2).otherwise(1)).withColumn("ws", F.lit(200.0))
    return bathy.bathy_only(p, bathy.snell_nadir).select("pid", _r("z"))


WATER = "water AS (SELECT r AS row, c AS col, CASE WHEN (r * 7 + c) % 11 = 0 THEN NULL ELSE 200.0E0 + (r + c) % 7 END AS z FROM range(100) a(r), range(60) b(c))"


@query(f"-- ctes {WATER}, m AS (SELECT quantile_cont(z, 0.5) AS lvl FROM water) SELECT pid, round(CASE WHEN p.z < lvl THEN lvl - (lvl - p.z) * 1.3333E0 ELSE p.z END, 6) AS z FROM pts p CROSS JOIN m")
def snell_scalar_level(spark, d):
    """One water level, the median of the raster, for the nadir form."""
    return bathy.snell_nadir(bathy.with_level(points(spark, d), water(spark))).select("pid", _r("z"))


@query("SELECT round(quantile_cont(x, 0.5), 6) AS sx, round(quantile_cont(y, 0.5), 6) AS sy, round(quantile_cont(z, 0.5) + 1000, 6) AS sz FROM pts")
def median_sensor(spark, d):
    """Where the sensor is taken to be if times can't be used."""
    return bathy.median_position(points(spark, d).withColumn("z", F.col("z") + 1000)).select(_r("sx"), _r("sy"), _r("sz"))


@query()
def water_level_fit(spark, d):
    """A plane through the highest share of points, by seeded consensus."""
    return bathy.water_plane(points(spark, d), 0.8, 40.0).select(*[F.round(c, 4).alias(c) for c in ("a", "b", "c")], "n")


@query(f"""-- ctes {WATER}, wide AS (SELECT DISTINCT row + i AS r, col + j AS c FROM water, range(-1, 2) a(i), range(-1, 2) b(j) WHERE z IS NOT NULL AND abs(i) + abs(j) <= 1),
 p AS (SELECT pid, x, y, z, tile, sensor, CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c FROM pts),
 k AS (SELECT p.*, w.z AS ws, p.sensor <> 2 OR (v.r IS NOT NULL AND (w.z IS NULL OR p.z <= w.z + 0.5)) AS keep FROM p LEFT JOIN wide v USING (r, c) LEFT JOIN water w ON w.row = p.r AND w.col = p.c)
 SELECT pid, round(CASE WHEN sensor = 2 AND z < coalesce(ws, -1e9) THEN ws - (ws - z) * 1.3333E0 ELSE z END, 6) AS z FROM k WHERE keep""")
def bathy_chain(spark, d):
    """Crop to the water, then refraction, of bathymetric points; others pass."""
    steps = [{"type": "ws_crop", "tolerance": 0.5, "steps": 1}, {"type": "snells", "mode": "nadir"}]
    return bathy.chain(points(spark, d), water(spark), 10, steps).select("pid", _r("z"))


# Registration


MATCH = "mt AS (SELECT pid, x AS sx, y AS sy, z AS sz, 1.0005 * (x * cos(0.1) - y * sin(0.1)) + 100 + (pid % 7) * 0.01 AS tx, 1.0005 * (x * sin(0.1) + y * cos(0.1)) - 50 AS ty, 1.0005 * z + 3 AS tz FROM pts WHERE pid % 100 = 0)"


def matches(spark, d):
    return points(spark, d).where("pid % 100 = 0").select(
        "pid", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"),
        F.expr("1.0005D * (x * cos(0.1D) - y * sin(0.1D)) + 100 + (pid % 7) * 0.01D").alias("tx"), F.expr("1.0005D * (x * sin(0.1D) + y * cos(0.1D)) - 50").alias("ty"), F.expr("1.0005D * z + 3").alias("tz"),
    )


@query()
def helmert_residuals(spark, d):
    """Scale, rotation and shift from pairs, and what is left of each pair."""
    own = matches(spark, d)
    return register.residuals(own, register.apply_helmert(own, register.estimate_helmert(own))).select("pid", _r("residual", 4))


@query()
def affine_estimate(spark, d):
    own = matches(spark, d)
    m = register.estimate_affine(own)
    return spark.createDataFrame([(i, j, round(float(v), 4)) for i, row in enumerate(m.tolist()) for j, v in enumerate(row)], "row int, col int, value double")


@query("-- ctes r AS (SELECT sqrt((x - floor(x))**2 + (y - floor(y))**2) AS e FROM pts) SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.68), 6) AS p68, round(quantile_cont(e, 0.95), 6) AS p95, round(quantile_cont(e, 0.99), 6) AS p99, round(max(e), 6) AS most FROM r")
def residual_stats(spark, d):
    e = points(spark, d).select(F.sqrt((F.col("x") - F.floor("x")) ** 2 + (F.col("y") - F.floor("y")) ** 2).alias("residual"))
    return register.residual_stats(e).select(*[_r(c) for c in ("rmse", "p68", "p95", "p99", "most")])


@query("SELECT pid, round(x + 1.5, 6) AS x, round(y - 2.25, 6) AS y, round(z + 0.5, 6) AS z FROM pts")
def xyz_shift(spark, d):
    return register.shift(points(spark, d), 1.5, -2.25, 0.5).select("pid", _r("x"), _r("y"), _r("z"))


@query("SELECT pid, round(1.0002E0 * (x * cos(0.05) - y * sin(0.05)) + 12, 6) AS x, round(1.0002E0 * (x * sin(0.05) + y * cos(0.05)) - 7, 6) AS y FROM pts")
def helmert_apply(spark, d):
    import math

    import numpy as np

    c, s = math.cos(0.05), math.sin(0.05)
    moved = register.apply_helmert(points(spark, d).selectExpr("pid", "x AS sx", "y AS sy", "0.0D AS sz"), (1.0002, np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), np.array([12.0, -7.0, 0.0])))
    return moved.select("pid", F.round("mx", 6).alias("x"), F.round("my", 6).alias("y"))


ROOFS = "rf AS (SELECT tile, avg(z) AS dz, stddev_pop(x) / 1000 AS dx, stddev_pop(y) / 1000 AS dy FROM pts GROUP BY 1)"


@query(f"-- ctes {ROOFS} SELECT round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, round(avg(dz), 6) AS dz, round(quantile_cont(sqrt(dx*dx + dy*dy + dz*dz), 0.5), 6) AS median, round(avg(sqrt(dx*dx + dy*dy + dz*dz)), 6) AS mean FROM rf")
def roof_summary(spark, d):
    shifts = points(spark, d).groupBy("tile").agg(F.avg("z").alias("dz"), (F.stddev_pop("x") / 1000).alias("dx"), (F.stddev_pop("y") / 1000).alias("dy"))
    return register.roof_summary(shifts).select(*[_r(c) for c in ("dx", "dy", "dz", "median", "mean")])


@query()
def roof_shifts(spark, d):
    """Shifts of roof planes along their normals, by seeded consensus of the points near each."""
    corners = gcp(spark, d).where("name is not null").select(F.col("name").alias("surface"), "x", "y", "z")
    own = corners.select("surface", F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (F.col("z") % 50).alias("z")) for i, j in ((0, 0), (40, 0), (40, 40), (0, 40))])).alias("v")).select("surface", "v.*")
    return register.roof_shifts(own, points(spark, d), 60.0, 30.0).select("surface", F.round("offset", 4).alias("offset"), "n")


@query()
def icp(spark, d):
    """Point-to-plane alignment of a shifted copy of all points, until it no longer gets better."""
    p = points(spark, d).select("pid", "x", "y", "z")
    moved = register.shift(p, 0.5, -0.3, 0.2)
    m, rms = register.icp(moved, p, reach=60.0)
    return spark.createDataFrame([(i, j, round(float(v), 3)) for i, row in enumerate(m.tolist()) for j, v in enumerate(row)], "row int, col int, value double")


@query("SELECT pid, round(500000 + x, 3) AS e0 FROM pts WHERE pid % 50 = 0")
def utm_round_trip(spark, d):
    """Eastings to longitude and latitude and back."""
    p = points(spark, d).where("pid % 50 = 0").select("pid", (F.col("x") + 500000).alias("x"), (F.col("y") + 5400000).alias("y"))
    there = register.transform(p, 32633, 4326)
    return register.transform(there, 4326, 32633).select("pid", F.round("x", 3).alias("e0"))


# Degrees about central Europe, from the plane.
DEGREES = "g AS (SELECT pid, 5 + x / 100 AS lon, 45 + y / 100 AS lat, z FROM pts), r AS (SELECT pid, z, radians(lon) AS lam, radians(lat) AS phi, 0.0818191908426214957 AS e FROM g), p AS (SELECT *, atanh(sin(phi)) - e * atanh(e * sin(phi)) AS psi FROM r)"


def degrees(spark, d):
    return points(spark, d).select("pid", (5 + F.col("x") / 100).alias("x"), (45 + F.col("y") / 100).alias("y"), "z")


@query(f"-- ctes {DEGREES} SELECT pid, round(6378137.0 * lam, 3) AS x, round(6378137.0 * psi, 3) AS y FROM p")
def mercator(spark, d):
    return register.transform(degrees(spark, d), 4326, 3395).select("pid", _r("x", 3), _r("y", 3))


_PARALLEL = "cos(radians({0})) / sqrt(1 - (e * sin(radians({0})))**2)"
_PSI = "(atanh(sin(radians({0}))) - e * atanh(e * sin(radians({0}))))"


@query(f"""-- ctes {DEGREES.replace("0.0818191908426214957", "sqrt((2 - 1 / 298.257222101E0) / 298.257222101E0)")}, n AS (SELECT *, (ln({_PARALLEL.format(49)}) - ln({_PARALLEL.format(44)})) / ({_PSI.format(44)} - {_PSI.format(49)}) AS n FROM p),
 s AS (SELECT *, 6378137.0 * ({_PARALLEL.format(49)}) / n * exp(n * {_PSI.format(49)}) AS size FROM n), c AS (SELECT *, size * exp(-n * psi) AS rho, size * exp(-n * {_PSI.format(46.5)}) AS base, n * (lam - radians(3)) AS turn FROM s)
 SELECT pid, round(700000 + rho * sin(turn), 2) AS x, round(6600000 + base - rho * cos(turn), 2) AS y FROM c""")
def conic(spark, d):
    """A cone through two parallels."""
    return register.transform(degrees(spark, d), 4326, 2154).select("pid", _r("x", 2), _r("y", 2))


@query(f"-- ctes {DEGREES}, s AS (SELECT *, 6378137.0 * ({_PARALLEL.format(71)}) * exp({_PSI.format(71)}) * exp(-psi) AS rho FROM p) SELECT pid, round(rho * sin(lam), 3) AS x, round(-rho * cos(lam), 3) AS y FROM s")
def polar(spark, d):
    return register.transform(degrees(spark, d), 4326, 3995).select("pid", _r("x", 3), _r("y", 3))


_GRID = 'PROJCS["grid",GEOGCS["old",DATUM["old",SPHEROID["Bessel 1841",6377397.155,299.1528128],TOWGS84[598.1,73.7,418.2,0.202,0.045,-2.455,6.7]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["central_meridian",9],PARAMETER["scale_factor",1],PARAMETER["false_easting",3500000],UNIT["metre",1]]'


@query("SELECT pid, round(3500000 + x, 3) AS x, round(5400000 + y, 3) AS y, round(z, 3) AS z, true AS moved FROM pts")
def datum_round_trip(spark, d):
    """An old grid given as text, on a shifted datum, taken to longitude and latitude of the common one and back."""
    own = points(spark, d).select("pid", (F.col("x") + 3500000).alias("x"), (F.col("y") + 5400000).alias("y"), "z")
    there = register.transform(own, _GRID, 4326)
    back = register.transform(there.withColumn("h", F.col("z")), 4326, _GRID)
    return back.select("pid", _r("x", 3), _r("y", 3), _r("z", 3), (F.abs(F.col("h") - F.col("z")) > 1).alias("moved"))
