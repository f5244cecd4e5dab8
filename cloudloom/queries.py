"""The queries of the point-cloud operators and, side by side, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import gcp, points, water
from .cells import knn_join
from .operators import basic, bathy, noise, register
from .plans.registry import QUERIES, SQL, query
from .plans.registry import rounded as _r
from .ranges import placed

# Grids and tiles


@query("SELECT CAST(floor(y / 10) AS BIGINT) AS row, CAST(floor(x / 10) AS BIGINT) AS col, max(z) AS z FROM pts WHERE classification IN (2,3,4,5,6) GROUP BY 1, 2")
def dsm_max_z(spark: SparkSession, d: str) -> DataFrame:
    return basic.dsm(points(spark, d), 10)


@query("SELECT CAST(floor(y / 25) AS BIGINT) AS row, CAST(floor(x / 25) AS BIGINT) AS col, min(z) AS z FROM pts GROUP BY 1, 2")
def min_z_grid(spark, d):
    return basic.grid(points(spark, d), 25, z=F.min("z"))


@query("SELECT CAST(floor(y / 25) AS BIGINT) AS row, CAST(floor(x / 25) AS BIGINT) AS col, round(avg(z), 6) AS z, count(*) AS n FROM pts GROUP BY 1, 2")
def mean_z_grid(spark, d):
    return basic.grid(points(spark, d), 25, z=F.round(F.avg("z"), 6), n=F.count(F.lit(1)))


@query("SELECT CAST(floor(y / 50) AS BIGINT) AS row, CAST(floor(x / 50) AS BIGINT) AS col, round(quantile_cont(z, 0.05), 6) AS z FROM pts GROUP BY 1, 2")
def percentile_grid(spark, d):
    return basic.grid(points(spark, d), 50, z=F.round(F.expr("percentile(z, 0.05)"), 6))


@query("SELECT CAST(floor(y / 50) AS BIGINT) AS row, CAST(floor(x / 50) AS BIGINT) AS col, round(stddev_pop(z), 6) AS std, round(avg(intensity), 6) AS mean_i, count(*) AS n, count(*) >= 15 AND stddev_pop(z) > 0.03 AS wet FROM pts GROUP BY 1, 2")
def cell_stats(spark, d):
    n = F.count(F.lit(1))
    return basic.grid(points(spark, d), 50, std=F.round(F.stddev_pop("z"), 6), mean_i=F.round(F.avg("intensity"), 6), n=n, wet=(n >= 15) & (F.stddev_pop("z") > 0.03))


@query("SELECT CAST(floor(y / 30) AS BIGINT) AS row, CAST(floor(x / 30) AS BIGINT) AS col, arg_min(pid, (z, pid)) AS pid, min(z) AS z FROM pts GROUP BY 1, 2")
def lowest_seeds(spark, d):
    return basic.lowest_seeds(points(spark, d), 30)


@query("""-- ctes c AS (SELECT *, quantile_cont(z, 0.05) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS p, count(*) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS n FROM pts)
SELECT pid, z FROM c WHERE n >= 3 AND z <= p""")
def lowest_percentile_keep(spark, d):
    return basic.keep_lowest(points(spark, d), 50, 0.05).select("pid", "z")


@query("SELECT CAST(floor(x / 40) AS BIGINT) AS vx, CAST(floor(y / 40) AS BIGINT) AS vy, CAST(floor(z / 40) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, arg_min(classification, pid) AS classification, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def voxel_centroids(spark, d):
    return basic.voxel_centroids(points(spark, d), 40).select("vx", "vy", "vz", _r("x"), _r("y"), _r("z"), "classification", "n")


@query("""-- ctes c AS (SELECT *, floor(y / 30) AS r, floor(x / 30) AS q FROM pts), m AS (SELECT r, q, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY 1, 2)
SELECT CAST(r AS BIGINT) AS row, CAST(q AS BIGINT) AS col, arg_min(pid, (round((x-cx)**2 + (y-cy)**2 + (z-cz)**2, 6), pid)) AS pid FROM c JOIN m USING (r, q) GROUP BY 1, 2""")
def thin_average(spark, d):
    return basic.thin_average(points(spark, d), 30)


@query("""-- ctes l AS (SELECT tile, line, count(*) AS c FROM pts GROUP BY 1, 2), s AS (SELECT tile, sensor, count(*) AS c FROM pts GROUP BY 1, 2)
SELECT p.tile, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n,
 any_value(fl) AS flight_line, any_value(sn) AS sensor FROM pts p JOIN (SELECT tile, arg_min(line, (-c, line)) AS fl FROM l GROUP BY 1) USING (tile) JOIN (SELECT tile, arg_min(sensor, (-c, sensor)) AS sn FROM s GROUP BY 1) USING (tile) GROUP BY 1""")
def tile_catalog(spark, d):
    return basic.tile_catalog(points(spark, d))


@query("SELECT round(count(*) / count(DISTINCT (floor(x), floor(y))), 6) AS density, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 9) AS by_box FROM pts")
def effective_density(spark, d):
    return basic.effective_density(points(spark, d)).select(_r("density"), _r("by_box", 9))


@query("SELECT greatest(1.0, quantile_cont(intensity, 0.97)) AS scale FROM pts")
def intensity_scale(spark, d):
    return basic.intensity_scale(points(spark, d))


# Spatial joins and noise filters

PAIR3 = "FROM pts a JOIN pts b ON b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r} AND b.z BETWEEN a.z - {r} AND a.z + {r} AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {r}.0 * {r}"
PAIR2 = "FROM pts a JOIN pts b ON b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r} AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {r}.0 * {r}"


@query("SELECT a.pid, count(*) AS n, count(*) >= 4 AS keep " + PAIR3.format(r=20) + " GROUP BY 1")
def radius_outliers(spark, d):
    return noise.radius_outliers(points(spark, d), 20, 4)


@query("-- ctes n AS (SELECT a.pid, min(b.z) AS lo, max(b.z) AS hi " + PAIR2.format(r=15) + " WHERE a.pid <> b.pid GROUP BY 1) SELECT p.pid, p.z, NOT coalesce(p.z < lo - 1 OR p.z > hi + 10, false) AS keep FROM pts p LEFT JOIN n ON p.pid = n.pid")
def low_points(spark, d):
    return noise.low_points(points(spark, d), 15, 1, 10)


KNN = """near AS (SELECT a.pid, a.x, a.y, a.z, b.pid AS q, b.x AS bx, b.y AS by_, b.z AS bz, {d2} AS d2 FROM pts a JOIN pts b ON a.pid <> b.pid AND abs(a.x - b.x) <= {w} AND abs(a.y - b.y) <= {w}{third}),
 k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, q) AS rank FROM near QUALIFY rank <= {k})"""
D3, D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)", "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)"


@query("-- ctes " + KNN.format(d2=D2, w=120, third="", k=5) + " SELECT pid, CAST(rank AS INTEGER) AS rank, q AS nbr, round(d2, 6) AS d2 FROM k")
def knn_xy(spark, d):
    p = points(spark, d).select("pid", "x", "y")
    return knn_join(p, p, 5).select("pid", "rank", F.col("n_pid").alias("nbr"), _r("d2"))


@query("-- ctes " + KNN.format(d2=D3, w=250, third=" AND abs(a.z - b.z) <= 250", k=6) + ", m AS (SELECT pid, round(avg(sqrt(d2)), 6) AS mean_d FROM k GROUP BY 1) SELECT pid, mean_d, mean_d <= (SELECT avg(mean_d) + 2.0 * stddev_pop(mean_d) FROM m) AS keep FROM m")
def statistical_outliers(spark, d):
    return noise.statistical_outliers(points(spark, d), 6, 2.0)


@query("-- ctes " + KNN.format(d2=D2, w=120, third="", k=1) + " SELECT pid, q AS nearest, round(sqrt(d2), 6) AS dist, sqrt(d2) <= 6 AS keep FROM k")
def nearest_isolated(spark, d):
    near = noise.nearest_distance(points(spark, d))
    return near.select("pid", "nearest", _r("dist"), (F.col("dist") <= 6).alias("keep"))


@query("-- ctes " + KNN.format(d2=D3, w=250, third=" AND abs(a.z - b.z) <= 250", k=6) + """, w AS (SELECT *, exp(-d2 / 800.0) * exp(-(z - bz) * (z - bz) / 200.0) AS w FROM k)
 SELECT pid, round(CASE WHEN sum(w) > 0 THEN sum(w * bx) / sum(w) ELSE any_value(x) END, 4) AS x, round(CASE WHEN sum(w) > 0 THEN sum(w * by_) / sum(w) ELSE any_value(y) END, 4) AS y, round(CASE WHEN sum(w) > 0 THEN sum(w * bz) / sum(w) ELSE any_value(z) END, 4) AS z FROM w GROUP BY 1""")
def bilateral(spark, d):
    return noise.bilateral(points(spark, d), 6, 20.0, 10.0).select("pid", _r("x", 4), _r("y", 4), _r("z", 4))


@query("-- ctes " + KNN.format(d2=D2, w=120, third="", k=8) + " SELECT pid, round(quantile_cont(bz, 0.5), 6) AS mid, any_value(z) >= quantile_cont(bz, 0.5) - 1.0 AS keep FROM k GROUP BY 1")
def low_cleanup(spark, d):
    return noise.low_cleanup(points(spark, d), 8, 1.0)


@query("-- ctes g AS (SELECT pid, x, y, classification FROM pts WHERE pid % 4 = 0), near AS (SELECT a.pid, b.classification AS c, row_number() OVER (PARTITION BY a.pid ORDER BY " + D2 + ", b.pid) AS rank FROM pts a JOIN g b ON abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 200 QUALIFY rank <= 5), v AS (SELECT pid, c, count(*) AS n FROM near GROUP BY 1, 2) SELECT pid, arg_min(c, (-n, c)) AS label FROM v GROUP BY 1")
def label_transfer(spark, d):
    p = points(spark, d).select("pid", "x", "y", "classification")
    near = knn_join(p.select("pid", "x", "y"), p.where("pid % 4 = 0"), 5, self_join=False)
    votes = near.groupBy("pid", "n_classification").count()
    return votes.groupBy("pid").agg(F.min(F.struct((-F.col("count")).alias("c"), F.col("n_classification").alias("l")))["l"].alias("label"))


# Bathymetry

TRAJ = """traj AS (SELECT t, x, y, z + 1000 AS z FROM (SELECT *, row_number() OVER (ORDER BY t, pid) AS i FROM pts) WHERE (i - 1) % 100 = 0),
 seg AS (SELECT t, x, y, z, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM traj WINDOW w AS (ORDER BY t, x, y, z)),
 lo AS (SELECT t AS lt, x AS lx, y AS ly, z AS lz FROM traj ORDER BY t, x, y, z LIMIT 1), hi AS (SELECT t AS ht, x AS hx, y AS hy, z AS hz FROM traj ORDER BY t DESC, x DESC, y DESC, z DESC LIMIT 1),
 pos AS (SELECT p.*, CASE WHEN p.t < lt THEN lx WHEN p.t >= ht THEN hx ELSE s.x + (p.t - s.t) / (s.t2 - s.t) * (s.x2 - s.x) END AS sx,
  CASE WHEN p.t < lt THEN ly WHEN p.t >= ht THEN hy ELSE s.y + (p.t - s.t) / (s.t2 - s.t) * (s.y2 - s.y) END AS sy,
  CASE WHEN p.t < lt THEN lz WHEN p.t >= ht THEN hz ELSE s.z + (p.t - s.t) / (s.t2 - s.t) * (s.z2 - s.z) END AS sz
  FROM pts p CROSS JOIN lo CROSS JOIN hi LEFT JOIN (SELECT * FROM seg WHERE t2 > t) s ON p.t >= s.t AND p.t < s.t2)"""
WATER = "water AS (SELECT r AS row, c AS col, CASE WHEN (r * 7 + c) % 11 = 0 THEN NULL ELSE 200.0E0 + (r + c) % 7 END AS z FROM range(100) a(r), range(60) b(c))"


def trajectory(p: DataFrame) -> DataFrame:
    """Every hundredth point in order of time."""
    nth = placed(p.select("t", "pid", "x", "y", "z"), ["t", "pid"], place="i")
    return nth.where((F.col("i") - 1) % 100 == 0).select("t", "x", "y", (F.col("z") + 1000).alias("z"))


@query(f"-- ctes {TRAJ} SELECT pid, round(sx, 4) AS sx, round(sy, 4) AS sy, round(sz, 4) AS sz FROM pos")
def trajectory_asof(spark, d):
    p = points(spark, d)
    return bathy.interpolate(p, trajectory(p), 86400.0).select("pid", _r("sx", 4), _r("sy", 4), _r("sz", 4))


@query(f"-- ctes {WATER} SELECT pid, coalesce(w.z, -1.0) AS ws FROM pts LEFT JOIN water w ON w.row = floor(y / 10) AND w.col = floor(x / 10)")
def raster_sample(spark, d):
    return bathy.sample_raster(points(spark, d), water(spark), 10, -1.0).select("pid", "ws")


@query(f"""-- ctes {WATER}, wide AS (SELECT DISTINCT row + i AS r, col + j AS c FROM water, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE z IS NOT NULL AND abs(i) + abs(j) <= 2),
 p AS (SELECT pid, z, CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c FROM pts)
SELECT pid FROM p JOIN wide USING (r, c) LEFT JOIN water w ON w.row = p.r AND w.col = p.c WHERE w.z IS NULL OR p.z <= w.z + 0.5""")
def crop_to_water(spark, d):
    return bathy.crop_to_water(points(spark, d), water(spark), 10, 0.5, 2).select("pid")


SNELL = """s0 AS (SELECT pid, x, y, z, 200.0E0 AS ws, 500.0E0 AS sx, 500.0E0 AS sy, 1200.0E0 AS sz FROM pts),
 s1 AS (SELECT *, greatest(0.0, least(1.0, (ws - sz) / (z - sz))) AS f FROM s0), s2 AS (SELECT *, sx + f * (x - sx) AS ix, sy + f * (y - sy) AS iy FROM s1),
 s3 AS (SELECT *, sqrt((ix-sx)*(ix-sx) + (iy-sy)*(iy-sy) + (ws-sz)*(ws-sz)) AS air, sqrt((x-ix)*(x-ix) + (y-iy)*(y-iy) + (z-ws)*(z-ws)) AS app FROM s2),
 s4 AS (SELECT *, least(1.0, greatest(0.0, abs(ws - sz) / greatest(air, 1e-12))) AS ca FROM s3), s5 AS (SELECT *, sqrt(greatest(1.0 - ca * ca, 0.0)) AS sa FROM s4),
 s6 AS (SELECT *, least(1.0, greatest(0.0, sa / 1.3333E0)) AS sw FROM s5), s7 AS (SELECT *, app / 1.3333E0 AS far, sqrt(greatest(1.0 - sw * sw, 0.0)) AS cw, CASE WHEN sa > 1e-12 THEN sw / greatest(sa, 1e-12) ELSE 0.0 END AS side FROM s6)"""


@query(f"""-- ctes {SNELL} SELECT pid, round(CASE WHEN z < ws THEN ix + (x - ix) * side * (far / greatest(app, 1e-12)) ELSE x END, 6) AS x,
 round(CASE WHEN z < ws THEN iy + (y - iy) * side * (far / greatest(app, 1e-12)) ELSE y END, 6) AS y, round(CASE WHEN z < ws THEN ws - far * cw ELSE z END, 6) AS z FROM s7""")
def snell_full(spark, d):
    p = points(spark, d).select("pid", "x", "y", "z", F.lit(200.0).alias("ws"), F.lit(500.0).alias("sx"), F.lit(500.0).alias("sy"), F.lit(1200.0).alias("sz"))
    return bathy.snell(p).select("pid", _r("x"), _r("y"), _r("z"))


@query("SELECT pid, round(CASE WHEN z < 200 THEN 200.0E0 - (200.0E0 - z) * 1.3333E0 ELSE z END, 6) AS z FROM pts")
def snell_nadir(spark, d):
    return bathy.snell_nadir(points(spark, d).withColumn("ws", F.lit(200.0))).select("pid", _r("z"))


# Registration

GCP = "gcp AS (SELECT s_name AS name, (s_suppkey * 7919 % 1000) * 1.0E0 AS x, (s_suppkey * 104729 % 1000) * 1.0E0 AS y, s_acctbal % 500 AS z FROM supplier), dz AS (SELECT g.name, g.z, quantile_cont(p.z, 0.5) AS mid, stddev_pop(p.z) AS std, count(*) AS n, g.z - quantile_cont(p.z, 0.5) AS dz FROM gcp g JOIN pts p ON abs(g.x - p.x) <= 30 AND abs(g.y - p.y) <= 30 AND (g.x-p.x)*(g.x-p.x) + (g.y-p.y)*(g.y-p.y) <= 900.0 GROUP BY 1, 2)"


@query(f"-- ctes {GCP} SELECT name, round(mid, 6) AS mid, round(std, 6) AS std, n, round(dz, 6) AS dz FROM dz")
def gcp_dz(spark, d):
    return register.gcp_dz(gcp(spark, d), points(spark, d), 30).select("name", _r("mid"), _r("std"), "n", _r("dz"))


@query(f"-- ctes {GCP} SELECT round(quantile_cont(dz, 0.5), 6) AS median, round(avg(dz), 6) AS mean, round(stddev_pop(dz), 6) AS std, round(sqrt(avg(dz * dz)), 6) AS rms, round(max(abs(dz)), 6) AS most, count(*) FILTER (abs(dz) > 5) AS over_5, count(*) FILTER (abs(dz) > 20) AS over_20 FROM dz")
def gcp_summary(spark, d):
    s = register.gcp_summary(register.gcp_dz(gcp(spark, d), points(spark, d), 30))
    return s.select(*[_r(c) for c in ("median", "mean", "std", "rms", "most")], "over_5", "over_20")


@query("-- ctes m AS (SELECT floor(y / 20) AS r, floor(x / 20) AS c, avg(z) AS tz FROM pts WHERE line <= 4 GROUP BY 1, 2) SELECT round(quantile_cont(tz - z, 0.5), 6) AS shift, count(*) AS n FROM pts JOIN m ON r = floor(y / 20) AND c = floor(x / 20) WHERE line > 4")
def vertical_shift(spark, d):
    p = points(spark, d)
    return register.vertical_shift(p.where("line > 4"), p.where("line <= 4"), 20).select(_r("shift"), "n")


@query("SELECT pid, round(x * 0.8 + y * (-0.6) + z * 0.0 + 10.0, 6) AS x, round(x * 0.6 + y * 0.8 + z * 0.0 + (-5.0), 6) AS y, round(x * 0.0 + y * 0.0 + z * 1.5 + 2.0, 6) AS z FROM pts")
def affine_apply(spark, d):
    m = [[0.8, -0.6, 0.0, 10.0], [0.6, 0.8, 0.0, -5.0], [0.0, 0.0, 1.5, 2.0]]
    return register.affine(points(spark, d), m).select("pid", _r("x"), _r("y"), _r("z"))


# Blocks and voxels


@query("SELECT CAST(bx AS BIGINT) AS bx, CAST(by_ AS BIGINT) AS by_, count(*) AS n FROM pts, (SELECT unnest([0, -1]) AS i), (SELECT unnest([0, -1]) AS j), LATERAL (SELECT floor(x / 25) + i AS bx, floor(y / 25) + j AS by_) GROUP BY 1, 2")
def block_overlap(spark, d):
    return basic.block_overlap(points(spark, d), 25).withColumnRenamed("by", "by_")


@query("""-- ctes v AS (SELECT pid, row_number() OVER (PARTITION BY floor(x / 50), floor(y / 50) ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS n FROM pts)
SELECT pid, i, n FROM v WHERE i = 3 % n""")
def voxel_fragment(spark, d):
    return basic.voxel_fragment(points(spark, d), 50, 3).select("pid", "i", "n")


@query("-- ctes c AS (SELECT CAST(floor(y / 20) AS BIGINT) AS row, CAST(floor(x / 20) AS BIGINT) AS col, max(z) AS z FROM pts WHERE classification IN (2,3,4,5,6) GROUP BY 1, 2), s AS (SELECT round(avg(z), 6) AS m, min(row) AS r0, max(row) AS r1, min(col) AS k0, max(col) AS k1 FROM c), n AS (SELECT a.row, a.col, m, r0, r1, k0, k1, " + ", ".join(
    f"coalesce(max(CASE WHEN b.row = a.row + {i} AND b.col = a.col + {j} THEN b.z END), any_value(m)) AS {'abc'[i + 1]}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)
) + " FROM c a CROSS JOIN s LEFT JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col, m, r0, r1, k0, k1), d AS (SELECT row, col, CASE WHEN row > r0 AND row < r1 AND col > k0 AND col < k1 THEN ((a2 + 2*b2 + c2) - (a0 + 2*b0 + c0)) / 160.0E0 ELSE 0 END AS dx, CASE WHEN row > r0 AND row < r1 AND col > k0 AND col < k1 THEN ((c0 + 2*c1 + c2) - (a0 + 2*a1 + a2)) / 160.0E0 ELSE 0 END AS dy FROM n), e AS (SELECT *, atan(sqrt(dx*dx + dy*dy)) AS st FROM d) SELECT row, col, round(greatest(0, least(1, cos(radians(45.0)) * cos(st) + sin(radians(45.0)) * sin(st) * cos(radians(135.0) - CASE WHEN st > 0 THEN atan2(dy, -dx) ELSE 0 END))) * 254.0 + 1.0, 4) AS shade FROM e")
def hillshade(spark, d):
    return basic.hillshade(basic.dsm(points(spark, d), 20), 20).select("row", "col", _r("shade", 4))


# Registered when they are imported.
from .plans import catalog, evaluation, kernels, projects, selections, storage, surface, terrain, transforms  # noqa: E402, F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
