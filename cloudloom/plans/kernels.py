"""Neighbour queries, grouping, pooling and codes over the adapter's points; a batch is a flight line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import points
from ..functions import codes
from ..operators import kernels
from ..ranges import placed
from .registry import query
from .registry import rounded as _r

# Features exact in binary.
BATCH = "b AS (SELECT pid, line AS batch, x, y, z, (pid % 32) / 8.0E0 AS f0, (intensity % 64) / 4.0E0 AS f1, classification AS label FROM pts)"
D2 = "(q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)"
# Queries: every tenth point, against all points of its batch.
NEAR = "k AS (SELECT q.pid, p.pid AS neighbour, {d2} AS d2, row_number() OVER (PARTITION BY q.pid ORDER BY {d2}, p.pid) AS rank FROM b q JOIN b p USING (batch) WHERE q.pid % 10 = 0 QUALIFY rank <= {k})"


def near(k: int) -> str:
    return BATCH + ", " + NEAR.format(k=k, d2=D2)


def batches(spark, d):
    feat = F.array(F.expr("(pid % 32) / 8.0D"), F.expr("(intensity % 64) / 4.0D"))
    return points(spark, d).select("pid", F.col("line").alias("batch"), "x", "y", "z", feat.alias("feat"), F.col("classification").alias("label"))


def tenth(spark, d):
    return batches(spark, d).where("pid % 10 = 0")


@query(f"-- ctes {near(4)} SELECT pid, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(d2), 6) AS dist FROM k")
def knn_query(spark, d):
    """The point itself is its first neighbour, as the query is among the points."""
    found = kernels.knn_query(batches(spark, d).select("pid", "batch", "x", "y", "z"), tenth(spark, d).select("pid", "batch", "x", "y", "z"), 4)
    return kernels.padded(found, tenth(spark, d), 4).select("pid", "rank", "neighbour", _r("dist"))


BALL = f"-- ctes {BATCH}, c AS (SELECT q.pid, p.pid AS neighbour, {D2} AS d2 FROM b q JOIN b p USING (batch) WHERE q.pid % 10 = 0 AND abs(q.x - p.x) <= 80 AND abs(q.y - p.y) <= 80 AND abs(q.z - p.z) <= 80 AND ({D2} <= 1e-5 OR ({D2} >= 400.0 AND {D2} < 6400.0))), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, neighbour) - 1 AS r, count(*) OVER (PARTITION BY pid) AS n FROM c), s AS (SELECT *, CAST(floor(i * (n / 4.0E0)) AS BIGINT) AS pick FROM r, range(4) t(i)) SELECT pid, CAST(CASE WHEN n <= 4 THEN r + 1 ELSE i + 1 END AS INTEGER) AS rank, neighbour, round(d2, 6) AS d2 FROM s WHERE (n <= 4 AND i = 0) OR (n > 4 AND pick = r)"


@query(BALL)
def ball_query(spark, d):
    own = batches(spark, d).select("pid", "batch", "x", "y", "z")
    return kernels.ball_query(own, own.where("pid % 10 = 0"), 4, 80.0, 20.0).select("pid", "rank", "neighbour", _r("d2"))


@query()
def random_ball_query(spark, d):
    """The same in an order that a seed fixes by Spark's own hash."""
    own = batches(spark, d).select("pid", "batch", "x", "y", "z")
    return kernels.ball_query(own, own.where("pid % 10 = 0"), 4, 80.0, 20.0, seed=5).select("pid", "rank", "neighbour", _r("d2"))


@query(f"-- ctes {near(4)} SELECT k.pid, CAST(rank AS INTEGER) AS rank, p.f0, p.f1, round(p.x - q.x, 6) AS dx, round(p.z - q.z, 6) AS dz FROM k JOIN b p ON p.pid = neighbour JOIN b q ON q.pid = k.pid")
def grouping(spark, d):
    own = batches(spark, d)
    found = kernels.knn_query(own.select("pid", "batch", "x", "y", "z"), tenth(spark, d).select("pid", "batch", "x", "y", "z"), 4)
    g = kernels.grouped(found, own)
    return g.select("pid", "rank", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"), _r("dx"), _r("dz"))


@query(f"-- ctes {near(7)} SELECT pid, CAST((rank - 1) // 2 + 1 AS INTEGER) AS rank, neighbour FROM k WHERE (rank - 1) % 2 = 0")
def dilated_neighbours(spark, d):
    own = batches(spark, d).select("pid", "batch", "x", "y", "z")
    return kernels.dilated(kernels.knn_query(own, own.where("pid % 10 = 0"), 7), 4, 1).select("pid", F.col("rank").cast("int").alias("rank"), "neighbour")


@query(f"-- ctes {near(3)} SELECT k.pid, round(sum(f0 / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 5) AS f0, round(sum(f1 / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 5) AS f1 FROM k JOIN b p ON p.pid = neighbour GROUP BY 1")
def interpolation(spark, d):
    out = kernels.interpolate(batches(spark, d), tenth(spark, d).drop("feat"), 3)
    return out.select("pid", F.round(F.col("feat")[0], 5).alias("f0"), F.round(F.col("feat")[1], 5).alias("f1"))


@query(f"-- ctes {near(4)} SELECT k.pid, CAST(rank AS INTEGER) AS rank, q.f0 - p.f0 AS f0, q.f1 - p.f1 AS f1 FROM k JOIN b p ON p.pid = neighbour JOIN b q ON q.pid = k.pid")
def subtraction(spark, d):
    own = batches(spark, d)
    found = kernels.knn_query(own.select("pid", "batch", "x", "y", "z"), tenth(spark, d).select("pid", "batch", "x", "y", "z"), 4)
    out = kernels.subtract(found, own, own)
    return out.select("pid", "rank", F.col("diff")[0].alias("f0"), F.col("diff")[1].alias("f1"))


@query(f"-- ctes {near(4)} SELECT k.pid, sum(f0 * rank / 4) AS f0, sum(f1 * rank / 4) AS f1 FROM k JOIN b p ON p.pid = neighbour GROUP BY 1")
def aggregation(spark, d):
    own = batches(spark, d)
    found = kernels.knn_query(own.select("pid", "batch", "x", "y", "z"), tenth(spark, d).select("pid", "batch", "x", "y", "z"), 4).withColumn("weight", F.col("rank") / 4)
    return kernels.aggregate(found, own).select("pid", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


PAIRS = "pr AS (SELECT pid AS target, (pid * j * 7) % (SELECT count(*) FROM pts) + 1 AS refer FROM pts, range(1, 4) r(j) WHERE pid % 10 = 0)"


def pairs(spark, d):
    p = points(spark, d)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return p.where("pid % 10 = 0").crossJoin(F.broadcast(n)).select(F.col("pid").alias("target"), "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")).select("target", F.expr("(target * j * 7) % n + 1").alias("refer"))


RELATION = f"-- ctes {BATCH}, {PAIRS}, rel AS (SELECT target, refer, q.f0 * p.f0 + q.f1 * 2 * p.f1 AS relation FROM pr JOIN b q ON q.pid = target JOIN b p ON p.pid = refer)"


@query(RELATION + " SELECT * FROM rel")
def attention_relation(spark, d):
    own = batches(spark, d)
    return kernels.attention_relation(pairs(spark, d), own, own, F.array(F.lit(1.0), F.lit(2.0)))


@query(RELATION + ", w AS (SELECT target, refer, exp(relation - m) / sum(exp(relation - m)) OVER (PARTITION BY target) AS w FROM (SELECT *, max(relation) OVER (PARTITION BY target) AS m FROM rel)) SELECT target, round(sum(w * f0), 5) AS f0, round(sum(w * f1), 5) AS f1 FROM w JOIN b ON pid = refer GROUP BY 1")
def attention_fusion(spark, d):
    own = batches(spark, d)
    weights = kernels.attention_weights(kernels.attention_relation(pairs(spark, d), own, own, F.array(F.lit(1.0), F.lit(2.0))))
    return kernels.attention_fusion(weights, own).select("target", F.round(F.col("feat")[0], 5).alias("f0"), F.round(F.col("feat")[1], 5).alias("f1"))


@query()
def farthest_points(spark, d):
    """Greedy, each choice by those before: no SQL; tests compare it with a loop."""
    return kernels.farthest_points(batches(spark, d), 16)


@query()
def ball_clusters(spark, d):
    """Connected components have no plain SQL; tests compare them with a search."""
    return kernels.ball_clusters(batches(spark, d), 40.0, 3)


@query()
def instance_proposals(spark, d):
    moved = batches(spark, d).withColumns({"dx": F.lit(1.0), "dy": F.col("feat")[0], "dz": F.lit(0.0), "logit": F.col("feat")[1]})
    return kernels.proposals(moved, 40.0, 3).select("proposal", "label", "size", _r("confidence"))


CELLS = "cl AS (SELECT pid, line AS batch, x, y, z, CAST(floor(x / 4) AS BIGINT) AS gx, CAST(floor(y / 4) AS BIGINT) AS gy, CAST(floor(z / 4) AS BIGINT) AS gz, (pid % 32) / 8.0E0 AS f0 FROM pts)"
Z_SQL = "list_sum(list_transform(range(16), lambda i: (((gx >> i) & 1) << (3 * i + 2)) | (((gy >> i) & 1) << (3 * i + 1)) | (((gz >> i) & 1) << (3 * i))))"


def cells(spark, d):
    cell = lambda c: F.floor(F.col(c) / 4).cast("long").alias("g" + c)
    return points(spark, d).select("pid", F.col("line").alias("batch"), "x", "y", "z", *[cell(c) for c in "xyz"], F.array(F.expr("(pid % 32) / 8.0D")).alias("feat"))


@query(f"-- ctes {CELLS} SELECT pid, CAST({Z_SQL} AS BIGINT) AS code, CAST({Z_SQL.replace('gx', 'G').replace('gy', 'gx').replace('G', 'gy')} AS BIGINT) AS swapped, CAST({Z_SQL} AS BIGINT) | (CAST(batch AS BIGINT) << 48) AS prefixed, gx, gy, gz FROM cl")
def z_order(spark, d):
    """Codes, those with x and y swapped, those with a batch in front, and the cells read back."""
    c = cells(spark, d)
    code = codes.z_order(F.col("gx"), F.col("gy"), F.col("gz"))
    c = c.withColumns({"code": code, "swapped": codes.z_order(F.col("gy"), F.col("gx"), F.col("gz"))}).withColumn("prefixed", codes.with_batch(F.col("code"), F.col("batch")))
    back = codes.z_order_cells(F.col("prefixed"))
    return c.select("pid", "code", "swapped", "prefixed", *[b.alias(n) for b, n in zip(back, ("gx", "gy", "gz"))])


@query(f"-- ctes {CELLS}, z AS (SELECT pid, CAST({Z_SQL} AS BIGINT) AS code FROM cl) SELECT pid, row_number() OVER (ORDER BY code, pid) AS place FROM z")
def z_sorted(spark, d):
    """A cloud in the order of its curve: ranges of codes are dealt to tasks, each is numbered from where it begins."""
    c = cells(spark, d).select("pid", codes.z_order(F.col("gx"), F.col("gy"), F.col("gz")).alias("code"))
    return placed(c, ["code", "pid"]).select("pid", "place")


@query()
def hilbert(spark, d):
    """Runs on Arrow batches; tests check that neighbours on the curve are neighbours in space, and the way back."""
    c = cells(spark, d)
    return c.select("pid", codes.hilbert(F.col("gx"), F.col("gy"), F.col("gz"), 8).alias("code"))


@query(f"-- ctes {CELLS}, m AS (SELECT min(gx) AS x0, min(gy) AS y0, min(gz) AS z0, max(gy) - min(gy) + 1 AS ny, max(gz) - min(gz) + 1 AS nz FROM cl) SELECT pid, ((gx - x0) * ny + gy - y0) * nz + gz - z0 AS key FROM cl CROSS JOIN m")
def ravel_keys(spark, d):
    c = cells(spark, d)
    m = c.agg(*[F.min("g" + a).alias(a + "0") for a in "xyz"], *[(F.max("g" + a) - F.min("g" + a) + 1).alias("n" + a) for a in "xyz"])
    own = c.crossJoin(F.broadcast(m))
    key = codes.ravel([F.col("g" + a) - F.col(a + "0") for a in "xyz"], [F.col("n" + a) for a in "xyz"])
    return own.select("pid", key.alias("key"))


FNV = "CAST({h} AS HUGEINT) * 1099511628211 % 18446744073709551616"


@query(f"-- ctes {CELLS}, a AS (SELECT pid, gy, gz, xor({FNV.format(h='14695981039346656037')}, gx::HUGEINT) AS h FROM cl), b AS (SELECT pid, gz, xor({FNV.format(h='h')}, gy::HUGEINT) AS h FROM a), c AS (SELECT pid, xor({FNV.format(h='h')}, gz::HUGEINT) AS h FROM b) SELECT pid, CAST(h AS VARCHAR) AS key FROM c")
def fnv_keys(spark, d):
    return cells(spark, d).select("pid", codes.fnv([F.col("gx"), F.col("gy"), F.col("gz")]).cast("string").alias("key"))


@query(f"-- ctes {CELLS}, z AS (SELECT *, CAST({Z_SQL} AS BIGINT) AS code FROM cl) SELECT batch, code >> 9 AS parent, count(*) AS n, round(avg(x), 6) AS x, max(f0) AS f0, arg_min(gx, pid) >> 3 AS gx FROM z GROUP BY 1, 2")
def serialized_pool(spark, d):
    c = cells(spark, d).withColumn("code", codes.z_order(F.col("gx"), F.col("gy"), F.col("gz")))
    return kernels.serialized_pool(c, 3).select("batch", "parent", "n", _r("x"), F.col("feat")[0].alias("f0"), "gx")


POOL = f"{CELLS}, m AS (SELECT batch, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM cl GROUP BY 1), v AS (SELECT cl.*, CAST(floor((x - x0) / 50) AS BIGINT) AS vx, CAST(floor((y - y0) / 50) AS BIGINT) AS vy, CAST(floor((z - z0) / 50) AS BIGINT) AS vz FROM cl JOIN m USING (batch)), pool AS (SELECT batch, vx, vy, vz, avg(x) AS x, max(f0) AS f0, count(*) AS n FROM v GROUP BY 1, 2, 3, 4)"


@query(f"-- ctes {POOL} SELECT batch, vx, vy, vz, round(x, 6) AS x, f0, n FROM pool")
def grid_pool(spark, d):
    return kernels.grid_pool(cells(spark, d), 50.0).select("batch", "vx", "vy", "vz", _r("x"), F.col("feat")[0].alias("f0"), "n")


@query(f"-- ctes {POOL} SELECT pid, p.f0 AS f0 FROM v JOIN pool p USING (batch, vx, vy, vz)")
def unpool(spark, d):
    """Pooled features given back to the points of each voxel: the voxel's inverse mapping."""
    own = cells(spark, d)
    start = own.groupBy(F.col("batch").alias("b")).agg(*[F.min(c).alias("o" + c) for c in "xyz"])
    keyed = own.join(F.broadcast(start), F.col("batch") == F.col("b")).withColumns({"v" + c: F.floor((F.col(c) - F.col("o" + c)) / 50).cast("long") for c in "xyz"})
    out = kernels.unpool(keyed.select("pid", "batch", "vx", "vy", "vz"), kernels.grid_pool(own, 50.0), ["batch", "vx", "vy", "vz"])
    return out.select("pid", F.col("parent_feat")[0].alias("f0"))


@query(f"-- ctes {CELLS}, t AS (SELECT batch, avg(x) AS x, avg(y) AS y, avg(z) AS z, floor(x / 30) AS vx, floor(y / 30) AS vy, floor(z / 30) AS vz FROM cl WHERE batch <= 3 GROUP BY batch, vx, vy, vz), n AS (SELECT batch, count(*) AS total FROM t GROUP BY 1), m AS (SELECT DISTINCT a.batch AS a, b.batch AS b, a.vx, a.vy, a.vz FROM t a JOIN t b ON a.batch <> b.batch AND abs(a.x - b.x) <= 45 AND abs(a.y - b.y) <= 45 AND abs(a.z - b.z) <= 45 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 2025), s AS (SELECT a, b, count(*) AS met FROM m GROUP BY 1, 2) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(met / total), 6) AS overlap FROM s JOIN n ON n.batch = a GROUP BY 1, 2")
def scene_overlap(spark, d):
    own = cells(spark, d).where("batch <= 3").select(F.col("batch").alias("scene"), "x", "y", "z")
    return kernels.scene_overlap(own, 30.0).select("a", "b", _r("overlap"))


@query(f"-- ctes {CELLS}, g AS (SELECT pid, (batch - 1) // 2 AS mixed, gx, gy FROM cl) SELECT pid, mixed, gx - min(gx) OVER (PARTITION BY mixed) AS gx, gy - min(gy) OVER (PARTITION BY mixed) AS gy FROM g")
def mixed_batches(spark, d):
    """Neighbouring scenes merged by pairs, cells counted anew from the merged scene's corner."""
    c = cells(spark, d).withColumn("mixed", F.expr("(batch - 1) div 2"))
    corner = c.groupBy(F.col("mixed").alias("m")).agg(F.min("gx").alias("x0"), F.min("gy").alias("y0"))
    return c.join(F.broadcast(corner), F.col("mixed") == F.col("m")).select("pid", "mixed", (F.col("gx") - F.col("x0")).alias("gx"), (F.col("gy") - F.col("y0")).alias("gy"))
