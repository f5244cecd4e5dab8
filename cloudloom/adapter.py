"""Driver tables read as point-cloud tables: integers first, then one division, alike on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PTS_SQL = """pts AS (SELECT event_id AS pid,
 (event_id * 7919 % 100000) / 100.0E0 AS x, (event_id * 104729 % 100000) / 100.0E0 AS y, value AS z,
 CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 5 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 1 ELSE 7 END AS INTEGER) AS classification,
 CAST(event_id * 31 % 4096 AS INTEGER) AS intensity, CAST(1 + event_id % 3 AS INTEGER) AS nr,
 CAST(1 + (event_id // 3) % (1 + event_id % 3) AS INTEGER) AS rn, CAST(1 + user_id % 8 AS INTEGER) AS line,
 CAST(CASE WHEN (1 + user_id % 8) % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS sensor, epoch_us(ts) / 1.0E6 AS t,
 CAST(floor((event_id * 104729 % 100000) / 100.0E0 / 200) * 5 + floor((event_id * 7919 % 100000) / 100.0E0 / 200) AS INTEGER) AS tile
 FROM events)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a point: pid, x, y, z, classification, intensity, nr, rn, line, sensor (1 topo, 2 bathy), t, tile."""
    e = read(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("pid"),
        F.expr("(event_id * 7919 % 100000) / 100.0D").alias("x"),
        F.expr("(event_id * 104729 % 100000) / 100.0D").alias("y"),
        F.col("value").alias("z"),
        F.expr("CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 5 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 1 ELSE 7 END").alias("classification"),
        F.expr("CAST(event_id * 31 % 4096 AS INT)").alias("intensity"),
        F.expr("CAST(1 + event_id % 3 AS INT)").alias("nr"),
        F.expr("CAST(1 + (event_id div 3) % (1 + event_id % 3) AS INT)").alias("rn"),
        F.expr("CAST(1 + user_id % 8 AS INT)").alias("line"),
        F.expr("CASE WHEN (1 + user_id % 8) % 2 = 0 THEN 1 ELSE 2 END").alias("sensor"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) / 1000000.0D").alias("t"),
    )
    return rows.withColumn("tile", F.expr("CAST(floor(y / 200) * 5 + floor(x / 200) AS INT)"))


def water(spark: SparkSession) -> DataFrame:
    cells = spark.range(100).select(F.col("id").alias("row")).crossJoin(spark.range(60).select(F.col("id").alias("col")))
    return cells.withColumn("z", F.expr("CASE WHEN (row * 7 + col) % 11 = 0 THEN NULL ELSE 200.0D + (row + col) % 7 END"))


def gcp(spark, d):
    return read(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.expr("(s_suppkey * 7919 % 1000) * 1.0D").alias("x"), F.expr("(s_suppkey * 104729 % 1000) * 1.0D").alias("y"), F.expr("s_acctbal % 500").alias("z")
    )
