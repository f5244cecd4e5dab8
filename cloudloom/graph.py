"""Connected components of a graph that need not fit anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): the smallest vertex it is connected with.

    Alternating stars: each vertex hangs its larger neighbours, then its smaller ones, on the least vertex it knows,
    until a round changes nothing. Minima are combined before they are shuffled, so a hub costs one row a task.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    vertices = ends.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    kept, seen = settle(ends.where("u <> v").distinct()), None
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = settle(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        mark = tuple(step.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        kept = step
        if mark == seen:
            break
        seen = mark
    return vertices.join(kept, F.col("x") == F.col("u"), "left").select(F.col("x").alias("v"), F.coalesce("v", "x").alias("label"))
