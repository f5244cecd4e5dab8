"""Places and running sums over a whole table in order: sorted by range, summed inside each partition, then raised by what lies before it.

The rows go to partitions by ranges of their order, so each partition holds a stretch of it. Sums inside a stretch come from a window over that
stretch alone; what the stretches before it add comes from a table of one row a stretch (and group). No window spans the table or a group of it, and one
group's rows spread over as many partitions as they fill.

The order must tell all rows apart, or which of two equal ones comes first is open. Where ties share a value, aggregate by the key first: equal keys then
are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import bounded, settle


def running(
    df: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), sums: dict[str, str | Column] | None = None, totals: dict[str, str] | None = None, place: str | None = None
) -> DataFrame:
    """df with columns of running sums, the row's own value included.

    sums: new column -> what is summed; totals: new column -> a name among sums, whose sum over the whole group it gets; place: the
    column that gets the row's number in its group, from 1. by: groups, null being one.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    value = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    if place:
        value[place] = F.lit(1).cast("long")
    own = df.withColumns({f"_v{i}": v for i, v in enumerate(value.values())})
    keys = [*[F.col(c).asc_nulls_first() for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    # Numbers of rows rise inside a partition and tell its number: one pass fixes both.
    sorted_ = own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = settle(sorted_).withColumn("_part", F.shiftright("_at", 33))
    stretch = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = sorted_.withColumns({n: F.sum(f"_v{i}").over(stretch) for i, n in enumerate(value)})
    ends = settle(sorted_.groupBy("_part", *by).agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(value))]))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a stretch and group; without groups there are as many as partitions.
    starts = ends.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(value))],
        *[F.sum(f"_s{list(value).index(n)}").over(Window.partitionBy(*by)).alias(t) for t, n in totals.items()],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    met = inside.join(bounded(starts), same)
    return met.select(*df.columns, *[(F.col(n) + F.col(f"_b{i}")).alias(n) for i, n in enumerate(value)], *totals)


def placed(df: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """df with each row's number in order, from 1, in the table or in its group."""
    return running(df, order, by, place=place)
