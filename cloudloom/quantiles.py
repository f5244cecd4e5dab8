"""Exact quantiles of a whole table by refined histograms.

The percentile aggregate keeps every distinct value in one task. Here each pass counts values in some thousand buckets of the interval that
holds the wanted order statistic, with map-side sums; the bucket with the statistic, from its least value to its largest, is the next
interval. It shrinks by orders of magnitude a pass, and ends at a single value: the order statistic itself, not an estimate of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import kept

_MOST = 1.7976931348623157e308


def order_statistics(values: DataFrame, ranks: Sequence[int], buckets: int = 4096, few: int = 4096) -> list[float]:
    """The values (one double column v, no nulls) that have so many others before them in order.

    Passes go over ``values`` itself, which should be a stored table. Intervals with at most ``few`` values are fetched.
    """
    first = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    todo = {(first[0], first[1], 0, first[2]): sorted(set(ranks))}
    found: dict[int, float] = {}
    while todo:
        spans = list(todo)
        for lo, hi, below, n in spans:
            if lo == hi:
                found |= {r: lo for r in todo[(lo, hi, below, n)]}
        spans = [s for s in spans if s[0] != s[1]]
        small, large = [s for s in spans if s[3] <= few], [s for s in spans if s[3] > few]
        inside = lambda s: F.col("v").between(F.lit(s[0]), F.lit(s[1]))
        for s in small:
            own = sorted(x[0] for x in values.where(inside(s)).collect())
            found |= {r: own[r - s[2]] for r in todo[s]}
        counts: list[tuple] = []
        if large:
            # Intervals don't overlap. Halves keep the widest of them from running over.
            bucket = None
            for i, (lo, hi, _, _) in enumerate(large):
                share = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
                here = F.struct(F.lit(i).alias("i"), F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int").alias("b"))
                bucket = F.when(inside((lo, hi)), here) if bucket is None else bucket.when(inside((lo, hi)), here)
            counted = values.withColumn("k", bucket).where("k is not null").groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
            counts = sorted((r["k"]["i"], r["k"]["b"], r["lo"], r["hi"], r["n"]) for r in counted.collect())  # at most ``buckets`` a rank
        after: dict[tuple, list[int]] = {}
        seen: dict[int, int] = {}
        for i, _, lo, hi, n in counts:
            below = seen.setdefault(i, large[i][2])
            wanted = [r for r in todo[large[i]] if below <= r < below + n]
            if wanted:
                after[(lo, hi, below, n)] = wanted
            seen[i] = below + n
        todo = after
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, value: str | Column, shares: Sequence[float]) -> list[float | None]:
    """What percentile(value, share) gives, for each share: linear between the two order statistics around it; None without values.

    The column is written out once, as df may be anything. Infinite values count as the largest doubles, NaN as the largest of all.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = df.select(v.alias("v")).where("v is not null")
    own = own.select(F.when(F.isnan("v"), F.lit(_MOST)).otherwise(F.greatest(F.least("v", F.lit(_MOST)), F.lit(-_MOST))).alias("v"))
    with kept(own) as values:
        n = values.count()
        if not n:
            return [None] * len(shares)
        at = [s * (n - 1) for s in shares]
        wanted = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
        held = dict(zip(wanted, order_statistics(values, wanted)))
    out: list[float | None] = []
    for a in at:
        low, high = math.floor(a), math.ceil(a)
        same = low == high or held[low] == held[high]
        out.append(held[low] if same else (high - a) * held[low] + (a - low) * held[high])
    return out


def percentile(df: DataFrame, value: str | Column, share: float) -> float | None:
    return percentiles(df, value, [share])[0]
