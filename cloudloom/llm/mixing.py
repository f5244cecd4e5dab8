"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source are a stream of equal-token blocks. Sainte-Laguë (divisors 1, 3, 5, ...) deals the blocks
of the whole mix to sources by their targets, then each source's blocks to its shards by their words, so every
(source, shard) cell has an integer quota before any block is picked. Inside a cell a seeded systematic
draw picks that many blocks, each at most ``max_epochs`` times.

Only one row a source reaches the driver. Cells are bounded (rows spread over shards by hash), so a source that
holds a third of all rows is spread over all shards.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, sorted last;
an empty table gives an empty table; repeated rows are each dealt as a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_words, spare


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Integer seats for each entry by highest quotients votes / (2 s + 1); ties to the earlier entry.

    The divisor is found by bisection (the quotients above it number round(votes / divisor)); what ties leave
    over is dealt one seat at a time. ``most`` bounds each entry's seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    most = np.full(len(votes), seats, dtype=np.int64) if most is None else np.asarray(most, dtype=np.int64)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return got

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * seats + 2.0), 2.0 * votes.max() + 1.0
    while dealt(low).sum() < seats:
        low /= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        if dealt(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = dealt(high)  # at most the seats there are
    while got.sum() < seats:
        quotient = np.where((got < most) & (votes > 0), votes / (2.0 * got + 1.0), -1.0)
        short = int(seats - got.sum())
        best = np.argsort(-quotient, kind="stable")[: max(1, min(short, int((quotient >= quotient.max()).sum())))]
        got[best] += 1
    return got


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    total, n = float(sum(sizes)), len(sizes)
    top = [cap * s for s in sizes]
    held = [False] * n
    while True:
        free = total - sum(t for t, h in zip(top, held) if h)
        weight = sum(w for w, h in zip(weights, held) if not h)
        out = [t if h else (free * w / weight if weight else 0.0) for t, w, h in zip(top, weights, held)]
        over = [i for i in range(n) if not held[i] and out[i] > top[i]]
        if not over:
            return out
        for i in over:
            held[i] = True


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    block: int = 8,
    rows_per_shard: int = 200,
    max_shards: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """One row a row of docs: id, source, size, source_size, target, shard, quota_words and taken.

    weights: repeated over the sources in code point order. block: words in a block. rows_per_shard: rows that
    a shard has over all sources, up to max_shards shards.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
        )
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["words"]) for r in by_source]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], float(max_epochs))
    quotas = sainte_lague(np.array(aims), round(sum(aims) / block), np.array([-(-max_epochs * s // block) for s in sizes]))
    shards = int(min(max_shards, max(1, -(-sum(r["n"] for r in by_source) // rows_per_shard))))
    plan = spark.createDataFrame(
        [(r["source"], s, float(t), int(q)) for r, s, t, q in zip(by_source, sizes, aims, quotas)],
        "source string, source_size long, target double, blocks long",
    )

    at_home = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(shards)).cast("int")
    rows = sized.withColumn("shard", at_home)
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    cells = cells.join(plan, cells["source"].eqNullSafe(plan["source"])).select(
        cells["source"], "shard", "words", "source_size", "target", "blocks"
    )

    def deal(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("shard").reset_index(drop=True)
        words = cell["words"].to_numpy(dtype=np.int64)
        there = -(-words // block)
        cell["quota"] = sainte_lague(words, int(cell["blocks"].iloc[0]), max_epochs * there)
        return cell

    dealt = cells.groupBy("source").applyInPandas(
        deal, "source string, shard int, words long, source_size long, target double, blocks long, quota long"
    )
    dealt = dealt.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("k"), F.col("shard").alias("s"), "words", "source_size", "target", "quota"
    )
    rows = rows.withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    inside = Window.partitionBy("k", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size")
    rows = rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(dealt.withColumnRenamed("k", "dk"), (F.col("k") == F.col("dk")) & (F.col("shard") == F.col("s")), "left")

    # Block b of a cell's n has words [b * block, (b + 1) * block). All are taken quota div n times; the rest of
    # the quota goes to evenly spaced blocks from a seeded start: extra(b) = those among the first b blocks.
    n = F.greatest(F.ceil(F.col("words") / block), F.lit(1)).cast("long")
    rows = rows.withColumn("n", n).withColumn("left", F.col("quota") % F.col("n")).withColumn(
        "start", F.pmod(F.xxhash64(F.lit(seed + 2), "k", "shard"), F.col("n"))
    )

    def extra(b):
        return F.expr(f"(({b}) * left + start) div n")

    def words_before(x: str):
        whole, part = f"(({x}) div {block})", f"(({x}) % {block})"
        return extra(whole) * block + (extra(f"{whole} + 1") - extra(whole)) * F.expr(part)

    picked = words_before("end") - words_before("end - size")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "shard",
        (F.col("quota") * block).alias("quota_words"),
        F.coalesce(F.expr("quota div n") * F.col("size") + picked, F.lit(0)).cast("long").alias("taken"),
    )


def apply(docs: DataFrame, id_col: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """docs as the mix takes them, in whole documents: each as many times as the words taken of it hold it.

    A remainder becomes one more copy with the chance that it is of a whole, by a hash of the id, so reruns agree. Rows that
    share an id get the copies of the first of them. The columns stay, whatever their names.
    """
    dealt = mix(docs, id_col=id_col, seed=seed, **options).dropDuplicates([id_col])
    chance = F.pmod(F.xxhash64(F.lit(seed + 3), id_col), F.lit(1 << 30)) / float(1 << 30)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(F.lit(0)).cast("int")
    name, times, copy = (spare(docs, n) for n in ("mix_id", "mix_copies", "mix_copy"))
    dealt = dealt.select(F.col(id_col).alias(name), whole.alias(times)).where(F.col(times) > 0)
    out = docs.join(dealt, docs[id_col].eqNullSafe(F.col(name)))
    every = F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)
    return out.select(*[docs[c] for c in docs.columns], every).select(*[F.col(f"`{c}`") for c in docs.columns])
