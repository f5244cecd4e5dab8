"""Sharding by sampled splitters, in DataFrame functions only.

Rows have the key (hash of the text, hash of the id, id): equal texts are neighbours. A size-weighted sample of keys
gives quantile boundaries of many fine ranges; a range boundary inside a group of equal texts is
moved to the group's start unless the group is overfull, that is, holds several boundaries, and is then subdivided by the
second part of the key. Sizes and counts of ranges are summed up, and shards are cut at equal bytes of the running
total, inside a range where need be. Only boundaries and one row a range reach the driver, both bounded by ``max_ranges``.

Defined results: a null text has size 1 and the checksum of no bytes, 0; an empty text likewise; an empty table
gives an empty table; repeated rows each get a slot; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def _range_of(key: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    low, high = _longs([a for a, _ in bounds]), _longs([b for _, b in bounds])

    def step_to(at: Column, s: Column) -> Column:
        a, b = F.get(low, at + s - 1), F.get(high, at + s - 1)
        below = (a < key["a"]) | ((a == key["a"]) & (b <= key["b"]))
        return F.when((at + s <= len(bounds)) & below, at + s).otherwise(at)

    return F.aggregate(_longs(steps).cast("array<int>"), F.lit(0), step_to)


def _longs(values: list[int]) -> Column:
    """A literal array; one string literal is far quicker to plan than thousands of numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def shard(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = 100,
    max_ranges: int = 4096,
    samples_per_range: int = 8,
    split_share: float = 0.005,
    seed: int = 11,
) -> DataFrame:
    """One row a row of docs: id, size, text_crc32, shard and slot; shards have nearly equal sums of size.

    split_share: a group of equal texts stays in one shard while its part of a range is at most this share of a
    shard; a larger one is cut where the shard ends.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("crc"),
            F.xxhash64(text).alias("k1"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("k2"),
        )
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(max_ranges, max(1, -(-n // rows_per_range))))
    # A row is drawn with a chance of its size times the rate; a row larger than 1 / rate always is.
    rate = ranges * samples_per_range / max(total, 1)
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "k1"), F.lit(1 << 40)) / float(1 << 40)
    sample = [tuple(r) for r in rows.where(chance < F.col("size") * rate).select("k1", "k2").orderBy("k1", "k2").collect()]
    picks = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    often: dict[int, int] = {}
    for k1, _ in picks:
        often[k1] = often.get(k1, 0) + 1
    least = -(1 << 63)
    bounds = sorted({(k1, k2 if often[k1] > 1 else least) for k1, k2 in picks} | {(k1, least) for k1 in often})

    rows = rows.withColumn("range", _range_of(F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")), bounds))
    sums = {r["range"]: (r["bytes"], r["n"]) for r in rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    before_bytes, before_rows, b, c = [], [], 0, 0
    for i in range(len(bounds) + 1):
        before_bytes.append(b)
        before_rows.append(c)
        b, c = b + sums.get(i, (0, 0))[0], c + sums.get(i, (0, 0))[1]

    def prefix(values: list[int]) -> Column:
        return F.get(_longs(values), F.col("range"))

    order = Window.partitionBy("range").orderBy("k1", "k2", "id", "size")
    group = Window.partitionBy("range", "k1")
    ranked = (
        rows.withColumn("at", prefix(before_bytes) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", prefix(before_rows) + F.row_number().over(order) - 1)
        .withColumn("g_at", F.min("at").over(group))
        .withColumn("g_size", F.sum("size").over(group))
    )
    # A row or a small group belongs to the shard in which its middle lies.
    whole = F.col("g_size") <= F.lit(split_share * total / shards)
    middle = F.when(whole, F.col("g_at") + F.col("g_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
    placed = materialize(ranked.select("id", "size", "crc", "rank", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard")))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    starts = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(shards)])
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("rank") - F.get(starts, F.col("shard"))).cast("long").alias("slot"),
    )
