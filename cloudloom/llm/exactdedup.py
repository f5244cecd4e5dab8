"""Exact dedup: immutable snapshots with static binary-fuse filters, exact buckets behind them.

A corpus arrives in batches. Each closed batch is a snapshot that never changes: its texts that no older snapshot holds, one row a text, and
a static filter over their digests. The filter is cut into segments of about a thousand digests; a segment is a 3-wise binary fuse filter of
8 bits, a row of a table. An incoming digest joins the row of its segment, three cells are compared there in SQL expressions, and one of 256
strangers passes. A new batch is treated so:

- rows are counted by digest, which moves digests and ids but no texts; copies meet in map-side sums, so a hot text costs a row a task;
- digests are screened by the filters of all snapshots;
- only rows whose digest occurs twice in the batch or passed a filter move their texts: they are grouped by digest and text, and those that
  passed a filter join the snapshot's rows of the digest, text against text;
- what no snapshot holds becomes the next snapshot.

A digest that stands for two texts is disputed; all rows of disputed digests are grouped by their texts instead, so that the result never
hangs on the digest.

Defined results: null counts as the empty text; of equal texts the row with the largest id stays, null ids before all others; of rows that repeat
id and text one stays; a copy of a text under another id counts in group_size like a repeated row; an empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, drop_folder, materialize, shared_dir

HALF = (1 << 30) - 1
SEGMENT_KEYS = 1000
_FILTER = "bucket long, buckets long, factors array<long>, length int, segments int, cells array<tinyint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _key(digest: str | Column) -> Column:
    """60 bits of a digest: what filters hold, and what narrow joins compare."""
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << 60) - 1))


def _bucket(digest: str | Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), digest), F.lit(buckets) if isinstance(buckets, int) else buckets)


# The filter: numpy builds a segment, SQL expressions look one up.


def _mixed(keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Five numbers of 30 bits for each key, by multiply and shift."""
    low, high = keys & HALF, keys >> 30
    return ((low[:, None] * factors[0::2] + high[:, None] * factors[1::2]) >> 30) & HALF


def build_segment(keys: np.ndarray, seed: int = 0) -> tuple[list[int], int, int, np.ndarray]:
    """(factors, length, segments, cells) of a 3-wise binary fuse filter over keys of 60 bits."""
    keys = np.unique(np.asarray(keys, dtype=np.int64))
    n = max(len(keys), 2)
    length = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    for attempt in range(1000):
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) * (1 + attempt // 10 * 0.1)
        segments = max(1, int(np.ceil(room / length)) - 2)
        factors = np.random.default_rng((seed, attempt)).integers(1, HALF, 10) | 1
        g = _mixed(keys, factors)
        slots = ((g[:, :1] * segments >> 30) + np.arange(3)) * length + (g[:, 1:4] & (length - 1))
        rounds = _peel(slots, (segments + 2) * length)
        if rounds is not None:
            break
    else:
        raise RuntimeError("no filter found")
    mark, cells = ((g[:, 4] & 255) - 128).astype(np.int8), np.zeros((segments + 2) * length, dtype=np.int8)
    for who, at in reversed(rounds):
        cells[at] = mark[who] ^ np.bitwise_xor.reduce(cells[slots[who]], axis=1)
    return factors.tolist(), length, segments, cells


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of keys, each with a cell that no key of a later round touches; None if some keys are left."""
    degree = np.bincount(slots.ravel(), minlength=size)
    owner = np.zeros(size, dtype=np.int64)  # the sum of the keys at a cell: the key itself, where it is the last
    np.add.at(owner, slots.ravel(), np.repeat(np.arange(len(slots)), 3))
    rounds, free, done = [], np.flatnonzero(degree == 1), 0
    while len(free):
        who, first = np.unique(owner[free], return_index=True)
        rounds.append((who, free[first]))
        touched = slots[who].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(owner, touched, np.repeat(who, 3))
        done += len(who)
        touched = np.unique(touched)
        free = touched[degree[touched] == 1]
    return rounds if done == len(slots) else None


def _passes(key: Column) -> Column:
    """Whether the filter in this row holds the key (or seems to)."""
    low, high, factors = key.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(key, 30), F.col("factors")

    def mixed(j: int) -> Column:
        return F.shiftrightunsigned(low * F.get(factors, F.lit(2 * j)) + high * F.get(factors, F.lit(2 * j + 1)), 30).bitwiseAND(F.lit(HALF))

    start = F.shiftrightunsigned(mixed(0) * F.col("segments"), 30)
    cell = [F.get("cells", ((start + i) * F.col("length") + mixed(i + 1).bitwiseAND((F.col("length") - 1).cast("long"))).cast("int")) for i in range(3)]
    return cell[0].bitwiseXOR(cell[1]).bitwiseXOR(cell[2]) == (mixed(4).bitwiseAND(F.lit(255)) - 128).cast("tinyint")


def build_filters(digests: DataFrame) -> DataFrame:
    """A row a segment over the column digest, whose values are distinct."""
    buckets = max(1, -(-digests.count() // SEGMENT_KEYS))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [build_segment(k, b) for b, k in zip(f["bucket"], f["keys"])]
            yield pd.DataFrame({
                "bucket": f["bucket"], "buckets": buckets, "factors": [m[0] for m in made],
                "length": [m[1] for m in made], "segments": [m[2] for m in made], "cells": [m[3] for m in made],
            })

    grouped = digests.groupBy(_bucket("digest", buckets).alias("bucket")).agg(F.collect_list(_key("digest")).alias("keys"))
    return grouped.mapInPandas(build, _FILTER)


# Snapshots.


@dataclass(frozen=True)
class Snapshot:
    """The folders texts (digest, text) and filters of a closed batch."""

    path: str

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("digest binary, text string").parquet(f"{self.path}/texts")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_FILTER).parquet(f"{self.path}/filters")

    def screen(self, digests: DataFrame) -> DataFrame:
        """The rows of digests that the filter lets pass: all that the snapshot holds, and one of 256 others."""
        filters = self.filters(digests.sparkSession)
        first = filters.select("buckets").first()
        if first is None:
            return digests.limit(0)
        # A segment has 1.5 KB. With more of them than are broadcast, incoming digests spread over thousands of buckets.
        met = digests.withColumn("bucket", _bucket("digest", first["buckets"])).join(bounded(filters, 4096), "bucket")
        return met.where(_passes(_key("digest"))).select(*digests.columns)


def close(texts: DataFrame, path: str) -> Snapshot:
    """Write distinct texts (digest, text) and their filter."""
    spark = texts.sparkSession
    texts.select("digest", "text").write.option("compression", "zstd").parquet(f"{path}/texts")
    snapshot = Snapshot(path)
    build_filters(snapshot.texts(spark).select("digest").distinct()).write.option("compression", "zstd").parquet(f"{path}/filters")
    return snapshot


def admit(rows: DataFrame, counts: DataFrame, snapshots: list[Snapshot], path: str | None) -> tuple[DataFrame, DataFrame, Snapshot | None]:
    """Take in a batch of rows (id, text, digest); counts: (digest, group_size) of the same rows.

    Returns (digest, first) with first the number of the snapshot that holds the text already, for no others; the disputed
    digests; and the batch's own new texts as a snapshot at path, unless that is None.
    """
    spark = rows.sparkSession
    hits = [materialize(s.screen(counts.select("digest"))) for s in snapshots]
    suspects = counts.where("group_size > 1").select(_key("digest").alias("k"))
    for h in hits:
        suspects = suspects.unionByName(h.select(_key("digest").alias("k")))
    suspects = materialize(suspects.distinct())
    small, keyed = bounded(suspects, 1 << 18), rows.withColumn("k", _key("digest"))
    checked = materialize(keyed.join(small, "k", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).select("digest", "text"))
    disputed = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    known = None
    for number, (s, h) in enumerate(zip(snapshots, hits)):
        mine = checked.join(bounded(h, 1 << 17), "digest", "left_semi")
        held = s.texts(spark).join(bounded(h, 1 << 17), "digest", "left_semi").withColumnRenamed("text", "held")
        met = mine.join(held, "digest").select("digest", "text", (F.col("text") == F.col("held")).alias("same"))
        met = materialize(met.groupBy("digest", "text").agg(F.max("same").alias("same")).withColumn("first", F.lit(number)))
        known = met if known is None else known.unionByName(met)
    if known is None:
        old = counts.select("digest", F.lit(0).alias("first")).limit(0)
    else:
        disputed = disputed.unionByName(known.where(~F.col("same")).select("digest")).distinct()
        old = known.where("same").groupBy("digest").agg(F.min("first").alias("first"))
    snapshot = None
    if path is not None:
        new = keyed.join(small, "k", "left_anti").select("digest", "text")
        more = checked if known is None else checked.join(known.where("same").select("digest", "text"), ["digest", "text"], "left_anti")
        snapshot = close(new.unionByName(more), path)
    old, disputed = materialize(old), materialize(disputed)
    for df in (suspects, checked, *hits):
        discard(df)
    return old, disputed, snapshot


def _with_class(marks: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """marks with their classes. Classes with at least a 256th of all rows, at most 256, are broadcast: no task gets a hot one whole."""
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * 256 >= F.lit(total)
    few, rest = F.broadcast(classes.where(hot)), classes.where(~hot)
    return marks.join(few, on).unionByName(marks.join(few.select(*on), on, "left_anti").join(rest, on))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 2, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a row of docs: id, keep_id, group_size, kept, text_sha256.

    The table is taken in as so many batches, dealt by a hash of the id, each against the snapshots of those before.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/cloudloom/{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", digest(F.col("text")).alias("digest"))
    arrival = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(arrivals)).cast("int")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    # A digest that is no SHA-256 needs that of the text besides.
    of_digest = F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string")
    marks = materialize(rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("m"), *([] if digest is sha256 else [F.first(sha).alias("sha")])).withColumn("arrival", arrival))
    snapshots, groups, disputed = [], [], []
    for number in range(arrivals):
        counts = materialize(marks.where(F.col("arrival") == number).groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("m").alias("group_size")))
        last = number == arrivals - 1
        old, odd, snapshot = admit(rows.where(arrival == number), counts, snapshots, None if last else f"{folder}/{number}")
        snapshots += [] if last else [snapshot]
        groups.append(counts.join(old, "digest", "left").withColumn("first", F.coalesce("first", F.lit(number))).withColumn("arrival", F.lit(number)))
        disputed.append(odd)
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    every = materialize(every)
    drop_folder(spark, folder)
    odd = disputed[0]
    for d in disputed[1:]:
        odd = odd.unionByName(d)
    odd = materialize(odd.distinct())
    # A class is a digest from the snapshot that held it first, and what later batches brought to it.
    classes = materialize(every.groupBy("digest", "first").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    if classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(odd, "digest", "left_anti").limit(1).count():
        raise RuntimeError("a filter lost a digest of its snapshot")
    hex_of = (lambda df: df.withColumn("text_sha256", of_digest)) if digest is sha256 else (lambda df: df.withColumnRenamed("sha", "text_sha256"))
    if odd.limit(1).count():
        strange = bounded(odd, 1 << 17)
        apart = rows.join(strange, "digest", "left_semi").withColumn("text_sha256", sha)
        own = materialize(apart.groupBy("digest", "text", "text_sha256", "id").agg(F.count(F.lit(1)).alias("m")))
        by_text = own.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("m").alias("group_size"))
        told = _with_class(own, materialize(by_text), ["digest", "text"])
        plain = hex_of(_with_class(marks.join(strange, "digest", "left_anti"), classes.join(strange, "digest", "left_anti"), ["digest"]))
        out = plain.select("id", "m", "keep_id", "group_size", "text_sha256").unionByName(told.select("id", "m", "keep_id", "group_size", "text_sha256"))
    else:
        out = hex_of(_with_class(marks, classes, ["digest"]))
    # Rows that repeat id and text were counted together.
    copy = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return copy.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )
