"""Connected components: in one task for edges of a bounded number, else by alternating large and small stars. Nothing is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of their component: minima along edges and pointer jumps until nothing changes."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _unite(batches):
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    names, label = _labels(np.concatenate(u), np.concatenate(v))
    apart = names != label
    yield pa.RecordBatch.from_arrays([pa.array(names[apart]), pa.array(label[apart])], names=["v", "component"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = 1 << 21) -> DataFrame:
    """(v, component) for each vertex of edges (a, b) that isn't the smallest of its component.

    Up to ``one_task`` edges (two numbers each, 32 MB) are united in one task.

    Each round hangs vertices on the smallest neighbour they know, first the larger ones, then the
    smaller ones, until nothing changes. Hubs are aggregated before they are shuffled, and joins on a hub can be split.
    """
    kept = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if kept.count() <= one_task:
        out = materialize(kept.coalesce(1).mapInArrow(_unite, "v long, component long"))
        discard(kept)
        return out
    seen = None
    for _ in range(most_rounds):
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        step = materialize(small.where("u <> v").distinct())
        mark = step.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(kept)
        kept = step
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return kept.select(F.col("u").alias("v"), F.col("v").alias("component"))
