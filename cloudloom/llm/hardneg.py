"""Hard-negative mining over a stored pivot table.

Every vector gets one component more, which lifts all of them to the largest norm M; an anchor gets a zero there. Then
|anchor - row|^2 = |anchor|^2 + M^2 - 2 score, so large inner products are small Euclidean distances. The distances of all rows to a few
pivots are stored. By the triangle inequality the pivot distances of an anchor and a row bracket their distance, hence their
score; only rows whose bracket meets what is sought are checked exactly, in whole numbers.

Anchors are the stated query set: blocks of anchors meet blocks of rows (those nearest to a pivot, cut by hash where they are many), one pair of blocks a
group. A bounded sample of rows gives each anchor a first bound for its k-th best; the bound only saves work, every row is bracketed. Each pair
of blocks hands on at most k rows for each list that it serves.

Defined results: rows take part if label and vector are there, with neither null nor non-finite components, of the most common length (ties: the shorter),
not empty, and with components whose inner products fit a long; of rows equal in id, label and vector one counts; "other
rows" have another id than the anchor; a null id is no anchor and comes after all others in ties; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, discard, materialize

_NO_ID = np.iinfo(np.int64).max
_EXACT = float(1 << 53)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Distinct rows (id, label, v) that take part, v whole numbers; and the length of v."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(v, lambda x: F.abs(x) < float("inf")), F.lit(False)) & ~F.exists(v, lambda x: F.isnan(x))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where(F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    longest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if longest is None:
        return rows.withColumn("v", F.col("v").cast("array<long>")), 0
    most = int(np.sqrt((_NO_ID) / longest["n"])) - 1
    fits = (F.size("v") == longest["n"]) & F.forall("v", lambda x: F.abs(x) <= float(most))
    return rows.where(fits).withColumn("v", F.transform("v", lambda x: F.floor(x).cast("long"))).distinct(), longest["n"]


def _numbers(t: pa.Table | pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = t.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _plain(t: pa.Table, name: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    return (column.fill_null(_NO_ID) if pa.types.is_integer(column.type) else column).to_numpy(zero_copy_only=False)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers as longs; in doubles where those hold every sum exactly."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def choose_pivots(v: np.ndarray, many: int, top: float) -> np.ndarray:
    """Rows of v far apart after the lift, the longest first."""
    lifted = np.hstack([v, np.sqrt(np.maximum(0.0, top - (v**2).sum(axis=1)))[:, None]])
    chosen = [int((v**2).sum(axis=1).argmax())]
    near = np.full(len(v), np.inf)
    while len(chosen) < min(many, len(v)):
        near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return v[chosen]


class _Brackets:
    """Bounds of the scores between one anchor and rows, from stored distances."""

    def __init__(self, stored: np.ndarray, top: float):
        self.stored, self.top, self.slack = stored, top, 1e-6 * np.sqrt(top)

    def of(self, distances: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        near = np.maximum(0.0, np.abs(self.stored - distances).max(axis=1) - self.slack)
        far = (self.stored + distances).min(axis=1) + self.slack
        room = 1e-9 * (square + self.top) + 0.5
        return (square + self.top - far**2) / 2 - room, (square + self.top - near**2) / 2 + room


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        at_least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= at_least)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def mine(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    pivots: int = 16,
    sample_rows: int = 2048,
    rows_per_block: int = 8192,
    anchors_per_block: int = 2048,
) -> DataFrame:
    """For each anchor (a condition on the column id) and each of its positives, the best rows of other labels whose score lies between
    low and high hundredths of the positive's.

    sample_rows bounds the rows that pivots and first bounds come from.
    """
    spark = vectors.sparkSession
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, dim = usable(vectors, id_col, vector_col, label_col)
    if not dim:
        return spark.createDataFrame([], out_schema)
    square = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(rows.withColumn("q", square(F.col("v"))))
    top, n = rows.agg(F.max("q"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], out_schema)
    exact = top < _EXACT
    drawn = rows.orderBy(F.xxhash64(F.lit(3), "id", "v"), "label").limit(sample_rows).select("id", "label", "v").toArrow()
    s_id, s_label, s_v = _plain(drawn, "id"), _plain(drawn, "label"), _numbers(drawn, "v", dim)
    points = choose_pivots(s_v.astype(np.float64), pivots, top)
    many, p_square = len(points), (points**2).sum(axis=1)
    p_lift = np.sqrt(np.maximum(0.0, top - p_square))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, q = _numbers(b, "v", dim).astype(np.float64), b.column("q").to_numpy()
            dots, lift = v @ points.T, np.sqrt(np.maximum(0.0, top - q))
            d = np.sqrt(np.maximum(0.0, 2 * top - 2 * (dots + lift[:, None] * p_lift)))
            own = np.sqrt(np.maximum(0.0, q[:, None] + top - 2 * dots))  # as an anchor: nothing in the added place
            more = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), many).cast(pa.list_(pa.float64())) for x in (d, own)]
            cell = pa.array(d.argmin(axis=1).astype(np.int32)) if len(d) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *more, cell], names=[*b.schema.names, "d", "own", "cell"])

    table = materialize(rows.mapInArrow(distances, "id long, label long, v array<long>, q double, d array<double>, own array<double>, cell int"))
    discard(rows)
    # Blocks: the rows nearest to a pivot, dealt by hash where they are many.
    sizes = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    cuts = [-(-sizes.get(c, 0) // rows_per_block) for c in range(many)]
    first = [sum(cuts[:c]) for c in range(many)]
    as_array = lambda x: F.array(*[F.lit(i).cast("long") for i in x])
    block = F.get(as_array(first), F.col("cell")) + F.pmod(F.xxhash64(F.lit(4), "id", "v"), F.get(as_array(cuts), F.col("cell")))
    blocks = sum(cuts)
    asked = materialize(table.where(F.col("id").isNotNull() & F.coalesce(anchors, F.lit(False))).withColumn("a", F.monotonically_increasing_id()).select("a", "id", "label", "v", "q", "own"))
    groups = max(1, -(-asked.count() // anchors_per_block))
    candidates = table.select("id", "label", "v", "d", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).groupBy("block", "group")

    def meet(asking: DataFrame, job, schema: str) -> DataFrame:
        """job for each block of rows and group of anchors."""
        spread = asking.withColumn("group", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return candidates.cogroup(spread.groupBy("block", "group")).applyInArrow(job, schema)

    def best_same(these: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if these.num_rows and ask.num_rows:
            ids, labels, v = _plain(these, "id"), _plain(these, "label"), _numbers(these, "v", dim)
            bracket = _Brackets(_numbers(these, "d", many), top)
            a_key, a_id, a_label, a_v, a_own, a_q = _plain(ask, "a"), _plain(ask, "id"), _plain(ask, "label"), _numbers(ask, "v", dim), _numbers(ask, "own", many), _plain(ask, "q")
            seen = products(s_v, a_v, exact)
            for i in range(len(a_key)):
                known = seen[(s_label == a_label[i]) & (s_id != a_id[i]), i]
                least = np.partition(known, len(known) - positives)[len(known) - positives] if len(known) >= positives else np.iinfo(np.int64).min
                _, upper = bracket.of(a_own[i], a_q[i])
                left = np.flatnonzero((upper >= least) & (labels == a_label[i]) & (ids != a_id[i]))
                score = products(v[left], a_v[i : i + 1], exact)[:, 0]
                left, score = left[score >= least], score[score >= least]
                for j in _best(score, ids[left], positives):
                    _add(out, a_key[i], ids[left[j]], score[j])
        return _answer(out, "a", "p_id", "p_score")

    found = meet(asked, best_same, "a long, p_id long, p_score long")
    order = Window.partitionBy("a").orderBy(F.desc("p_score"), F.asc_nulls_last("p_id"))
    found = materialize(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives))
    listed = found.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("r", "p_id", "p_score"))).alias("p"))  # at most ``positives`` each
    asked = materialize(asked.join(listed, "a").withColumn("scores", F.transform("p", lambda x: x["p_score"])))

    def best_other(these: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if these.num_rows and ask.num_rows:
            ids, labels, v = _plain(these, "id"), _plain(these, "label"), _numbers(these, "v", dim)
            bracket = _Brackets(_numbers(these, "d", many), top)
            a_key, a_id, a_label, a_v, a_own, a_q = _plain(ask, "a"), _plain(ask, "id"), _plain(ask, "label"), _numbers(ask, "v", dim), _numbers(ask, "own", many), _plain(ask, "q")
            seen, wanted = products(s_v, a_v, exact), ask.column("scores").to_pylist()
            for i in range(len(a_key)):
                known = seen[(s_label != a_label[i]) & (s_id != a_id[i]), i]
                spans = []
                for p in wanted[i]:
                    least, most = -(-low * p // 100), high * p // 100  # whole numbers of Python: no overflow
                    inside = known[(known >= least) & (known <= most)]
                    if len(inside) >= negatives:
                        least = int(np.partition(inside, len(inside) - negatives)[len(inside) - negatives])
                    spans.append((least, most))
                lower, upper = bracket.of(a_own[i], a_q[i])
                left = np.flatnonzero((upper >= min(s[0] for s in spans)) & (lower <= max(s[1] for s in spans)) & (labels != a_label[i]) & (ids != a_id[i]))
                score = products(v[left], a_v[i : i + 1], exact)[:, 0]
                for r, (least, most) in enumerate(spans):
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    for j in inside[_best(score[inside], ids[left[inside]], negatives)]:
                        _add(out, a_key[i], r + 1, ids[left[j]], score[j])
        return _answer(out, "a", "r", "n_id", "n_score")

    against = meet(asked.select("a", "id", "label", "v", "q", "own", "scores"), best_other, "a long, r long, n_id long, n_score long")
    order = Window.partitionBy("a", "r").orderBy(F.desc("n_score"), F.asc_nulls_last("n_id"))
    ranked = against.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = asked.select("a", F.col("id").alias("anchor_id"), F.explode("p").alias("p")).select("a", "anchor_id", F.col("p.r").cast("long").alias("r"), F.col("p.p_id").alias("positive_id"), F.col("p.p_score").alias("positive_score"))
    return ranked.join(bounded(pairs), ["a", "r"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("n_id").alias("negative_id"), "positive_score", F.col("n_score").alias("negative_score"))


def _add(out: list[list], *values) -> None:
    for column, x in zip(out, values):
        column.append(int(x))


def _answer(out: list[list], *names: str) -> pa.Table:
    columns = [pa.array([None if x == _NO_ID else x for x in c] if n.endswith("_id") else c, pa.int64()) for n, c in zip(names, out)]
    return pa.table(columns, names=list(names))
