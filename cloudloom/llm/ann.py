"""Approximate nearest neighbours through learned partitions.

A bounded sample of the vectors gets its exact neighbour graph. The graph is cut into balanced parts: a coarse start by
recursive bisection, then rounds in which each vector moves to the part where most of its neighbours are, as far as parts
have room. A small classifier (one hidden layer, softmax over parts) learns to name the part from the vector, with the parts of a vector's
neighbours as soft labels. Every vector of the table is indexed under its ``copies`` most probable parts; a query probes its
most probable ones, as many as held-back vectors need for the recall sought, and reranks what it finds there by exact distances.

All vectors are indexed, only the fit is on a sample. A part that is too large for one task is split by hash, and
each split answers each query that probes it; equal vectors collapse to one row with a list of ids, of which no answer needs
more than k, so a hot vector costs what one vector does. Vectors are told apart by 64-bit hashes when answers go back to ids.

Defined results: vectors that are null, zero, of another length than the most common one, or hold null or non-finite components take no part,
neither as queries nor as candidates; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an
empty table; repeated rows are separate candidates of the same id; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def exact_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest others of each row."""
    n = len(x)
    k = min(k, n - 1)
    x = x - x.mean(axis=0)  # far from the origin products lose the digits that tell vectors apart
    norm = (x**2).sum(axis=1)
    out = np.empty((n, k), dtype=np.int64)
    for lo in range(0, n, block):
        d = norm[None, :] - 2.0 * x[lo : lo + block] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them."""
    rng = np.random.default_rng(seed)
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [(np.arange(n), parts, 0)]
    while groups:
        rows, many, first = groups.pop()
        if many == 1 or len(rows) < 2:
            part[rows] = first
            continue
        own = x[rows] - x[rows].mean(axis=0)
        line = rng.standard_normal(x.shape[1])
        for _ in range(12):  # the main direction
            line = own.T @ (own @ line)
            line /= np.linalg.norm(line) + 1e-12
        order = np.argsort(own @ line, kind="stable")
        left = many // 2
        cut = len(rows) * left // many
        groups += [(rows[order[:cut]], left, first), (rows[order[cut:]], many - left, first + left)]
    # Edges in both directions.
    a = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    b = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    room = int(np.ceil(n / parts * (1 + slack)))
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.float32)
        np.add.at(votes, (a, part[b]), 1.0)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moves = np.flatnonzero(gain > 0)
        if not len(moves):
            break
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in moves[np.argsort(-gain[moves], kind="stable")].tolist():
            to = best[i]
            if size[to] < room:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer over standardised vectors."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0.0, ((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def most_probable(self, x: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-self.log_odds(x), axis=1, kind="stable")[:, :many]


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 0) -> Router:
    """Cross-entropy against soft labels with Adam."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    z = (x - mean) / scale
    d, parts = x.shape[1], target.shape[1]
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), batch):
            own = order[lo : lo + batch]
            xb, yb = z[own], target[own]
            pre = xb @ p[0] + p[1]
            h = np.maximum(0.0, pre)
            out = h @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            g = (out - yb) / len(own)
            gh = (g @ p[2].T) * (pre > 0)
            grads = [xb.T @ gh + 1e-5 * p[0], gh.sum(axis=0), h.T @ g + 1e-5 * p[2], g.sum(axis=0)]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


def fit(sample: np.ndarray, parts: int, neighbours: int = 10, seed: int = 0) -> Router:
    graph = exact_graph(sample, neighbours)
    part = balanced_parts(sample, graph, parts, seed=seed)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 0.5 / max(1, graph.shape[1]))
    target[np.arange(len(sample)), part] += 1.0 - target.sum(axis=1)
    return train_router(sample, target, seed=seed)


def probes_for(router: Router, sample: np.ndarray, asked: np.ndarray, k: int, copies: int, recall: float) -> int:
    """The fewest probes at which the sample's k nearest of held-back vectors are found in the share sought."""
    parts = router.w2.shape[1]
    if not len(asked) or not len(sample):
        return parts
    homes = router.most_probable(sample, copies)
    order = router.most_probable(asked, parts)
    place = np.empty_like(order)  # of each part, when a query would probe it
    np.put_along_axis(place, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    k = min(k, len(sample))
    centre = sample.mean(axis=0)
    sample, asked = sample - centre, asked - centre
    rough = (sample**2).sum(axis=1)[None, :] - 2.0 * asked @ sample.T
    near = np.argpartition(rough, k - 1, axis=1)[:, :k]
    when = place[np.arange(len(asked))[:, None, None], homes[near]].min(axis=2)
    share = np.cumsum(np.bincount(when.ravel(), minlength=parts)) / when.size
    return int(np.searchsorted(share, recall) + 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: v is an array of double."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(sound)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (width["n"] if width else 0))


def search(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    sample_rows: int = 6000,
    rows_per_part: int = 250,
    most_parts: int = 256,
    rows_per_split: int = 6000,
    recall: float = 0.95,
    copies: int = 2,
    seed: int = 0,
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k nearest found. is_query: a condition on the column ``id``.

    sample_rows: the bound of the sample for the fit, drawn by hash. rows_per_part: vectors to a part, up to most_parts parts; beyond that parts grow, and
    one of more than rows_per_split vectors is answered in several tasks.
    recall: a query visits as many parts as held-back vectors (a sixth of the sample) need to find this share of their neighbours.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Equal vectors are one row. No answer holds more than k of them, and one more for the query itself.
    single = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    distinct = materialize(single.select("v", "n", F.col("least").alias("id")).withColumn("h", F.xxhash64("v")))
    total = distinct.count()
    picked = distinct.orderBy(F.xxhash64(F.lit(seed), "h"), "id").limit(sample_rows).select("v").collect()
    sample = np.array([r["v"] for r in picked], dtype=np.float64).reshape(len(picked), -1 if picked else 1)
    parts = int(min(most_parts, max(1, round(total / rows_per_part)), max(1, len(sample) // 20)))
    kept = len(sample) - len(sample) // 6
    router = fit(sample[:kept], parts, seed=seed) if parts > 1 else None
    many = min(parts, probes_for(router, sample[:kept], sample[kept:], k, min(copies, parts), recall)) if router else 1
    shared = spark.sparkContext.broadcast(router)  # of the size of its layers

    def route(times: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                if shared.value is None:
                    at = np.zeros((batch.num_rows, 1), dtype=np.int64)
                else:
                    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    at = shared.value.most_probable(x, times)
                row = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(at.ravel().astype(np.int32))], names=["id", "v", "h", "part"])

        return run

    # A vector goes by the hash of its components: an id may stand for several.
    routed = "id long, v array<double>, h long, part int"
    index = materialize(distinct.select("id", "v", "h").mapInArrow(route(min(copies, parts)), routed))
    held = dict(index.groupBy("part").count().collect())
    cut = [max(1, -(-held.get(p, 0) // rows_per_split)) for p in range(parts)]  # splits of each part
    splits = F.get(F.split(F.lit(",".join(map(str, cut))), ",").cast("array<int>"), F.col("part"))
    index = index.withColumn("split", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), splits).cast("int"))
    # Equal queries are one query; where(is_query) is on all ids, not on the least of a group.
    asked = rows.where(is_query).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    asked = asked.select("id", "v", F.xxhash64("v").alias("h")).mapInArrow(route(many), routed).withColumn("split", F.explode(F.sequence(F.lit(0), splits - 1)))

    def rerank(queries: pa.Table, own: pa.Table) -> pa.Table:
        q, c = _matrix(queries["v"]), _matrix(own["v"])
        ids, prints, out = own["id"].to_numpy(), own["h"].to_numpy(), [[], [], [], []]
        names = queries["h"].to_numpy()
        for lo in range(0, len(q) if len(c) else 0, 256):
            # k + 1: the query's own vector may be among them.
            for i, (top, row) in enumerate(_nearest(q[lo : lo + 256], c, k + 1)):
                order = np.lexsort((ids[top], row))[: k + 1]
                out[0] += [names[lo + i]] * len(order)
                out[1] += prints[top[order]].tolist()
                out[2] += ids[top[order]].tolist()
                out[3] += row[order].tolist()
        return pa.table({"q": pa.array(out[0], pa.int64()), "c": pa.array(out[1], pa.int64()), "least": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    found = asked.groupBy("part", "split").cogroup(index.groupBy("part", "split")).applyInArrow(rerank, "q long, c long, least long, score double").distinct()
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "least", "c"))), 1, k + 1).alias("top"))
    best = materialize(best)
    # Back from vectors to all ids: of a group of equal vectors at most the k + 1 smallest are ever needed.
    ends = best.select(F.explode("top").alias("t")).select(F.col("t.c").alias("rep")).distinct()
    members = rows.select("id", F.xxhash64("v").alias("h")).join(ends, F.col("h") == F.col("rep")).select("rep", "id")
    # The limit works inside each task before rows are shuffled, so a hot vector sends a few ids from each.
    order = Window.partitionBy("rep").orderBy("id")
    members = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    members = members.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    wide = best.select("q", F.explode("top").alias("t")).select("q", "t.score", "t.c")
    wide = wide.join(members, F.col("c") == F.col("rep")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "ids"))).alias("top"))
    # Each query with its own answer: a row less that of itself.
    own = rows.where(is_query).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("rep")).distinct()
    flat = F.flatten(F.transform("top", lambda t: F.transform(t["ids"], lambda i: F.struct(t["score"].alias("score"), i.alias("id")))))
    answer = own.join(wide, F.col("rep") == F.col("q")).select("query_id", F.sort_array(flat).alias("all"))
    answer = answer.select("query_id", F.slice(F.filter("all", lambda t: t["id"] != F.col("query_id")), 1, k).alias("all"))
    out = answer.select("query_id", F.posexplode("all").alias("at", "t"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias(id_col), F.col("t.score").alias("score"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    if not len(lists):
        return np.zeros((0, 1))
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _nearest(q: np.ndarray, c: np.ndarray, k: int):
    """For each query the rows of c that may be among its k nearest, ties at the border included, and their Euclidean distances.

    Candidates are picked by products of centred vectors, with a margin above what rounding can do to them; distances are
    worked out from the differences of the original vectors.
    """
    centre = c.mean(axis=0)
    a, b = q - centre, c - centre
    na, nb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    rough = na[:, None] + nb[None, :] - 2.0 * a @ b.T
    tiny, width = np.finfo(np.float64).eps, c.shape[1]
    # Rounding of the products, and of the coordinates when they were centred.
    moved = tiny * (np.abs(centre).max() + max(np.abs(q).max(), np.abs(c).max()))
    for i in range(len(q)):
        row = rough[i]
        top = np.arange(len(row))
        if len(row) > k:
            border = max(0.0, np.partition(row, k - 1)[k - 1])
            error = 8.0 * width * tiny * (na[i] + nb.max()) + 4.0 * np.sqrt(width * max(border, 0.0)) * moved + 4.0 * width * moved * moved
            top = np.flatnonzero(row <= border + 2.0 * error + 8.0 * np.sqrt(width * error) * moved)
        yield top, np.sqrt(((q[i] - c[top]) ** 2).sum(axis=1))
