"""MinHash near-dedup as a chosen-path set similarity join.

Documents with the same shingle set collapse into one representative. Each representative has a MinHash
sketch. In each of several independent trees a node picks one or two places of the sketch (4/3 on average, the inverse of the
similarity sought) and its documents branch by their minwise tokens there, so that a similar pair stays together
along some path with a chance that hardly falls with depth. Nodes of up to ``leaf`` documents are compared
exhaustively. A larger node draws hubs at random, about equally many from each component found so far, and compares them with
all its documents; these links are confirmed on full sets at once. A node all of whose documents confirmed links join has nothing
left to compare. One with at most ``whole`` pairs between components is compared exhaustively, block against block;
any other branches on with all its documents, so that those linked to different hubs meet again. At the last depth
every node is compared exhaustively, however large.

Links come in two steps, and no step writes out pairs of a group:

1. Each document of a node proposes its likeliest partner by the sketches, and a spanning forest of the likely pairs of a node is proposed;
   these pairs, fewer than two a document, are confirmed on full sets and joined to components.
2. Nodes that still hold several components keep the documents that have a partner in another one with a sufficient estimate. The full
   sets of these documents meet in one task, which intersects every such pair of different components and gives a link for each two components it joins.

What was not confirmed joins nothing. Documents, sketches, links and components are never collected.

Chance of missing a pair at the threshold: it meets in a tree's depth 1 with 0.81, depth 3 with 0.60, depth 6, the last, with 0.44, so
16 trees miss 0.0001 there and less before; the sketch estimate's slack (``slack``) misses another 0.0004.

Defined results: a null text is an empty one; a text without words has no shingles and is linked with nothing; a
text of fewer words than a shingle has one, of all its words; repeated rows form a group; should rows of one id have different texts, one of
them stands for the id; an empty table gives an empty table; extra columns are ignored by ``group`` and kept by ``dedup``, whatever their
names. Ids are integers; a row with a null id stays by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, spare, tidy
from .components import components
from .shingles import mix, shingle_sets

PLACES = 96


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, PLACES, dtype=np.uint32)


def sketch(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    x = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
    out = np.full(PLACES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 4096):
        y = np.multiply.outer(a, x[lo : lo + 4096])
        y += b[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def branches(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, document) rows: which row each comes from, and its key. 4/3 for each row on average."""
    keys = keys.astype(np.uint64)
    chance = mix(keys ^ np.uint64(0x51ED270B))
    row = np.arange(len(keys))
    place = (chance % np.uint64(PLACES)).astype(np.int64)
    twice = np.flatnonzero((chance >> np.uint64(40)) % np.uint64(3) == 0)
    more = (place[twice] + 1 + ((chance[twice] >> np.uint64(20)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    row, place = np.concatenate((row, twice)), np.concatenate((place, more))
    token = sketches[row, place].astype(np.uint64)
    return row, mix(mix(keys[row] + np.uint64(0x632BE5AB)) ^ mix(token * np.uint64(PLACES) + place.astype(np.uint64)))


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, PLACES)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from the low bytes of two rows of sketches."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _proposals(n: int, a: np.ndarray, b: np.ndarray, est: np.ndarray, sure: float) -> np.ndarray:
    """Which candidate pairs of a node to confirm first, fewer than two a document: each document's best, and a forest of the sure ones."""
    order = np.argsort(-est, kind="stable")
    first = np.unique(np.stack((a[order], b[order]), axis=1), return_index=True)[1] // 2
    sure_ones = order[est[order] >= sure]
    forest = sure_ones[_tree(n, a[sure_ones], b[sure_ones], est[sure_ones])] if len(sure_ones) else sure_ones
    return np.union1d(order[first], forest).astype(np.int64)


def group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    trees: int = 16,
    leaf: int = 128,
    hubs: int = 512,
    depth: int = 6,
    whole: int = 1 << 22,
    slack: float = 0.15,
    sure: float = 0.80,
    seed: int = 3,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    percent: pairs with 100 * intersection >= percent * union are linked. sure: the estimate from which a pair is taken
    as similar while candidates are chosen; every link is confirmed on full sets all the same. whole: a large node with
    at most so many pairs between components is compared exhaustively at once, at the last depth every node is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    a, b = _coefficients(seed)

    def profile(batches):
        for batch in batches:
            n, d1, d2, sk, low = [], [], [], [], []
            for s in shingle_sets(batch.column(1).cast(pa.string()), words):
                n.append(len(s))
                d1.append(s.sum(dtype=np.uint64).astype(np.int64).item())
                d2.append(np.bitwise_xor.reduce(mix(s + np.uint64(0x1B873593)), initial=np.uint64(0)).astype(np.int64).item())
                own = sketch(s, a, b) if len(s) else np.zeros(0, np.uint32)
                sk.append(own.tobytes())
                low.append(own.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary()), pa.array(low, pa.binary())],
                names=["id", "n", "d1", "d2", "sketch", "low"],
            )
        tidy()

    profiles = materialize(rows.mapInArrow(profile, "id long, n long, d1 long, d2 long, sketch binary, low binary"))
    filled = profiles.where("n > 0 and id is not null")
    # The document of the smallest id stands for a class; copies are combined in each task before they are shuffled.
    reps = filled.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "sketch", "low")).alias("x"))
    reps = materialize(reps.select("n", "d1", "d2", F.col("x.id").alias("rep"), "x.sketch", "x.low"))
    classes = reps.select("n", "d1", "d2", "rep")
    lows = reps.select("rep", "low")

    def plant(batches):
        for batch in batches:
            sketches, ids = _matrix(batch.column(1), np.uint32), batch.column(0).to_numpy()
            for tree in range(trees if len(ids) else 0):
                root = mix(np.full(1, 1000003 * seed + tree, dtype=np.uint64))
                row, key = branches(np.repeat(root, len(ids)), sketches)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[row])], names=["key", "rep"])

    def branch(batches):
        for batch in batches:
            row, key = branches(batch.column(0).to_numpy(), _matrix(batch.column(2), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(batch.column(1).to_numpy()[row])], names=["key", "rep"])

    least = percent / 100 - slack
    links = _Links(rows, words, percent)
    sketches = reps.select(F.col("rep").alias("r"), "sketch")
    member = "key long, rep long"
    members = reps.select("rep", "sketch").mapInArrow(plant, member)
    leaves, blocks, used = [], [], []
    for level in range(depth):
        if level:
            members = members.distinct()
        members = materialize(members)
        sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("n > 1"))
        used += [members, sizes]
        last = level == depth - 1
        some = members.withColumnRenamed("key", "k").join(bounded(sizes.where(f"n between 3 and {leaf}").select("key")), F.col("k") == F.col("key"))
        lists = some.groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m")).select("m")
        lists = lists.unionByName(sizes.where("n = 2").select(F.array("r0", "r1").alias("m"))).distinct()
        leaves.append(materialize(lists))
        big = sizes.where(f"n > {leaf}").select("key")
        if big.isEmpty():
            break
        large = materialize(members.withColumnRenamed("key", "k").join(bounded(big), F.col("k") == F.col("key")).select("key", "rep"))
        links.confirm(_hub_links(links.label(large, "rep", "c"), lows, hubs, least, sure, seed + level))
        # A node goes on, whole, unless confirmed links join all its documents or what is left is few pairs.
        now = materialize(links.label(large, "rep", "c"))
        counts = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
        nodes = counts.groupBy(F.col("key").alias("k")).agg(F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("x"))
        nodes = nodes.select("k", "n", F.col("x.m").alias("n_major"), F.col("x.c").alias("major")).where("n > n_major")
        nodes = materialize(nodes.withColumn("ends", F.lit(last) | ((F.col("n") - F.col("n_major")) * F.col("n") <= whole)))
        blocks.append(materialize(_blocks(now.join(nodes.where("ends"), F.col("key") == F.col("k")))))
        used += [large, now, nodes]
        goes_on = nodes.where("not ends")
        if last or goes_on.isEmpty():
            break
        goes_on = materialize(large.join(bounded(goes_on), F.col("key") == F.col("k"), "left_semi"))
        used.append(goes_on)
        members = bounded(goes_on).join(sketches, F.col("rep") == F.col("r")).select("key", "rep", "sketch").mapInArrow(branch, member)

    lists = leaves[0]
    for more in leaves[1:]:
        lists = lists.unionByName(more)
    lists = lists.distinct().select(F.xxhash64("m").alias("list"), F.explode("m").alias("rep"), F.lit(0).alias("side"))
    for more in blocks:
        lists = lists.unionByName(more)
    lists = materialize(lists)
    for x in [*leaves, *blocks, *used]:
        discard(x)
    # First what most likely connects the documents of a node, then every pair of it that confirmed links don't join.
    links.confirm(_compare(lists, lows, links, least, sure))
    links.within(_close(lists, lows, links, least))
    discard(lists)
    answer = links.labels(spark)

    own = classes.join(answer, F.col("rep") == F.col("v"), "left").select(
        F.col("n").alias("cn"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("c")
    )
    alike = (F.col("n") == F.col("cn")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & F.col("id").isNotNull()
    out = profiles.drop("sketch", "low").join(own, alike, "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _dealt(lists: DataFrame, lows: DataFrame, links: _Links) -> DataFrame:
    """Lists that hold several components, with sketches, dealt into buckets of about 20,000 rows."""
    own = materialize(links.label(lists, "rep", "c"))
    mixed = own.groupBy(F.col("list").alias("l")).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 < c1")
    mixed = materialize(mixed.select("l", "m"))
    buckets = max(64, int(mixed.agg(F.sum("m")).first()[0] or 0) // 20_000)
    own = own.join(bounded(mixed.select("l")), F.col("list") == F.col("l"), "left_semi")
    dealt = own.join(lows.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("list", "rep", "side", "c", "low")
    return dealt.withColumn("bucket", F.pmod("list", F.lit(buckets)))


def _nodes(table: pa.Table):
    """The rows of each list of a bucket: (ids, components, sides, sketches, order in the table)."""
    ids, of, comp = table["rep"].to_numpy(), table["list"].to_numpy(), table["c"].to_numpy()
    side = table["side"].to_numpy()
    order = np.lexsort((ids, of))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(of[order])) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[lo:hi]
        yield ids[own], comp[own], side[own], own


def _compare(lists: DataFrame, lows: DataFrame, links: _Links, least: float, sure: float) -> DataFrame:
    """Pairs (a, b, est) that most likely connect the documents of lists (list, rep, side), fewer than two a document.

    Documents of side 0 are compared with all others of the list, those of sides 1 and 2 with the other side only.
    """

    def run(table: pa.Table) -> pa.Table:
        low = _matrix(table["low"], np.uint8)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for ids, comp, side, own in _nodes(table):
            i, j, est = _near(low[own], comp, side, least)
            if len(i):
                keep = _proposals(len(ids), i, j, est, sure)
                out.append((ids[i[keep]], ids[j[keep]], est[keep]))
        columns = [np.concatenate(c) for c in zip(*out)]
        tidy()
        return pa.table({"a": columns[0], "b": columns[1], "est": columns[2]})

    return _dealt(lists, lows, links).groupBy("bucket").applyInArrow(run, "a long, b long, est double").distinct()


def _close(lists: DataFrame, lows: DataFrame, links: _Links, least: float) -> DataFrame:
    """The documents (list, rep, side, c) that still have a partner in another component with an estimate of at least ``least``."""

    def run(table: pa.Table) -> pa.Table:
        low, keep = _matrix(table["low"], np.uint8), [np.zeros(0, np.int64)]
        for _, comp, side, own in _nodes(table):
            i, j, _ = _near(low[own], comp, side, least)
            keep.append(own[np.unique(np.concatenate((i, j)))])
        return table.select(["list", "rep", "side", "c"]).take(pa.array(np.concatenate(keep)))

    return _dealt(lists, lows, links).groupBy("bucket").applyInArrow(run, "list long, rep long, side int, c long")


def _united(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) on full sets that join the components of a node: a pair is intersected unless links found before join it."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.cumsum(size) - size
    # Components by number, the largest last: among its documents nothing is left to compare.
    names, label, n = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.argsort(label == n.argmax(), kind="stable")
    mark, out = np.zeros(int(flat.max()) + 1, dtype=bool), []
    label = label.astype(np.int64)
    for i in order[: len(order) - n.max()].tolist():
        if (label == label[i]).all():
            break
        own = flat[at[i] : at[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat].astype(np.int32), at)
        mark[own] = False
        near = 100 * both >= percent * (size + size[i] - both)
        near &= (label != label[i]) & ((side == 0) | (side[i] == 0) | (side != side[i]))
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _near(low: np.ndarray, comp: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of different components, and of different sides if any, with an estimate of at least ``least``."""
    if len(comp) == 2:  # by far the most lists
        est = _agreement(low[:1], low[1:])
        keep = (est >= least) & (comp[0] != comp[1]) & ((side[0] == 0) | (side[0] != side[1]))
        return np.zeros(int(keep.sum()), np.int64), np.ones(int(keep.sum()), np.int64), est[keep]
    names, index, n = np.unique(comp, return_inverse=True, return_counts=True)
    # Documents of the largest component come last: among themselves they need no comparison.
    order = np.argsort(index == n.argmax(), kind="stable")
    x, y, e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, i in enumerate(order[: len(order) - n.max()].tolist()):
        j = order[k + 1 :]
        j = j[(index[j] != index[i]) & ((side[i] == 0) | (side[j] != side[i]))]
        est = _agreement(low[i], low[j])
        good = est >= least
        j = j[good]
        x.append(np.minimum(i, j))
        y.append(np.maximum(i, j))
        e.append(est[good])
    return np.concatenate(x), np.concatenate(y), np.concatenate(e)


def _blocks(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """Lists (list, rep, side) in which all pairs of large nodes (key, rep, c, n, n_major, major) meet that lie in different components.

    The largest component of a node has blocks of its own, which aren't paired with each other.
    """
    others, own = F.ceil((F.col("n") - F.col("n_major")) / block), F.ceil(F.col("n_major") / block)
    at = F.xxhash64("rep")
    dealt = nodes.withColumn("others", others).withColumn("x", F.when(F.col("c") == F.col("major"), others + F.pmod(at, own)).otherwise(F.pmod(at, others)))
    all_blocks = F.col("others") + own
    # Block x meets the blocks below others before it, itself, and if it is below others all after it.
    before = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    after = F.sequence(F.lit(0).cast("long"), all_blocks - 1)
    dealt = dealt.select("key", "rep", "x", F.explode(F.when(F.col("x") < F.col("others"), after).otherwise(before)).alias("y"))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    return dealt.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("list"), "rep", side.alias("side"))


def _hub_links(large: DataFrame, lows: DataFrame, hubs: int, least: float, sure: float, seed: int) -> DataFrame:
    """Candidate links (a, b, est) of documents (key, rep, c) in large nodes with hubs of other components.

    Each component of a node has about equally many hubs. Which documents are hubs follows from the document and the level alone, so the
    nodes of a group in different trees mostly propose the same links. Members go in chunks, each of which meets all hubs of its node.
    """
    counts = large.groupBy(F.col("key").alias("k"), F.col("c").alias("kc")).agg(F.count(F.lit(1)).alias("m"))
    nodes = counts.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n_c"), F.ceil(F.sum("m") / 1000).alias("chunks")).where("n_c > 1")
    shares = counts.join(nodes, F.col("k") == F.col("key")).select("k", "kc", "m", "n_c", "chunks")
    dealt = large.join(shares, (F.col("key") == F.col("k")) & (F.col("c") == F.col("kc")))
    dealt = dealt.join(lows.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"))
    dealt = materialize(dealt.select("key", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), "rep", "c", "low", "m", "n_c", "chunks"))
    chance = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30))
    hub = dealt.where(chance < F.lit(hubs * float(1 << 30)) / F.col("n_c") / F.col("m"))
    hub = hub.select(F.col("key").alias("hk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("hc"), F.col("rep").alias("hrep"), F.col("c").alias("hcomp"), F.col("low").alias("hs"))
    own = dealt.select("key", "chunk", "rep", "c", "low")
    found = own.groupBy("key", "chunk").cogroup(hub.groupBy("hk", "hc")).applyInArrow(_grow(least, sure), "a long, b long, est double")
    out = materialize(found.distinct())
    discard(dealt)
    return out


def _grow(least: float, sure: float):
    """For the documents of a chunk: links to hubs, and ties between hubs."""

    def run(own: pa.Table, hubs: pa.Table) -> pa.Table:
        ids, names = own["rep"].to_numpy(), hubs["hrep"].to_numpy()
        a, b, e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(names) and len(ids):
            low, theirs = _matrix(own["low"], np.uint8), _matrix(hubs["hs"], np.uint8)
            est = np.stack([_agreement(low, h) for h in theirs], axis=1).astype(np.float32)
            est[own["c"].to_numpy()[:, None] == hubs["hcomp"].to_numpy()[None, :]] = -1.0

            def link(i, j):
                near = est[i, j] >= least
                a.append(ids[i[near]])
                b.append(names[j[near]])
                e.append(est[i[near], j[near]].astype(np.float64))

            every = np.arange(len(ids))
            best = est.argmax(axis=1)
            link(every, best)
            # And each hub's best documents, or a hub that is nobody's best would stay alone.
            for j in range(len(names)):
                mine = np.argpartition(-est[:, j], min(1, len(ids) - 1))[:2]
                link(mine, np.full(len(mine), j))
            # A document near to two hubs ties them; a spanning forest of such ties comes first.
            i, j = np.nonzero(est >= sure)
            i, j = i[j != best[i]], j[j != best[i]]
            if len(i):
                pair = best[i].astype(np.int64) * len(names) + j
                order = np.lexsort((-est[i, j], pair))
                order = order[np.concatenate(([True], np.diff(pair[order]) != 0))]
                i, j = i[order], j[order]
                ties = _tree(len(names), best[i], j, est[i, j])
                link(i[ties], j[ties])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "est": np.concatenate(e)})

    return run


def _tree(n: int, a: np.ndarray, b: np.ndarray, est: np.ndarray) -> np.ndarray:
    """Of ties between hubs those of a spanning forest, best first."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for k in np.argsort(-est, kind="stable").tolist():
        i, j = find(int(a[k])), find(int(b[k]))
        if i != j:
            root[i] = j
            keep.append(k)
    return np.array(keep, dtype=np.int64)


class _Links:
    """Links that hold on full sets, and the components they make."""

    def __init__(self, rows: DataFrame, words: int, percent: int):
        self.rows, self.words, self.percent = rows, words, percent
        self.stars = None

    def labels(self, spark) -> DataFrame:
        """(v, component) for each document that isn't the smallest of its component."""
        return spark.createDataFrame([], "v long, component long") if self.stars is None else self.stars

    def label(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the component of a column's documents."""
        if self.stars is None:
            return df.withColumn(name, F.col(column))
        of = bounded(self.stars.select(F.col("v").alias("_v"), F.col("component").alias("_c")))
        return df.join(of, F.col(column) == F.col("_v"), "left").withColumn(name, F.coalesce("_c", column)).drop("_v", "_c")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(r, text) of the ids (r) that occur in a table."""
        ids = materialize(ids.distinct())
        out = materialize(self.rows.join(bounded(ids), F.col("id") == F.col("r")).select("r", "text").dropDuplicates(["r"]))
        discard(ids)
        return out

    def confirm(self, found: DataFrame) -> None:
        """Compare candidates (a, b), about one a document, on full sets."""
        found = materialize(found.select("a", "b").distinct())
        texts = self.texts(found.select(F.explode(F.array("a", "b")).alias("r")))
        self.add(_verify(found, texts, self.words, self.percent))
        discard(texts)
        discard(found)

    def within(self, members: DataFrame) -> None:
        """Compare the documents (list, rep, side, c) of each list on full sets, every pair that links found so far don't join."""
        members = materialize(members)
        texts = self.texts(members.select(F.col("rep").alias("r")))
        own = members.join(texts, F.col("rep") == F.col("r")).select("list", "rep", "side", "c", "text")
        weight = members.join(texts.select("r", F.octet_length("text").alias("w")), F.col("rep") == F.col("r")).agg(F.sum("w")).first()[0]
        buckets = max(64, int(weight or 0) // (8 << 20))
        words, percent = self.words, self.percent

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            ids = table["rep"].to_numpy()
            first = np.unique(ids, return_index=True)[1]
            text = table["text"].combine_chunks().cast(pa.string()) if len(ids) else pa.array([], pa.string())
            texts_here = text.take(pa.array(first))
            sets = dict(zip(ids[first].tolist(), shingle_sets(texts_here, words)))
            found = []
            for names, comp, side, _ in _nodes(table):
                if len(names) > 1:
                    found += _united(names, comp, side, [sets[r] for r in names.tolist()], percent)
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        dealt = own.withColumn("bucket", F.pmod("list", F.lit(buckets)))
        self.add(dealt.groupBy("bucket").applyInArrow(run, "a long, b long").distinct())
        discard(texts)
        discard(members)

    def add(self, links: DataFrame) -> None:
        true = materialize(links)
        if not true.isEmpty():
            edges, old = true, self.stars
            if old is not None:
                edges = edges.unionByName(old.select(F.col("component").alias("a"), F.col("v").alias("b")))
            self.stars = components(edges)
        discard(true)


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    left = texts.withColumnsRenamed({"r": "ra", "text": "ta"})
    right = texts.withColumnsRenamed({"r": "rb", "text": "tb"})
    full = pairs.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb")).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            keep = []
            x = shingle_sets(batch.column(2).cast(pa.string()), words)
            y = shingle_sets(batch.column(3).cast(pa.string()), words)
            for s, t in zip(x, y):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(0), pa.array(keep, pa.bool_())), pc.filter(batch.column(1), pa.array(keep, pa.bool_()))], names=["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the document of the smallest id of each group. The columns stay, whatever their names.

    Equal rows of that id become one; should the id have several texts, one row of each stays. Rows without an id stay.
    """
    name = spare(docs, "kept_id")
    kept = group(docs, id_col, text_col, **options).where("kept").where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name)).distinct()
    stay = docs.join(kept, F.col(id_col).cast("long") == F.col(name), "left_semi").dropDuplicates([id_col, text_col])
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
