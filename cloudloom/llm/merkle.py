"""A Merkle manifest of a table, with proofs by coordinate lookup.

Rows become leaves; the leaves of a group form a binary tree over their order, the roots of the groups form another one.
All nodes are kept in one table by (tree, level, pos). A leaf needs no more than its position and the size of its tree to name the
coordinates of its siblings: it explodes them, joins the node table, and collects what it finds in order.

- Positions come from one range-partitioned sort: the place inside a partition plus the rows of the partitions before.
- Trees grow by six levels a pass: 64 neighbouring nodes are one row, of which all nodes above them are hashed.
- A node high up is a sibling of half of all leaves. Leaves therefore look up the levels of small nodes only; above a level with about a
  thousand nodes the paths of those nodes are looked up instead, once each, and leaves join the path of the node over them.

H is the lowercase hex SHA-256 of the inputs' text, digests as hex text.

Defined results: null groups come first, null ids before others; rows with one id and group are ordered by their leaf, equal rows have equal leaves and
neighbouring places; a row with a null id is never tampered with; a lone leaf is its own subroot, a lone subroot the root; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, materialize

STEP = 6
TOPS = 1024
_PATH = "array<struct<level:int,h:string>>"


def leaf_of(*values: str | Column) -> Column:
    """H of values, each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    parts = []
    for v in values:
        text = (F.col(v) if isinstance(v, str) else v).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with tree (their group's number in order), pos inside it, both from 0, and n (the group's rows); and the groups (*group, n, tree).

    Sorted by range: no window holds more than one row a partition and group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # A partition meets few groups, as it is sorted by them.
    runs = materialize(placed.groupBy("_part", *group).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows")))
    trees = materialize(_dense(runs.groupBy(*group).agg(F.sum("_rows").alias("n")), group))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start"))
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    same = lambda df: _all([df[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    starts = materialize(runs.join(bounded(trees.select("tree", "n", *named)), same(runs)).select(F.col("_part").alias("_p"), "tree", "n", "_shift", *[f"_g{i}" for i in range(len(group))]))
    met = placed.join(bounded(starts), (F.col("_part") == F.col("_p")) & same(placed))
    return met.select(*rows.columns, "tree", (F.col("_at") + F.col("_shift")).alias("pos"), "n"), trees


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _dense(groups: DataFrame, group: list[str]) -> DataFrame:
    """groups with tree, their place in order from 0: ranges again, with one offset for each of at most 64 partitions."""
    keys = [F.col(c).asc_nulls_first() for c in group]
    placed = groups.repartitionByRange(min(64, groups.count() // 100_000 + 1), *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    held = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    shift, seen = [], 0
    for p, n in held:
        shift += [F.lit(p), F.lit(seen - (p << 33))]
        seen += n
    return placed.withColumn("tree", (F.col("_at") + F.element_at(F.create_map(*shift), part)) if shift else F.col("_at")).drop("_at")


def _grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All nodes up to STEP levels over each run of neighbouring nodes."""
    for f in frames:
        out: list[tuple] = []
        for tree, n, level, chunk, hashes in zip(f["tree"].tolist(), f["n"].tolist(), f["level"].tolist(), f["chunk"].tolist(), f["hashes"]):
            row, first, left = list(hashes), chunk << STEP, (n + (1 << level) - 1) >> level
            for up in range(1, STEP + 1):
                if left == 1:
                    break  # that was the root
                row = [hashlib.sha256("".join(row[i : i + 2]).encode()).hexdigest() for i in range(0, len(row), 2)]
                first, left = first >> 1, (left + 1) >> 1
                out += [(tree, n, level + up, first + i, h) for i, h in enumerate(row)]
        yield pd.DataFrame(out, columns=["tree", "n", "level", "pos", "h"])


def grow(leaves: DataFrame) -> DataFrame:
    """The node table (tree, n, level, pos, h) over leaves (tree, n, pos, h)."""
    nodes = base = leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "h")
    level = 0
    while True:
        many = F.shiftright(F.col("n") + F.lit((1 << level) - 1), level) > 1
        here = base.where(many)
        if level and here.limit(1).count() == 0:
            return nodes
        runs = here.groupBy("tree", "n", "level", F.shiftright("pos", STEP).alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("hashes"))
        made = materialize(runs.mapInPandas(_grow, "tree long, n long, level int, pos long, h string"))
        nodes, level = nodes.unionByName(made), level + STEP
        base = made.where(F.col("level") == level)


def _depth(n: Column) -> Column:
    """Levels over n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _look_up(at: DataFrame, nodes: DataFrame, high: Column) -> DataFrame:
    """(tree, pos, path) of nodes at (tree, pos, n, low), low their level: the siblings (level, h) at the levels low to high - 1 of the way up."""
    wanted = at.select("tree", "pos", "n", "low", F.explode(F.when(high > F.col("low"), F.sequence("low", high - 1))).alias("l"))
    wanted = wanted.select("tree", "pos", "l", F.expr("shiftright(pos, l - low) ^ 1L").alias("p"), F.expr("shiftright(n + shiftleft(1L, l) - 1, l)").alias("many"))
    table = nodes.select(F.col("tree").alias("t"), F.col("level").alias("k"), F.col("pos").alias("q"), "h")
    met = wanted.where("p < many").join(table, (F.col("tree") == F.col("t")) & (F.col("l") == F.col("k")) & (F.col("p") == F.col("q")))
    return met.groupBy("tree", "pos").agg(F.sort_array(F.collect_list(F.struct(F.col("l").alias("level"), "h"))).alias("path"))


def paths(leaves: DataFrame, nodes: DataFrame, beyond: DataFrame | None = None) -> DataFrame:
    """leaves (tree, pos, n, ...) with path: their siblings (level, h) from the bottom to the root, in order.

    beyond: (tree, path, ...) goes on over the trees' roots, its levels counted from there; its other columns come along.
    """
    total = leaves.count()
    split = (total // TOPS).bit_length() - 1 if total > TOPS else 0
    none, depth = F.array().cast(_PATH), _depth(F.col("n"))
    # Tops: the nodes at level split, about TOPS of them, and the root of each tree that is lower.
    low = F.least(F.lit(split), depth).cast("int")
    tops = nodes.where(F.col("level") == low).select("tree", "pos", "n", F.col("level").alias("low"))
    upper = tops.join(_look_up(tops, nodes.where(F.col("level") >= split), depth), ["tree", "pos"], "left").select("tree", "pos", "n", F.coalesce("path", none).alias("upper"))
    more = []
    if beyond is not None:
        more = [c for c in beyond.columns if c not in ("tree", "path")]
        raised = F.transform("path", lambda s: F.struct((s["level"] + depth).cast("int").alias("level"), s["h"].alias("h")))
        upper = upper.join(bounded(beyond), "tree").withColumn("upper", F.concat("upper", raised))
    upper = materialize(upper.select("tree", F.col("pos").alias("top"), "upper", *more))
    if split:
        lower = _look_up(leaves.select("tree", "pos", "n", F.lit(0).alias("low")), nodes.where(F.col("level") < split), low)
        leaves = leaves.join(lower, ["tree", "pos"], "left").withColumn("path", F.coalesce("path", none))
    else:
        leaves = leaves.withColumn("path", none)
    met = leaves.withColumn("top", F.shiftright("pos", split)).join(bounded(upper, 1 << 14), ["tree", "top"])
    return met.withColumn("path", F.concat("path", "upper")).drop("top", "upper")


def fold(leaf: Column, path: Column, pos: Column, n: Column, tree: Column, trees: int) -> Column:
    """The root from a leaf, its siblings and its places: pos in its tree of n leaves, the tree's own among so many subroots."""

    def turns(at: Column, levels: Column) -> Column:
        """Whether the node is the right one of its pair, level by level."""
        right = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: F.call_function("shiftright", at, i).bitwiseAND(F.lit(1)) == 1)
        return F.when(levels > 0, right).otherwise(F.array().cast("array<boolean>"))

    sides = F.concat(turns(pos, _depth(n)), turns(tree, F.lit((trees - 1).bit_length() if trees > 1 else 0)))
    steps = F.transform(sides, lambda right, level: F.struct(right.alias("right"), F.element_at(F.map_from_entries(path), level).alias("h")))

    def step(acc: Column, s: Column) -> Column:
        pair = F.when(s["h"].isNull(), acc).when(s["right"], F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"]))
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(steps, leaf, step)


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    id_col: str = "doc_id",
    tampered: tuple[str, Column] | None = None,
) -> DataFrame:
    """One row a row of docs: id, leaf, subroot, root, proof (array of siblings), folded_root, verified.

    tampered: a column and what stands in it when the proof is checked; leaf, roots and siblings are those of docs as they are.
    """
    now = leaf_of(*[tampered[1] if tampered and c == tampered[0] else c for c in columns])
    rows = docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), leaf_of(*columns).alias("h"), now.alias("now"))
    # Only rows that differ carry a second digest.
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("h"), F.col("now")))
    placed, groups = numbered(rows, ["g"], ["id", "h"])
    leaves, trees = materialize(placed.select("tree", "pos", "n", "id", "h", "now")), groups.count()
    nodes = grow(leaves)
    own_root = F.col("level") == _depth(F.col("n"))
    subroots = materialize(nodes.where(own_root).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "h"))
    top = grow(subroots)
    last = top.where(own_root).select("h").first()
    root = F.lit(last["h"] if last else None).cast("string")
    beyond = materialize(paths(subroots, top).select(F.col("pos").alias("tree"), "path", F.col("h").alias("subroot")))
    proved = paths(leaves, nodes, beyond).withColumn("folded_root", fold(F.coalesce("now", "h"), F.col("path"), F.col("pos"), F.col("n"), F.col("tree"), trees))
    return proved.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", root.alias("root"), F.transform("path", lambda s: s["h"]).alias("proof"), "folded_root", (F.col("folded_root") == root).alias("verified"))
