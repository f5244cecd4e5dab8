"""Exact dedup, the Merkle manifest and hard negatives against brute force."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import exactdedup, hardneg, merkle, queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op11_exact", "op12_manifest", "op13_hard_negatives"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    rows = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)


# 11


def equal_texts(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep, kept = max(ids, key=lambda i: (i is not None, i or 0)), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"arrivals": 1}, {"arrivals": 4}, {"arrivals": 3, "digest": lambda t: F.substring(exactdedup.sha256(t), 1, 1)}])
def test_exact_dedup_is_brute_force(spark, docs, nothing, options):
    """A digest of one byte makes many texts share one, so only the byte checks can tell them apart."""
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).limit(12)).withColumn("digest", F.lit(1)).withColumn("m", F.lit(2))
    got = sorted(map(tuple, exactdedup.dedup(odd, **options).collect()), key=str)
    assert got == equal_texts([(r.doc_id, r.text) for r in odd.collect()])
    assert exactdedup.dedup(nothing, **options).count() == 0


def test_hot_text_and_long_texts(spark):
    rows = [(i, "the same" if i % 3 else f"text {i}") for i in range(900)] + [(2000, "x" * 5_000_000), (2001, "x" * 5_000_000), (2002, "x" * 4_999_999 + "y")]
    got = sorted(map(tuple, exactdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), arrivals=3).collect()), key=str)
    assert got == equal_texts(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 1500])
def test_fuse_segment_holds_its_keys(n):
    keys = np.random.default_rng(n).integers(0, 1 << 60, n)
    factors, length, segments, cells = exactdedup.build_segment(keys)

    def passes(k):
        g = exactdedup._mixed(k, np.array(factors))
        slots = ((g[:, :1] * segments >> 30) + np.arange(3)) * length + (g[:, 1:4] & (length - 1))
        return np.bitwise_xor.reduce(cells[slots], axis=1) == ((g[:, 4] & 255) - 128).astype(np.int8)

    assert passes(keys).all()
    if n > 50:
        assert passes(np.random.default_rng(9).integers(0, 1 << 60, 20_000)).mean() < 0.01


def test_snapshot_screens_in_sql_as_built(spark, tmp_path):
    texts = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("text"))
    texts = texts.withColumn("digest", exactdedup.sha256(F.col("text")))
    s = exactdedup.close(texts, str(tmp_path / "s"))
    assert s.screen(texts.select("digest")).count() == 5000 and s.filters(spark).count() == 5
    others = spark.range(20_000).select(exactdedup.sha256(F.concat(F.lit("u"), "id")).alias("digest"))
    assert s.screen(others).count() < 200


def test_batches_meet_earlier_snapshots(spark, tmp_path):
    def rows(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("digest", exactdedup.sha256(F.col("text")))

    count = lambda r: r.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    first, second, third = rows("a", "b", "b"), rows("b", "c", "d", "d"), rows("a", "d", "e")
    _, _, one = exactdedup.admit(first, count(first), [], str(tmp_path / "1"))
    old, disputed, two = exactdedup.admit(second, count(second), [one], str(tmp_path / "2"))
    assert [r["first"] for r in old.collect()] == [0] and disputed.count() == 0
    assert sorted(r.text for r in two.texts(spark).collect()) == ["c", "d"]
    old, _, none = exactdedup.admit(third, count(third), [one, two], None)
    assert sorted(r["first"] for r in old.collect()) == [0, 1] and none is None


# 12


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def levels_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proofs(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*[part(v) for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)])
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(levels_of([x[2] for x in groups[g]]))
    top, out = levels_of([t[-1][0] for t in trees]), []
    for k, g in enumerate(order):
        for i, (_, _, h, r) in enumerate(groups[g]):
            acc = leaf(r, 1) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else h
            found = []
            for at, levels in ((i, trees[k]), (k, top)):
                for row in levels[:-1]:
                    s = row[at ^ 1] if at ^ 1 < len(row) else None
                    found += [s] if s else []
                    acc = H(acc) if s is None else H(s, acc) if at & 1 else H(acc, s)
                    at >>= 1
            out.append((r.doc_id, h, trees[k][-1][0], top[-1][0], found, acc, acc == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    return ("n_chars", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


@pytest.mark.parametrize("n, langs, tops", [(0, 1, 1024), (1, 1, 1024), (2, 2, 1024), (65, 1, 1024), (300, 5, 16), (700, 400, 8), (1025, 2, 4)])
def test_manifest_is_brute_force(spark, monkeypatch, n, langs, tops):
    monkeypatch.setattr(merkle, "TOPS", tops)
    r = random.Random(n)
    names = [None, "", "en", "É", *(f"l{i}" for i in range(langs))][: langs + 3] if langs > 1 else ["en"]
    rows = [(r.choice([None, *range(9 * n)]), r.choice([None, "", "é x"]), r.choice(names), r.choice([None, "s"]), r.choice([None, 3, 4]), "a", 1, "p") for _ in range(n)]
    df = spark.createDataFrame([*rows, *rows[:2]], "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, path string")
    assert sorted(map(tuple, merkle.manifest(df, tampered=tampered()).collect()), key=str) == proofs(df.collect())


def test_manifest_of_odd_texts(spark, docs):
    assert sorted(map(tuple, merkle.manifest(docs, tampered=tampered()).collect()), key=str) == proofs(docs.collect())
    assert merkle.manifest(docs).where("not verified").count() == 0


# 13


def hard_negatives(rows, step, k=5):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows}, key=str)
    out = []
    for i, lab, v in rows:
        if i is None or i % step:
            continue
        near = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), j is None, j or 0, m, j) for j, m, w in rows if j != i), key=lambda x: x[:3])
        for s, _, _, _, p in [x for x in near if x[3] == lab][:k]:
            for rank, (t, _, _, _, q) in enumerate([x for x in near if x[3] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]):
                out.append((i, p, rank + 1, q, -s, -t))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 20, "anchors_per_block": 2, "sample_rows": 30, "pivots": 3}])
def test_hard_negatives_are_brute_force(spark, options):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 4)), r.integers(-3, 4, 6).tolist()) for i in range(300)]  # many ties
    rows += [(1000 + i, i % 2, [3, 3, 3, 0, 0, 0]) for i in range(40)]  # one vector often
    rows += [(5, 1, [9, 9, 9, 9, 9, 9]), (10, 1, [0, 0, 0, 0, 0, 0]), (None, 1, [3, 3, 3, 0, 0, 1]), (1200, 2, [1 << 20] * 6), (1220, 3, [-(1 << 20)] * 6), rows[0], rows[10]]
    odd = [(20, None, [1.0] * 6), (40, 1, None), (60, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (80, 1, [float("nan")] + [1.0] * 5), (100, 2, [float("inf")] * 6), (120, 1, [1.0] * 5), (140, 1, []), (160, 2, [1e18] * 6)]
    odd = [(1_000_000 + i, lab, v) for i, lab, v in odd]
    floats = [(i, lab, [float(x) + 0.5 for x in v], 1, 2) for i, lab, v in rows] + [(*o, 1, 2) for o in odd]
    df = spark.createDataFrame(floats, "vec_id long, label int, embedding array<double>, block int, a int")
    got = sorted(map(tuple, hardneg.mine(df, F.col("id") % 10 == 0, **options).collect()), key=str)
    assert got == hard_negatives(rows, 10)


def test_large_numbers_and_few_rows(spark):
    big = [(i * 10, i % 2, [(i + 1) * 10**8, (-1) ** i * 3 * 10**8, 7]) for i in range(12)]  # sums beyond what doubles hold exactly
    schema = "vec_id long, label int, embedding array<double>"
    got = hardneg.mine(spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, lab, v in big], schema), F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got), key=str) == hard_negatives(big, 10)
    assert hardneg.mine(spark.createDataFrame([], schema), F.col("id") % 10 == 0).count() == 0
    assert hardneg.mine(spark.createDataFrame([(0, 1, [1.0])], schema), F.col("id") % 10 == 0).count() == 0
    assert hardneg.mine(spark.createDataFrame([(0, 1, None)], schema), F.col("id") % 10 == 0).count() == 0
