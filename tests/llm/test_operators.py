"""Each operator against a brute-force version on texts with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.llm import ann, bpe, mixing, neardup, pii, quality, sharding, suffixdedup, tokencount, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# 1


def shingles(t):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_neardup_components(docs, nothing):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.group(docs).collect())
    assert got == sorted((i, len(s), find(i), find(i) == i) for i, s in rows)
    assert neardup.group(nothing).count() == 0


def test_large_nodes_close(spark):
    """A group far larger than a leaf stays one component and is never paired."""
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 :]])) for i in range(120)]
    got = neardup.group(spark.createDataFrame(texts, "doc_id long, text string"), leaf=8, hubs=6).collect()
    assert {r.component_id for r in got} == {0}


def families(copies, n, size, linked=True):
    """Texts of single words: chains of n families, 0.739 alike across, where just one pair of neighbouring families is 0.752 alike."""
    texts = []
    for c in range(copies):
        core = [f"c{c}x{k}" for k in range(300)]
        for f in range(n):
            for m in range(size):
                link = f if m == 0 and f + 1 < n else f - 1 if m == 1 and f else None
                common = [f"c{c}l{link}x{k}" for k in range(3)] if linked and link is not None else []
                t = [*core, *(f"c{c}f{f}x{k}" for k in range(20)), *common, *(f"c{c}f{f}m{m}x{k}" for k in range(33 - len(common)))]
                texts.append((len(texts), " ".join(t)))
    return texts


def brute_components(texts, words=1):
    sets = [(i, set(t.split())) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def found_components(spark, texts, **options):
    got = neardup.group(spark.createDataFrame(texts, "doc_id long, text string"), words=1, **options).collect()
    return {r.doc_id: r.component_id for r in got}


def test_one_true_link_in_a_leaf(spark):
    """Many false candidates between two families don't hide the only true one."""
    texts = families(16, 2, 20)
    want = brute_components(texts)
    assert len(set(want.values())) == 16
    assert found_components(spark, texts) == want


def test_chained_families_in_a_large_node(spark):
    """Families over leaf size hang together by one link each, between documents that have links to different hubs."""
    texts = families(2, 6, 12)
    want = brute_components(texts)
    assert len(set(want.values())) == 2
    assert found_components(spark, texts, leaf=16, hubs=8) == want


def test_last_node_is_compared_whole(spark):
    """Documents 0.74 alike stay together to the last depth, where all pairs are compared."""
    texts = families(4, 30, 2)
    want = brute_components(texts)
    assert len(set(want.values())) == 4
    assert found_components(spark, texts, leaf=8, hubs=4, depth=1, whole=16) == want


# 2


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    with pytest.raises(ValueError, match="bpe"):
        tokencount.load_sentencepiece(path)
    return tokencount.load_sentencepiece(path, scores_as_unigram=True)


def test_token_counts(spark, docs, nothing, vocabulary):
    """Whole texts against the library's own unigram tokenizer over the same pieces, normalization included; repeated rows stay."""
    from tokenizers import Tokenizer, models, normalizers

    own = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.pieces, *[(f"<0x{i:02X}>", 0.0) for i in range(256)]], 0, True))
    own.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    odd = ["", " ", "  a  b ", "a\nb\tc", "héé ñ 日本語 🙂", "ａｂｃ ﬁ", "x" * 300, " x", "\x00a", "🙂🙂 🙂", "word " * 30_000, None, "twice", "twice"]
    texts = [r.text for r in docs.select("text").collect()] + odd
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in tokencount.count(df, vocabulary).collect())
    assert got == sorted((i % 50, len(own.encode(t, add_special_tokens=False).ids) if t else 0) for i, t in enumerate(texts))
    assert tokencount.count(nothing, vocabulary).count() == 0


def test_viterbi_ties_go_to_the_longest():
    v = tokencount.Vocabulary((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)), True)
    c = tokencount.Counter(v)
    assert c.viterbi("ab") == 1 and c.viterbi_many(["ab", "ba", "c"]).tolist() == [1, 2, 1]


# 3


def test_gapped_and_inserted_insults():
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("aeioulmnrst"), r.integers(3, 9)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(30)]
        if i % 5 == 0:
            w[int(r.integers(30))] = ["grubhog", "wackfit", "dumbpok"][i // 5 % 3]
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    model = toxicity.fit(texts, labels)
    plain = " ".join(word() for _ in range(30))
    score = lambda w: float(model.score(pa.array([f"{plain} {w}"]))[0])
    assert score("grubhog") > 0.5 and score("grub-hog") > score("lantern") and score("grubbhog") > 0.3 and score("lantern") < 0.3


def test_toxicity_edges(spark, docs, nothing):
    model = toxicity.fit(["bad bad", "good day"] * 40, [1, 0] * 40)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(["a", "b"], [1, 1]).score(pa.array(["x", ""])).tolist() == [1.0, 1.0]


# 4


def test_mixing(docs, nothing):
    got = mixing.mix(docs, block=1).collect()
    size = {i: len(words(t)) for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in got)
    per, aim = Counter(), {}
    for r in got:
        per[r.source] += r.taken
        aim[r.source] = r.target
    assert math.isclose(sum(aim.values()), sum(r["size"] for r in got))
    assert all(abs(per[s] - aim[s]) <= 2 for s in aim)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, block=1).collect()), key=str)
    assert mixing.mix(nothing).count() == 0 and mixing.apply(nothing).count() == 0
    assert mixing.apply(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 200))
def test_sainte_lague_is_highest_quotients(votes, seats):
    got = mixing.sainte_lague(np.array(votes, dtype=float), seats)
    want = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert got.sum() == sum(want)
    # Ties between equal quotients may fall either way; the quotients dealt are the same.
    dealt = lambda s: sorted(v / (2 * k + 1) for v, n in zip(votes, s) for k in range(n))
    assert np.allclose(dealt(got.tolist()), dealt(want))


# 5


def test_bpe_is_the_library(docs, nothing):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=3000, bucket_words=300)
    want = {r.doc_id: own.encode_ordinary(r.text or "") for r in docs.collect()}
    got = bpe.decode(encoded, ranks).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == want[r.doc_id] and bytes(r.decoded) == own.decode_bytes(r.ids)
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé1 .!\n\t\r\x1c\x85 　日"), max_size=14), min_size=1, max_size=4))
def test_pre_tokens_are_the_pattern(texts):
    import public_tokenizers
    import regex

    vocab, seq, offsets = bpe.pre_tokens(pa.array(texts, pa.string()), public_tokenizers.PATTERN)
    names = vocab.to_pylist()
    for t, lo, hi in zip(texts, offsets, offsets[1:]):
        assert [names[i] for i in seq[lo:hi]] == regex.findall(public_tokenizers.PATTERN, t)


# 6


def test_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 8)).astype(np.float32)
    x[10] = x[20]  # a tie
    x[100:160] = x[100]  # a hot vector
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for a in ann.search(df, "id % 20 = 0", rows_per_part=60, k=5).collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.vec_id, a.score))
    x, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 400, 20))
    for q, answers in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(400) if i != q)[:5]
        answers = sorted(answers)
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5] and all(math.isclose(a[2], d[a[1]], abs_tol=1e-12) for a in answers)
        assert [(a[2], a[1]) for a in answers] == sorted((a[2], a[1]) for a in answers)
        hit += len({a[1] for a in answers} & {i for _, i in want})
    assert hit >= 0.9 * 5 * len(got)
    assert ann.search(df.where("false"), "id % 20 = 0").count() == 0


# 7


def test_quality_counts(docs, nothing):
    for r in quality.judge(docs.select("doc_id", "text", "kept")).join(docs.select("doc_id", "text"), "doc_id").distinct().collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {k for k, n in Counter(windows).items() if n > 1}
        at = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(at))
        assert r.base_failed == (len(w) < 50 or 100 * len(at) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(nothing).count() == 0


def test_quality_lines(spark):
    good = " ".join(["These words make a plain line of prose."] + [f"w{i}" for i in range(60)]) + "."
    bar = " | ".join(f"item{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{good}\n{bar}"), (2, f"{bar}\n{bar} x\n" + " ".join(f"v{i}" for i in range(10)) + "."), (3, good)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in quality.clean(df).collect()} == {1: good, 3: good}


# 8


def brute_removed(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_suffix_dedup(docs, nothing, hot):
    own = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(own, brute_removed([r.text for r in own])))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs, hot=hot, bucket_windows=500, batch_windows=150).collect())
    assert got == want
    assert suffixdedup.remove_repeats(nothing).count() == 0


def brute_passages(texts, length=50):
    """Words of each text within stretches of so many words that another row has too; of equal ones in a text the first."""
    split = [words((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    where = {}
    for k, w in enumerate(split):
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), {}).setdefault(k, i)
    covered = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places.items():
                covered[k].update(range(i, i + length))
    return [len(c) for c in covered]


@pytest.mark.parametrize("hot", [256, 1])
def test_passages(spark, hot):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    quote = [word() for _ in range(54)]
    short = quote[:49]
    texts = [None, "", " ".join(quote)]
    for k in range(8):
        own = [word() for _ in range(80)]
        at = r.randint(0, 80)
        texts.append("\n".join(own[:at] + (quote if k % 2 else short) + own[at:]))
    twice = [word() for _ in range(60)]
    texts += [" ".join(twice + ["x"] + twice), " ".join(quote).upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_passage_words, x.n_removed) for x in suffixdedup.remove_repeats(df, hot=hot, bucket_windows=100, batch_windows=30).collect()}
    want = brute_passages(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert want[4] == 54 and want[3] == 0 and want[11] == 0  # nothing recurs in another document
    assert got[4][1] == 0  # under 400 bytes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=20).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=3), min_size=1, max_size=6))
def test_index_family(batches):
    family = suffixdedup.IndexFamily(5)
    for b in batches:
        family.add(b)
    flat = [t for b in batches for t in b]
    seen = Counter(t[i : i + 5] for t in flat for i in range(len(t) - 4))
    assert [f.tolist() for f in family.repeated()] == [[seen[t[i : i + 5]] > 1 for i in range(len(t) - 4)] for t in flat]
    sizes = [n for n, _, _ in family.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:]))


# 9


def test_pii_base(spark, nothing):
    texts = [None, "", "mail a.b@c.de, x@@y.z and d@e.f", "1.2.3.4.5 999.1.1.1 10.0.0.1", "4111 1111 1111 1111 or 4111111111111112", "+1 (212) 555-0199 +12", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.BASE[kind].finditer(t or "") if pii._holds(kind, m.group()))
        assert got[i].base == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert got[0].spans == got[1].spans == got[6].spans == ""
    assert pii.find(nothing).count() == 0


def test_pii_adds_and_redacts(spark):
    text = "write jane.doe (at) mail (dot) com or call 555-123-4567 before 2024-10-12 please"
    df = spark.createDataFrame([(1, text, 3), (2, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "write <email> or call <phone> before 2024-10-12 please" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None


# 10


def test_sharding(docs, nothing):
    got = sharding.shard(docs, rows_per_range=5, split_share=0.02).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    per = Counter()
    for r in got:
        per[r.shard] += r["size"]
    assert max(per.values()) - min(per[s] for s in range(8)) <= 2 * max(r["size"] for r in got)
    assert sharding.shard(nothing).count() == 0


def test_pipeline(spark, docs, nothing):
    """Stage by stage: what goes, goes for a reason; the rest arrives whole."""
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "byte_bpe"]
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in quality.judge(now).where("kept").collect()}
    first = cp.clean_lines(spark, now, "")
    assert {r.doc_id for r in first.collect()} == kept and first.columns == now.columns
    second = cp.drop_near_copies(spark, first, "")
    want = {r.doc_id for r in neardup.group(first).where("kept").collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(want)
    third = cp.redact_personal_data(spark, second, "")
    assert {r.doc_id for r in third.collect()} == want
    fourth = cp.mix_sources(spark, third, "")
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies) <= want and max(copies.values(), default=0) <= 3
    last = cp.encode_tokens(spark, fourth, "")
    texts = {r.doc_id: r.text for r in third.collect()}
    for r in last.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
    for _, stage in cp.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0


def test_toxicity_cross_validation_sees_no_text_it_scores():
    """Labels that no word tells: a model that had seen a text could tell it by its own words, one that has not can't."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    texts = [" ".join(word() for _ in range(12)) for _ in range(120)]
    got = toxicity.cross_validated(texts, [i % 2 for i in range(120)], landmarks=30, rounds=2)
    assert got["loss"] > 0.6 and set(got) == {"precision", "recall", "f1", "loss"}
    easy = [f"{t} you grubhog" if i % 2 else t for i, t in enumerate(texts)]
    assert toxicity.cross_validated(easy, [i % 2 for i in range(120)], landmarks=30, rounds=2)["f1"] > 0.9
