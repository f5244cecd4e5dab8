"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exactdedup, hardneg, merkle, mixing, neardup, pii, quality, sharding, suffixdedup, tokencount, toxicity
from .common import read


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # No public file holds a unigram model; this one's pieces and scores serve as one.
    vocabulary = tokencount.load_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"), scores_as_unigram=True)
    return tokencount.count(read(spark, sf_dir, "documents"), vocabulary)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words"
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans"
    )


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(wrong, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    whole = merkle.manifest(read(spark, sf_dir, "documents"), tampered=("n_chars", tampered))
    return whole.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)  # mine() takes the floor
    return hardneg.mine(rows.select("vec_id", label.alias("label"), scaled.alias("embedding")), F.col("id") % 100 == 0)


_QUERIES = (
    op1_neardup, op2_token_counts, op3_toxicity, op4_mix, op5_bpe, op6_neighbours, op7_quality, op8_suffix, op9_pii, op10_shard,
    op11_exact, op12_manifest, op13_hard_negatives,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 reps AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
 flat AS (SELECT rep, n, unnest(s) AS g FROM reps),
 pairs AS (SELECT a.rep AS x, b.rep AS y, a.n + b.n AS n, count(*) AS common FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
 links AS (SELECT x, y FROM pairs WHERE 100 * common >= 75 * (n - common) UNION ALL SELECT y, x FROM pairs WHERE 100 * common >= 75 * (n - common)),
 reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
 comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN reps USING (s) LEFT JOIN comp ON a = rep"""

_OP7_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w, string_split(t, chr(10)) AS l FROM d),
 win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM w)),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win), range(3) r(k) WHERE times > 1 GROUP BY 1),
 ln AS (SELECT doc_id, x, len({_WORDS.format("x")}) AS words, length(x) - length(translate(x, '{quality.SYMBOLS}', '')) AS symbols, length(x) - length(translate(x, '|»›•', '')) AS marks, lower(x) AS low FROM (SELECT doc_id, unnest(l) AS x FROM w)),
 ok AS (SELECT doc_id, sum(words) FILTER (NOT (symbols >= 0.3 * words OR marks >= 0.3 * words OR {" OR ".join(f"contains(low, '{p}')" for p in quality.BOILERPLATE)} OR (words >= 30 AND NOT regexp_matches(x, '[.!?;:…。！？]')))) AS stay, count(*) - count(DISTINCT x) AS dup FROM ln WHERE words > 0 GROUP BY 1),
 c AS (SELECT doc_id, len(w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(stay, 0) AS stay FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ok USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - stay <= 0.5 * n_words AS kept FROM c"""


_OP11_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

_OP12_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
 d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 7 = 0 AS wrong FROM documents, crc),
 leaf AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS h, {_LEAF.format(n="(n_chars + CASE WHEN wrong THEN 1 ELSE 0 END)")} AS now FROM d),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
 nodes AS (SELECT lang, 0 AS level, pos, h, n FROM placed UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
 subs AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM nodes WHERE n = 1),
 top AS (SELECT 0 AS level, tree AS pos, h, (SELECT count(*) FROM subs) AS n FROM subs UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
 root AS (SELECT level AS depth, h FROM top WHERE n = 1),
 own AS (SELECT p.lang, p.pos, l, (p.pos >> l) % 2 AS side, s.h FROM placed p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, unnest(range(depth)) u(l)
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l AND s.pos = xor(p.pos >> l, 1)),
 beyond AS (SELECT tree, l, (tree >> l) % 2 AS side, s.h FROM subs, unnest(range((SELECT depth FROM root))) u(l) LEFT JOIN top s ON s.level = l AND s.pos = xor(tree >> l, 1)),
 step AS (SELECT lang, pos, l, side, h FROM own UNION ALL SELECT p.lang, pos, 1000 + l, side, b.h FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang JOIN beyond b USING (tree)),
 path AS (SELECT lang, pos, list(CASE WHEN h IS NULL THEN 'N' WHEN side = 1 THEN 'R' || h ELSE 'L' || h END ORDER BY l) AS steps, coalesce(string_agg(h, '' ORDER BY l), '') AS proof FROM step GROUP BY lang, pos)
SELECT doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM (SELECT p.*, proof, list_reduce(list_prepend(now, coalesce(steps, [])), lambda a, s: sha256(CASE s[1] WHEN 'N' THEN a WHEN 'R' THEN s[2:] || a ELSE a || s[2:] END)) AS folded
 FROM placed p LEFT JOIN path q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos) p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang, root"""

_OP13_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express on the smaller tables; of the others tests compare with brute force."""
    return {"op1_neardup": _OP1_SQL, "op7_quality": _OP7_SQL, "op11_exact": _OP11_SQL, "op12_manifest": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
