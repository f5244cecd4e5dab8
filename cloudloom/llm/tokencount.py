"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary piece that ends at each character of a word; dynamic
programming carries the best score and, with it, the number of pieces. No piece list is kept. Ties go the way
of the tokenizer: positions are relaxed in the order of a piece's begin and only a strictly better score replaces an
earlier one, so the piece that begins first, the longest, wins. A character that no one-character piece covers
becomes an unknown piece of the lowest score less 10; with byte fallback it counts as its UTF-8 bytes.

Texts are cut before each space that follows another character. The space mark stands only at the front of
pieces (checked when a vocabulary is loaded), so no piece crosses such a cut and counts of words add up. A word's
count is worked out once a worker, in a memo of bounded size.

Counts are those of a unigram tokenizer over the same pieces and scores, a space mark put before the text and in place of each space,
on whole texts.

Defined results: a null or empty text has 0 tokens; an empty table gives an empty table; repeated rows are each
counted; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the tokenizer family: the space mark and what an unknown piece costs below the lowest score.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# A word is a run of spaces with the run of other characters after it.
_UNIT = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True

    def __post_init__(self):
        if any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces):
            raise ValueError("a piece has the space mark behind another character: words can't be counted apart")


def _fields(message: bytes):
    """(number, value) of a protocol buffer message's fields: integers, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[i : i + size]
            i += size


def model_kind(model: bytes) -> str:
    """The kind of a sentencepiece model: field 3 of its trainer's settings, field 2; unigram where that is left out."""
    trainer = next((v for n, v in _fields(model) if n == 2), b"")
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(next((v for n, v in _fields(trainer) if n == 3), 1), "unknown")


def load_sentencepiece(path: str, scores_as_unigram: bool = False) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model with their scores.

    Another kind of model than unigram is refused, for its own tokenizer doesn't choose pieces by the sum of their scores; with
    ``scores_as_unigram`` its pieces and scores are read as a unigram vocabulary all the same, whose counts are not those of that tokenizer.
    """
    import sentencepiece

    with open(path, "rb") as f:
        kind = model_kind(f.read())
    if kind != "unigram" and not scores_as_unigram:
        raise ValueError(f"{path} is a {kind} model, not a unigram one")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in own), any(sp.is_byte(i) for i in range(n)))


class Counter:
    def __init__(self, vocabulary: Vocabulary, memo: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, len(self.automaton))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback
        self.codes = np.array(sorted(map(ord, self.single)), dtype=np.uint32)
        used = set().union(*(p for p, _ in vocabulary.pieces))
        self.gap = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)
        self.scores = np.array([s for _, s in vocabulary.pieces], dtype=np.float64)
        self.lengths = np.array([len(p) for p, _ in vocabulary.pieces], dtype=np.int64)
        self.memo: dict[str, int] = {}
        self.most = memo

    def viterbi(self, word: str) -> int:
        """Pieces of a word whose spaces are marks already."""
        n = len(word)
        ending: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(word):
            ending[end + 1].append((end + 1 - int(self.lengths[piece]), float(self.scores[piece]), 1))
        before = False  # the character before was unknown
        for i, c in enumerate(word):
            if c not in self.single:
                many = len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                ending[i + 1].append((i, self.unknown, many))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        lone = [False] * (n + 1)  # the best way to here ends in an unknown piece
        for end in range(1, n + 1):
            top = None
            # Longest first: an earlier begin wins a tie.
            for begin, score, many in sorted(ending[end], key=lambda x: x[0]):
                here = best[begin] + score
                if top is None or here > top:
                    top = here
                    before = score == self.unknown and begin == end - 1 and word[begin] not in self.single
                    # Without byte fallback a run of unknown characters is one piece.
                    fused = before and not self.byte_fallback and lone[begin]
                    count[end], lone[end] = count[begin] + (0 if fused else many), before
            best[end] = top
        return count[n]

    def viterbi_many(self, words: list[str]) -> np.ndarray:
        """viterbi() of many short words at once: all words advance by one character at a time."""
        joined = self.gap.join(words) + self.gap
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        length = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(length + 1) - (length + 1)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = np.isin(chars, self.codes)
        known[first + length] = True  # the gaps
        odd = np.flatnonzero(~known)
        wide = 1 + (chars[odd] > 0x7F) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
        begin = np.concatenate((end - self.lengths[piece], odd))
        end = np.concatenate((end, odd + 1))
        score = np.concatenate((self.scores[piece], np.full(len(odd), self.unknown)))
        many = np.concatenate((np.ones(len(piece), dtype=np.int64), wide))
        step = end - np.repeat(first, length + 1)[begin]
        order = np.argsort((step << 40) | begin, kind="stable")
        begin, end, score, many, step = begin[order], end[order], score[order], many[order], step[order]
        best, count = np.zeros(len(chars)), np.zeros(len(chars), dtype=np.int64)
        cuts = np.searchsorted(step, np.arange(1, int(length.max(initial=0)) + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            here = best[begin[lo:hi]] + score[lo:hi]
            group = np.concatenate(([0], np.flatnonzero(np.diff(end[lo:hi])) + 1))
            top = np.maximum.reduceat(here, group)
            size = np.diff(np.append(group, hi - lo))
            hit = np.flatnonzero(here == np.repeat(top, size))
            # The first of a group's best begins first.
            of = np.repeat(np.arange(len(group)), size)[hit]
            hit = hit[np.concatenate(([True], np.diff(of) > 0))]
            node = end[lo:hi][group]
            best[node] = top
            count[node] = count[begin[lo:hi][hit]] + many[lo:hi][hit]
        return count[first + length]

    def words(self, units: list[str]) -> np.ndarray:
        """Counts of distinct units, through the memo."""
        if len(self.memo) + len(units) > self.most:
            self.memo.clear()
        if self.byte_fallback:
            new = [u for u in units if u not in self.memo and len(u) <= 64]
            for lo in range(0, len(new), 50_000):
                part = new[lo : lo + 50_000]
                self.memo.update(zip(part, self.viterbi_many([u.replace(" ", SPACE) for u in part]).tolist()))
        return np.array([self.word(u) for u in units], dtype=np.int64)

    def word(self, unit: str) -> int:
        got = self.memo.get(unit)
        if got is None:
            got = self.viterbi(unit.replace(" ", SPACE))
        return got

    def text(self, text: str) -> int:
        return sum(map(self.word, _UNIT.findall(" " + text))) if text else 0

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Counts of many texts: the distinct words of the batch are counted once."""
        odd = pc.match_substring_regex(texts, r"  |^ | $").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        each = self.words([" " + w for w in units])
        each[[i for i, w in enumerate(units) if not w]] = 0  # an empty text, or one counted below
        sums = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()] if len(coded) else [0])))
        out = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
        for i in np.flatnonzero(odd):
            out[i] = self.text(texts[int(i)].as_py())
        return out


@functools.lru_cache(maxsize=2)
def _counter(vocabulary: Vocabulary) -> Counter:
    return Counter(vocabulary)


def count(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_tokens) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary

    def run(batches):
        counter = _counter(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 16)
            cut = np.flatnonzero(np.diff(upto // batch_bytes)) + 1 if len(texts) else []
            many = [counter.batch(texts.slice(lo, hi - lo)) for lo, hi in zip([0, *cut], [*cut, len(texts)]) if hi > lo]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(many) if many else [], pa.int64())], names=["id", "n_tokens"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
