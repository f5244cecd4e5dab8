"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares words by their gapped subsequences: four characters in order within a span of ``SPAN``, each
weighted by a decay for every character skipped. So an insult with characters inserted or left out still shares many of them
with the plain one. A word is normalised by the weight that a word of its length has.

Landmarks are a set of words; a word's Nyström features are its kernel values with them times the inverse root of the landmarks'
own kernel matrix. A support vector machine is linear in these features, hence in the subsequences: after training, landmarks and
weights fold into one table with a weight for each subsequence, and scoring a text is a sum of table entries over
each word. The text's score is that of its worst word, calibrated on held-back training rows.

Training: only rows for which ``rows`` holds, of these a bounded sample by hash (``max_train_docs`` of each label). Labels are for whole texts,
so which words of a toxic text are the insults is learned in rounds (see ``fit``).

Defined results: null and empty texts score the calibration's value for "no word"; repeated rows score alike; an empty table
gives an empty table; without labels of both kinds every score is the share of toxic labels (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shingles import SPACE, slices

# Span, decay and the defaults of fit() have the least cross-validated loss inside training rows, see cross_validated().
SPAN, DECAY = 5, 0.6
# Characters fall into 32 codes: white space 0, letters a-z by themselves, digits and signs that stand for letters with them,
# accented letters and what else a text may hold in the rest.
CODES = 32
_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STEPS = [(i, j, k) for i in range(1, SPAN) for j in range(i + 1, SPAN) for k in range(j + 1, SPAN)]
_TABLE_SIZE = CODES**4


def _codes() -> np.ndarray:
    """The code of each of the first 0x250 code points; the last entry is for all others."""
    import unicodedata

    table = np.zeros(0x251, dtype=np.int64)
    for c in range(0x250):
        ch = chr(c).lower()[:1]
        plain = unicodedata.normalize("NFD", ch)[:1] if ch else ""
        if c in (0x20, 9, 10, 11, 12, 13):
            continue
        if "a" <= ch <= "z":
            table[c] = 1 + ord(ch) - 97
        elif ch in _LIKE:
            table[c] = 1 + ord(_LIKE[ch]) - 97
        elif "a" <= plain <= "z" and ch:
            table[c] = 27 + (ord(ch) * 7 + ord(plain)) % 3  # an accented letter is a letter of its own
        elif ch.isalpha():
            table[c] = 30
        else:
            table[c] = 31
    table[0x250] = 30
    return table


_TABLE = _codes()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(points, 0x250)]


def _subsequences(c: np.ndarray):
    """(where, number, weight) for each gap pattern: whether it stays inside its word from each place, and its four characters.

    The white space before and after a word takes part as a border mark, so that short words have subsequences too.
    """
    n = len(c)
    c = c.astype(np.int32)
    space = c == 0
    for i, j, k in _STEPS:
        if n <= k:
            continue
        m = n - k
        # White space may only stand at either end.
        blocked = space[1 : 1 + m].copy()
        for q in range(2, k):
            blocked |= space[q : q + m]
        yield ~blocked, ((c[:m] * CODES + c[i : m + i]) * CODES + c[j : m + j]) * CODES + c[k:], DECAY ** (k - 3)


def word_scores(c: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the subsequences' weights for each word of coded text, normalised; the words' first places and lengths."""
    c = np.concatenate(([0], c, [0]))
    sums = np.zeros(len(c))
    for inside, number, w in _subsequences(c):
        sums[: len(number)] += np.where(inside, weights[number], 0.0) * w
    gap = np.flatnonzero(c == 0)
    length = np.diff(gap) - 1
    total = np.add.reduceat(sums, gap[:-1]) if len(gap) > 1 else np.zeros(0)
    own = length > 0
    first, length, total = gap[:-1][own], length[own], total[own]
    return total / norms(length), first, length


def norms(length: np.ndarray) -> np.ndarray:
    """The root of a word's own kernel value, as a word of that length with different subsequences has it."""
    top = int(length.max(initial=0)) + 1
    n = np.arange(top + 1)
    value = np.zeros(top + 1)
    for _, _, k in _STEPS:
        value += np.maximum(n + 2 - k, 0) * DECAY ** (2 * (k - 3))
    return np.sqrt(np.maximum(value, 1.0))[length]


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised subsequences of words: word, subsequence, value."""
    rows, cols, vals = [], [], []
    c = codes(" " + " ".join(words) + " ")
    word = np.cumsum(c == 0) - 1
    for inside, number, w in _subsequences(c):
        at = np.flatnonzero(inside)
        rows.append(word[at])
        cols.append(number[at])
        vals.append(np.full(len(at), w))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    return rows, cols, vals / norms(np.array([len(w) for w in words]))[rows]


def kernel(words: list[str], landmarks: list[str], chunk: int = 20_000) -> np.ndarray:
    """Kernel values of words (rows) with landmarks (columns)."""
    r, t, v = features_of(landmarks)
    used, slot = np.unique(t, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)), dtype=np.float32)
    np.add.at(dense, (slot, r), v)
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), chunk):
        part = words[lo : lo + chunk]
        r, t, v = features_of(part)
        at = np.minimum(np.searchsorted(used, t), len(used) - 1)
        hit = used[at] == t
        r, at, v = r[hit], at[hit], v[hit]
        order = np.argsort(r, kind="stable")
        r, at, v = r[order], at[order], v[order]
        begin = np.searchsorted(r, np.arange(len(part) + 1))
        some = np.flatnonzero(np.diff(begin))
        for a in range(0, len(some), 2_000):
            own = some[a : a + 2_000]
            lo2, hi2 = begin[own[0]], begin[own[-1] + 1]
            out[lo + own] = np.add.reduceat(dense[at[lo2:hi2]] * v[lo2:hi2, None].astype(np.float32), begin[own] - lo2)
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine with the squared hinge loss, by accelerated gradients on all rows."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    weight = weight / weight.sum()
    size = np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1]
    rate = 1.0 / (2.0 * size + penalty)
    w = v = np.zeros(x1.shape[1])
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x1 @ v))
        grad = -2.0 * x1.T @ (weight * y * slack) + penalty * v
        new = v - rate * grad
        v = new + k / (k + 3.0) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    """weights: of subsequences; bias: of a word; slope and shift: calibration of a text's worst word; empty: that of no word."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    empty: float
    constant: float | None = None

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The largest decision value among a text's words; nan without words."""
        out = np.full(len(texts), np.nan)
        for lo, hi in slices(texts, 1 << 20):
            own = texts.slice(lo, hi - lo).to_pylist()
            joined = codes(" ".join(own))
            value, first, _ = word_scores(joined, self.weights)
            ends = np.cumsum([len(t) + 1 for t in own])
            cut = np.searchsorted(first, np.concatenate(([0], ends)))
            some = np.flatnonzero(np.diff(cut))
            if len(some):
                out[lo + some] = np.maximum.reduceat(value, cut[some]) + self.bias
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        worst = self.worst(texts)
        p = 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))
        return np.where(np.isnan(worst), self.empty, p)


def _calibrate(value: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's logistic fit with smoothed targets, by Newton's method."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    centre, scale = value.mean(), value.std() + 1e-9
    z = np.stack(((value - centre) / scale, np.ones(len(value))))
    w = np.array([0.0, np.log((pos + 1.0) / (neg + 1.0))])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ z, -30, 30)))
        grad = z @ (p - target) + 1e-6 * w
        hess = (z * (p * (1 - p))) @ z.T + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def _pieces(word: str, size: int = 64) -> list[str]:
    """A word, or overlapping pieces of a long one, which between them hold all its subsequences of one span."""
    return [word] if len(word) <= size else [word[i : i + size] for i in range(0, len(word) - size // 2, size // 2)]


def fit(texts: list[str], labels: list[int], landmarks: int = 400, rounds: int = 4, random_negatives: int = 2_500, seed: int = 1) -> Model:
    """Train on texts with labels 0 or 1; the same result for the same rows in the same order.

    A toxic text has at least one insult, nobody says which: each round takes the word that speaks most for toxicity as
    the witness of its text (two in the first round), the worst of clean texts as the hard negatives, and trains anew. The first witnesses are the words
    that toxic texts have far more often than clean ones.
    """
    y = np.array(labels) > 0
    nothing = Model(np.zeros(_TABLE_SIZE), 0.0, 0.0, 0.0, 0.0, float(y.mean()) if len(y) else 0.0)
    if y.all() or not y.any():
        return nothing
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 4 == 3  # for the calibration
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    number: dict[str, int] = {}
    sets = [sorted({number.setdefault(p, len(number)) for w in _WORD.findall(t) for p in _pieces(w.lower())}) for t in texts]
    words = list(number)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.array([w for s in sets for w in s], dtype=np.int64)
    learn = ~held[of]
    seen = [np.bincount(flat[learn & (y[of] == k)], minlength=len(words)) for k in (False, True)]
    n = [max(1, int((~held & (y == k)).sum())) for k in (False, True)]
    ratio = ((seen[1] + 0.1) / n[1]) / ((seen[0] + 0.5) / n[0])
    value = np.where((ratio > 3.0) & (seen[1] >= max(2.0, 0.01 * n[1])), seen[1] * np.log(np.maximum(ratio, 1e-9)), 0.0)
    clean = np.flatnonzero(seen[0] > 0)
    if not len(clean) or not len(flat):
        return nothing
    common = clean[np.argsort(-seen[0][clean], kind="stable")[: random_negatives // 2]]
    negative = np.union1d(common, rng.choice(clean, min(len(clean), random_negatives // 2), replace=False))
    floor, model = 0.0, nothing
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(np.append(starts, len(flat)))

    def witnesses(times: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's words of largest value, so many of them: (text, word)."""
        now, out = value[flat], []
        for _ in range(times):
            hits = np.flatnonzero(now == np.repeat(np.maximum.reduceat(now, starts), many))
            first = hits[np.diff(of[hits], prepend=-1) > 0]
            out.append(first)
            now[first] = -np.inf
        at = np.concatenate(out)
        return of[at], flat[at]

    for turn in range(rounds):
        doc, word = witnesses(1 if turn else 2)
        own = ~held[doc] & y[doc] & (value[word] > floor)
        positive, times = np.unique(word[own], return_counts=True)
        if not len(positive):
            break
        negative = np.setdiff1d(negative, positive)
        # A rare witness needs support: it must be more like other witnesses than like clean words, else it may stand for a wrong label.
        rare = np.flatnonzero(times < 3)
        if len(rare):
            best = positive[np.argsort(-times, kind="stable")][:400]
            near = [_support(words, positive[rare], k) for k in (best, negative[np.argsort(-value[negative], kind="stable")][:400])]
            keep = np.ones(len(positive), dtype=bool)
            keep[rare] = near[0] > near[1]
            if keep.any():
                positive, times = positive[keep], times[keep]
        order = positive[np.argsort(-times, kind="stable")]
        recent = negative[np.argsort(-value[negative], kind="stable")]
        marks = np.union1d(_spread(order, landmarks // 2), np.concatenate((_spread(recent, landmarks // 4), _spread(common, landmarks // 4))))
        named = [words[i] for i in marks]
        size, vector = np.linalg.eigh(kernel(named, named))
        root = vector @ np.diag(1.0 / np.sqrt(np.maximum(size, 1e-3))) @ vector.T
        x = kernel([words[i] for i in positive] + [words[i] for i in negative], named) @ root
        target = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w = np.minimum(times, 20.0)
        weight = np.concatenate((w / w.sum(), np.full(len(negative), 1.5 / max(1, len(negative)))))
        line, bias = svm(x, target, weight)
        # Fold: f(word) = sum over subsequences of weights[subsequence] * value.
        alpha = root @ line
        r, t, v = features_of(named)
        weights = np.zeros(_TABLE_SIZE, dtype=np.float32)
        np.add.at(weights, t, alpha[r] * v)
        model = Model(weights, bias, 1.0, 0.0, 0.0)
        value = model.worst(pa.array(words, pa.string()))
        value = np.where(np.isnan(value), -np.inf, value)
        # Clean texts' worst words are the next negatives; a witness must beat most of them.
        doc, word = witnesses(1)
        own = ~held[doc] & ~y[doc]
        if own.any():
            worst = np.unique(word[own])
            floor = float(np.quantile(value[word[own]], 0.9))
            negative = np.union1d(negative, worst[np.argsort(-value[worst], kind="stable")[:1_200]])
    if model is nothing:
        return nothing
    use = np.flatnonzero(held) if held.any() else np.arange(len(y))
    value = model.worst(pa.array([texts[i] for i in use], pa.string()))
    some = ~np.isnan(value)
    slope, shift = _calibrate(value[some], np.where(y[use][some], 1, 0))
    slope = max(slope, 0.0)
    empty = 1.0 / (1.0 + np.exp(-np.clip(slope * (model.bias - 1.0) + shift, -500, 500)))
    return Model(model.weights, model.bias, slope, shift, float(empty))


def cross_validated(texts: list[str], labels: list[int], folds: int = 4, threshold: float = 0.3, **settings) -> dict[str, float]:
    """Precision, recall, F1 at the threshold and the logarithmic loss of fit(**settings), each text scored by a model that did not see it.

    Settings are to be chosen by this, inside the training rows alone.
    """
    y, p = np.array(labels) > 0, np.zeros(len(labels))
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        model = fit([t for t, o in zip(texts, out) if not o], [int(v) for v in y[~out]], **settings)
        p[out] = model.score(pa.array([t for t, o in zip(texts, out) if o], pa.string()))
    hit, found, real = int((y & (p >= threshold)).sum()), int((p >= threshold).sum()), int(y.sum())
    q = np.clip(p, 1e-6, 1 - 1e-6)
    loss = float(-np.where(y, np.log(q), np.log(1 - q)).mean()) if len(y) else 0.0
    return {"precision": hit / max(1, found), "recall": hit / max(1, real), "f1": 2 * hit / max(1, found + real), "loss": loss}


def _support(words: list[str], some: np.ndarray, others: np.ndarray, most: int = 3) -> np.ndarray:
    """Of each word, the mean kernel value with the words most like it among others, itself apart."""
    if not len(others):
        return np.zeros(len(some))
    k = kernel([words[i] for i in some], [words[i] for i in others])
    k[some[:, None] == others[None, :]] = -1.0
    return np.sort(k, axis=1)[:, -most:].mean(axis=1)


def _spread(ranked: np.ndarray, n: int) -> np.ndarray:
    """n of a ranked list: half from the top, the others evenly from the rest."""
    top, rest = ranked[: n // 2], ranked[n // 2 :]
    return np.concatenate((top, rest[:: max(1, -(-len(rest) // max(1, n - len(top))))]))


def train(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = 4000, max_train_bytes: int = 32 << 20) -> Model:
    """Fit on at most max_train_docs labelled rows of each label, those first in the order of a hash of their id whose texts together
    have at most max_train_bytes: a bound on what the driver gets. Texts are taken whole or not at all."""
    named = labels.where(rows & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    named = named.where("id is not null")
    picked = None
    for y in (0, 1):
        some = named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_train_docs)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("d") == F.col("id"))
    # At most twice max_train_docs rows; of these the texts' sizes are summed in the order of the sample.
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "t")
    sample = sample.withColumn("upto", F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(order)).where(F.col("upto") <= max_train_bytes)
    got = sorted((r["id"], r["t"] or "", r["y"]) for r in sample.select("id", "t", "y").collect())
    return fit([t for _, t, _ in got], [y for *_, y in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs, over whole texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of CODES ** 4 weights

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts), pa.float64())], names=["id", "score"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
