"""Personal data by candidate gradient boosting.

Base patterns find plain cases, which always stay. High-recall generators then propose further spans, which overlap
(separated or bracketed addresses, numbers in other groupings, missing prefixes; from every part of a longer one, and each also
without its last part); boosted trees judge each from its format and context, and candidates above their kind's
calibrated threshold join the base spans, best first, as long as they touch none before.

The trees are fitted here on generated texts: a seeded set of formats in neutral words, with look-alikes (order numbers,
versions, dates, prices, hashes). They learn what the generators propose in them: a proposal that is exactly the planted span is
right, a piece of it, more than it, or a look-alike is wrong. Half the texts set the trees, half the thresholds: the lowest at which no more
than ``max_false`` of the wrong proposals pass. ``evaluate`` tells precision and recall on texts of another seed, spans by themselves.

All patterns take a number of steps in proportion to the text, however long a run of digits or name characters is.

Defined results: a null or empty text has no spans; an empty table gives an empty table; repeated rows are each searched;
extra columns are ignored by ``find`` and kept by ``redact``; texts are searched whole.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

# What the method proposes beyond the base, wide on purpose.
CANDIDATES = {
    "email": re.compile(
        r"[^\W_][\w.%+-]{0,63}\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?[^\W_][\w-]{0,62}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[^\W_][\w-]{0,62}){1,4}",
        re.I,
    ),
    "ip": re.compile(
        r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    ),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.\-/_ ]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+\s?|00)?\(?[0-9]{1,4}\)?(?:[\x20./\- ]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9])"),
}
# Where one of these is near, a candidate may be. Digits or an at sign must be there for any span.
_QUICK = re.compile(r"[0-9@]|[(\[{]at[)\]}]| at ", re.I)
_EMAIL_HINT = re.compile(r"@|[(\[{]at[)\]}]|\sat\s.{1,70}?(?:\.|dot)", re.I)
_DIGITS = re.compile(r"[0-9]")

# Words that stand near a kind, lower case.
CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "llam"),
}
# Words that stand near look-alikes, lower case.
AGAINST = ("order", "invoice", "version", "v.", "ref", "isbn", "id", "page", "price", "total", "no.", "nr", "section", "build", "serial")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 20 else int(p.lstrip("0")[:20] or 0) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


_PATTERNS = {"card": BASE["card"].finditer, "phone": BASE["phone"].finditer}


def _addresses(text: str):
    """Spans of BASE['ip'] from left to right: four runs of digits with one dot between. The pattern alone tries a run from each digit of it."""
    runs = [m.span() for m in _RUN.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        k = next((j for j in (2, 1, 0) if runs[i + j + 1][0] != runs[i + j][1] + 1 or text[runs[i + j][1]] != "."), None)
        if k is None:
            yield runs[i][0], runs[i + 3][1]
            i += 4
        else:
            i += k + 1


_RUN = re.compile(r"[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base, by start, then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [(s, 1, e) for s, e in _addresses(text) if _holds("ip", text[s:e])]
        for k in (2, 3):
            if k == 2 or "+" in text:
                out += [(m.start(), k, m.end()) for m in _PATTERNS[KINDS[k]](text) if _holds(KINDS[k], m.group())]
    return sorted(out)


_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str):
    """BASE['email'].finditer, started from the at signs: the pattern alone takes a run of name characters for each of its starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = BASE["email"].match(text, begin) if begin < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


_DIGIT_BEFORE, _DIGIT_AFTER, _NAME_AFTER = re.compile(r"[0-9][ ./()_-]{1,2}\Z"), re.compile(r"[ ./()_-]{1,2}[0-9]"), re.compile(r"[.@_-][0-9a-z]")
_FIRST_PART = re.compile(r"[^\W_]+|.", re.S)
_LAST_PART = re.compile(r"(?:\s?(?:\.|[(\[{]dot[)\]}]|\sdot\s)\s?|[^0-9A-Za-z]{1,2})\(?[^\W_][\w-]*\)?\Z", re.I)


def proposals(kind: str, text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be of a kind: a match from every part of a longer one on, and each without its last part."""
    pattern, out, at = CANDIDATES[kind], set(), 0
    while m := pattern.search(text, at):
        start, end = m.span()
        out.add((start, end))
        # Without the last part it must be a match by itself.
        cut = _LAST_PART.search(m.group())
        if cut and (shorter := pattern.fullmatch(text, start, start + cut.start())):
            out.add(shorter.span())
        # Brackets about a match, or one of them, may belong to the text.
        opened, closed = m.group().count("("), m.group().count(")")
        if text[start] == "(" and text[end - 1] == ")" and end - start > 2:
            out.add((start + 1, end - 1))
        if opened != closed:
            out.add((start + (opened > closed and text[start] == "("), end - (closed > opened and text[end - 1] == ")")))
        at = min(end, start + len(_FIRST_PART.match(text, start).group()))
    return sorted(out)


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and context of 32 characters on each side."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    groups = re.split(r"[^0-9]+", span.strip("+() "))
    sizes = [len(g) for g in groups if g]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 32].lower()
    prev, following = before[-1:] or " ", after[:1] or " "
    joined = "".join(digits)
    return [
        float(len(span)),
        float(len(digits)),
        float(len(sizes)),
        float(max(sizes, default=0)),
        float(min(sizes, default=0)),
        float(sizes[-1]) if sizes else 0.0,
        float(span.startswith("+") or span.startswith("00")),
        float("(" in span),
        float("@" in span),
        float(sum(c in "  " for c in span)),
        float(sum(c == "." for c in span)),
        float(sum(c in "-/_" for c in span)),
        float(bool(joined) and len(joined) < 40 and joined.isascii() and luhn(joined)),
        float(len(joined) > 0 and joined[0] in "3456"),
        float(all(int(g) <= 255 for g in groups if g and len(g) < 10)),
        float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        float(bool(re.search(r"\.[a-z]{2,10}\Z|dot\W{0,2}[a-z]{2,10}\Z", span.lower()))),
        float(bool(re.search(r"[(\[{](at|dot)[)\]}]", span.lower()))),
        float(bool(re.search(r" at .* dot | at \S+\.", span.lower()))),
        float(":" in span),
        float(prev.isalnum() or prev in "_$€£#"),
        float(following.isalnum() or following in "_%€£"),
        float(prev in "(<[\"'"),
        float(any(c in before for c in CUES[kind])),
        float(any(c in before for c in AGAINST)),
        float(bool(re.search(r"(?:19|20)[0-9]{2}\D|\D(?:19|20)[0-9]{2}\Z", span))),
        float(len(set(joined))),
        # Whether the span is a piece of something longer.
        float(bool(_DIGIT_BEFORE.search(before))),
        float(bool(_DIGIT_AFTER.match(after))),
        float(prev in "._%+-@"),
        float(bool(_NAME_AFTER.match(after))),
        float(span.count("(") - span.count(")")),
        float(prev == "(" and following == ")"),
    ]


class Boosting:
    """Gradient boosted regression trees of fixed depth on the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosting":
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - prob, prob * (1 - prob) + 1e-9, cuts, self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, depth):
        leaf = float(self.rate * g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 8:
            return leaf
        best, root = None, g.sum() ** 2 / (h.sum() + 1.0)
        for j, points in enumerate(cuts):
            for c in points:
                left = x[:, j] <= c
                n = left.sum()
                if 4 <= n <= len(g) - 4:
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - root
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, j, float(c))
        if best is None or best[0] < 1e-6:
            return leaf
        _, j, c = best
        left = x[:, j] <= c
        return (j, c, self._grow(x[left], g[left], h[left], cuts, depth - 1), self._grow(x[~left], g[~left], h[~left], cuts, depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, low, high = tree
        left = x[:, j] <= c
        out = np.empty(len(x))
        out[left], out[~left] = self._apply(low, x[left]), self._apply(high, x[~left])
        return out

    def prob(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def _example(kind: str, good: bool, r: random.Random) -> tuple[str, int, int]:
    """A generated text with one candidate; good: it is personal data of the kind."""
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    sep = r.choice(" -.")
    cue = r.choice(CUES[kind]) + r.choice([" ", ": ", " is "]) if r.random() < (0.4 if good else 0.05) else ""
    if kind == "email":
        at, dot = r.choice([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" @ ", "."), ("{at}", "{dot}")])
        s = f"{word()}{r.choice(['.', '_', '', '-'])}{num(r.randint(0, 2))}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'example', 'de', 'fr', 'es', 'io'])}"
        if not good:
            s = r.choice([f"{word()} at {word()}. {word().title()}", f"{word()}@{word()}.{num(3)}", f"{word()} at {word()}.{word()[:1]}", f"{num(2)} @ {num(1)}.{num(2)}", f"{word()} at {num(2)}.{num(2)}"])
    elif kind == "ip":
        parts = [str(r.randint(1, 255)) for _ in range(4)]
        s = r.choice([r.choice(["[.]", "(.)", "[dot]", " . ", ". "]).join(parts), ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))])
        if not good:
            s = r.choice([".".join([str(r.randint(256, 999)), *parts[1:]]), ". ".join(str(r.randint(256, 999)) for _ in range(4)), "{}. {}. {}. {}".format(*(r.randint(1, 9) for _ in range(4)))])
            cue = r.choice(["version ", "section ", "build ", ""])
    elif kind == "card":
        digits = r.choice("3456") + num(r.choice([12, 13, 14, 14, 14]))
        check = next(c for c in "0123456789" if luhn(digits + c))
        digits += check if good else r.choice([c for c in "0123456789" if c != check])
        gap = r.choice(["", " ", "-", ".", "/", "  ", "_"])
        s = gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        if not good and r.random() < 0.5:
            s, cue = r.choice("012789") + num(r.randint(12, 17)), r.choice(["order ", "serial ", "ref ", ""])
    else:
        s = r.choice([f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"00{num(2)} {num(3)} {num(6)[:5]} {num(3)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"1{sep}{num(3)}{sep}{num(3)}{sep}{num(4)}"])
        if not good:
            s = r.choice([f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}/{r.randint(1, 12):02}/{r.randint(1900, 2099)}", f"{r.randint(1, 99)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)}", f"{num(2)}-{num(2)}", f"{r.randint(1, 9)}.{r.randint(10, 99)}.{r.randint(10, 99)}", f"{num(3)} {num(2)}", f"{num(3)}-{num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(2)} {num(3)} {num(3)}"])
            cue = r.choice(["order ", "invoice ", "", "", "page ", "total "])
    glue, behind = r.choice([("", ""), ("(", ")"), ("", "."), ("", ",")]) if good else r.choice([("", ""), ("", "."), ("#", ""), ("$", ""), ("", "%"), (word()[:2], ""), ("", word()[:2])])
    left = " ".join(word() for _ in range(r.randint(1, 5))) + " " + cue + glue
    return left + s + behind + " " + " ".join(word() for _ in range(r.randint(1, 5))), len(left), len(left) + len(s)


@dataclass(frozen=True)
class Model:
    trees: dict
    thresholds: dict


def _judged(kind: str, seed: str, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Features of the proposals in n generated texts, whether each is exactly a planted span, and (text, span or None) for each text."""
    r, x, y, texts = random.Random(seed), [], [], []
    for i in range(n):
        text, start, end = _example(kind, i % 2 == 0, r)
        texts.append((text, (start, end) if i % 2 == 0 else None))
        plain = [(s, e) for s, _, e in base_spans(text)]
        for s, e in proposals(kind, text):
            if not any(s < f and b < e for b, f in plain):
                x.append(features(kind, text, s, e))
                y.append(float(i % 2 == 0 and (s, e) == (start, end)))
    return np.array(x), np.array(y), texts


@functools.lru_cache(maxsize=4)
def fit(seed: int = 5, per_kind: int = 1200, max_false: float = 0.01) -> Model:
    """Trees and thresholds of each kind from per_kind generated texts; the same for the same seed."""
    trees, thresholds = {}, {}
    for kind in KINDS:
        x, y, _ = _judged(kind, f"{seed}{kind}", per_kind // 2)
        trees[kind] = Boosting().fit(x, y)
        x, y, _ = _judged(kind, f"{seed}{kind}held", per_kind // 2)
        false = np.sort(trees[kind].prob(x)[y == 0])[::-1]
        thresholds[kind] = max(0.05, float(false[min(int(max_false * len(false)), len(false) - 1)]) + 1e-6)
    return Model(trees, thresholds)


def evaluate(model: Model, seed: int = 99, per_kind: int = 1000) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind over spans added in generated texts of another seed, exact ends asked for."""
    out = {}
    for k, kind in enumerate(KINDS):
        texts = _judged(kind, f"{seed}{kind}", per_kind)[2]
        hit = made = real = 0
        for (t, truth), (base, spans) in zip(texts, spans_of([t for t, _ in texts], model)):
            own = [(s, e) for s, q, e in spans if q == k and (s, q, e) not in base]
            made += len(own)
            real += truth is not None and (truth[0], k, truth[1]) not in base
            hit += truth in own
        out[kind] = (hit / max(made, 1), hit / max(real, 1))
    return out


class _Taken:
    """Spans that touch none of each other, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= start:  # base spans may overlap: they count as one here
            self.ends[i - 1] = max(self.ends[i - 1], end)
        else:
            self.starts.insert(i, start)
            self.ends.insert(i, end)


def spans_of(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, by start, then kind. The candidates of all texts are judged together."""
    base, taken = [[] for _ in texts], [_Taken() for _ in texts]
    rows: dict[str, list] = {kind: [] for kind in KINDS}
    for i, t in enumerate(texts):
        if not t or not _QUICK.search(t):
            continue
        base[i] = base_spans(t)
        for s, _, e in base[i]:
            taken[i].add(s, e)
        digits, hint = bool(_DIGITS.search(t)), "@" in t or bool(_EMAIL_HINT.search(t))
        for kind in KINDS:
            if hint if kind == "email" else digits:
                rows[kind] += [(i, s, e) for s, e in proposals(kind, t) if taken[i].free(s, e)]
    passed: list[list] = [[] for _ in texts]
    for k, kind in enumerate(KINDS):
        for lo in range(0, len(rows[kind]), 20_000):
            own = rows[kind][lo : lo + 20_000]
            p = model.trees[kind].prob(np.array([features(kind, texts[i], s, e) for i, s, e in own]))
            for q, (i, s, e) in zip(p.tolist(), own):
                if q > model.thresholds[kind]:
                    passed[i].append((-q, s - e, s, k, e))
    out = []
    for own, free, found in zip(base, taken, passed):
        more = []
        for _, _, s, k, e in sorted(found):
            if free.free(s, e):
                free.add(s, e)
                more.append((s, k, e))
        out.append((own, sorted([*own, *more])))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _apply(docs: DataFrame, text_col: str, make, kind):
    return F.pandas_udf(make, kind)(F.col(text_col))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, n_spans): counts and list of the base, the list of all spans and how many they are."""
    model = fit(seed)

    def run(texts: pd.Series) -> pd.DataFrame:
        both = spans_of(texts.tolist(), model)
        tidy()
        out = {f"n_{kind}": [sum(k == i for _, k, _ in base) for base, _ in both] for i, kind in enumerate(KINDS)}
        return pd.DataFrame(out | {"base": [_listed(b) for b, _ in both], "spans": [_listed(a) for _, a in both], "n_spans": [len(a) for _, a in both]})

    kind = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long"
    found = docs.select(F.col(id_col).alias("id"), _apply(docs, text_col, run, kind).alias("f"))
    return found.select(F.col("id").alias(id_col), "f.*")


def redact(docs: DataFrame, text_col: str = "text", seed: int = 5) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans count as one. The columns stay."""
    model = fit(seed)

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t, (_, spans) in zip(texts, spans_of(texts.tolist(), model)):
            at, parts = 0, []
            for s, k, e in spans:
                if s >= at:
                    parts += [t[at:s], f"<{KINDS[k]}>"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if spans else t)
        tidy()
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, _apply(docs, text_col, run, "string"))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
