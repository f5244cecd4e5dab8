"""Quality rules, line first, in DataFrame functions only.

Every line of a text is judged by itself: symbol litter, navigation bars, boilerplate sentences and runs of
words without any sentence punctuation fail. Failed lines go, and a document that loses too large a share of
its words goes with them. Nothing is shuffled: all state is inside one row.

Defined results: a null text has no words and fails the base rule; an empty text likewise; repeated rows are
judged alike and independently; extra columns are ignored by ``judge`` and kept by ``clean``; an empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Marks between the entries of a menu.
NAVIGATION = "|»›•"

# Phrases that mark a line as boilerplate (lower case).
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """symbol_share: symbols for each word of a line from which the line is litter. nav_marks: separators
    (pipes, guillemets) for each word from which it is a menu. bare_words: a line of so many words or more
    without any sentence punctuation fails. max_loss: the share of words that a document may lose."""

    symbol_share: float = 0.30
    nav_marks: float = 0.30
    bare_words: int = 30
    max_loss: float = 0.50
    min_words: int = 50
    max_repeat_pct: int = 50


def _let(value: Column, body) -> Column:
    """Bind value once: Catalyst would evaluate a captured expression anew for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_strip(text, chars))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text, first finding included.

    A text all of whose windows have different hashes has none; only others are worked out on the windows themselves.
    """

    def exactly(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

        def starts(t: Column) -> Column:
            marked = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))

            def twice(s: Column) -> Column:
                last = F.size(s) - 1
                hit = F.filter(
                    s,
                    lambda x, j: F.coalesce(
                        ((j > 0) & (F.get(s, j - 1)["t"] == x["t"])) | ((j < last) & (F.get(s, j + 1)["t"] == x["t"])),
                        F.lit(False),
                    ),
                )
                at = F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
                return F.size(F.array_distinct(at))

            return _let(marked, twice)

        return _let(windows, starts)

    def covered(w: Column) -> Column:
        prints = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = _let(prints, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) < 4, F.lit(0)).when(none, F.lit(0)).otherwise(exactly(w))

    return _let(words, covered).cast("long")


_ENDS = r"[.!?;:…。！？]"


def _boiler(low: Column) -> Column:
    out = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        out = out | low.contains(phrase)
    return out


def line_ok(line: Column, rules: Rules = Rules()) -> Column:
    """True for a line that stays. Blank lines stay: they hold nothing to lose."""

    def judged(words: Column) -> Column:
        symbols = _count_of(line, SYMBOLS)
        marks = _count_of(line, NAVIGATION)
        bare = (words >= rules.bare_words) & ~line.rlike(_ENDS)
        return (words == 0) | ~((symbols >= rules.symbol_share * words) | (marks >= rules.nav_marks * words) | bare | _let(F.lower(line), _boiler))

    return _let(F.regexp_count(line, F.lit(WORD)), judged)


def good_lines(text: Column, lines: Column, rules: Rules = Rules()) -> Column:
    """The lines that stay. In a text without any symbol, mark or phrase of the rules a line can only be bare, which is quick to see."""
    plain = (_count_of(text, SYMBOLS + NAVIGATION) == 0) & ~_let(F.lower(text), _boiler)
    full = F.filter(lines, lambda x: x.rlike(_ENDS) | (F.regexp_count(x, F.lit(WORD)) < rules.bare_words))
    return F.when(plain, full).otherwise(F.filter(lines, lambda x: line_ok(x, rules)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each row of docs: the id, the counts, both verdicts and the cleaned text."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumn("_w", _words(F.col("_t"))).withColumn("_l", F.split(F.col("_t"), "\n", -1))
    full = F.filter(F.col("_l"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("_g", good_lines(F.col("_t"), F.col("_l"), rules))
    whole = F.size("_g") == F.size("_l")
    counted = base.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(_strip(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.when(whole, F.col("_t")).otherwise(F.array_join("_g", "\n")).alias("clean_text"),
        F.when(whole, F.size("_w")).otherwise(F.regexp_count(F.array_join("_g", "\n"), F.lit(WORD))).cast("long").alias("n_clean_words"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    keeps = F.col("n_words") - F.col("n_clean_words") <= rules.max_loss * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & keeps)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs without the rejected documents; of the others, without the failed lines. The columns stay as they are."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).alias("_text"))
    judged = judge(inner, "_row", "_text", rules).where("kept")
    out = {text_col: F.col("clean_text")}
    if "n_chars" in names:
        out["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in names])
