"""Line-first cleaning, all of it column expressions (higher-order functions over one row; no shuffle, no Python).

Rules are judged for each line: navigation (separators between short items), boilerplate phrases, symbol noise, and lines
without any letter or digit. Failing lines go; a document that loses more than ``max_loss`` of its characters, or keeps too
few words, is rejected. Punctuation at the end of a line is wanted only where most of a line is prose: a long line without
any sentence mark fails.

Base measures (see ``measures``) are exact for whole texts. Windows of 8 words are compared by 64-bit hashes within one
document.

Defined results: a null or empty text has no words and no lines, fails the base and is rejected; repeated rows are judged
each for itself; no text is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture, lower case.
BOILERPLATE = ("javascript", "cookie", "terms of use", "terms of service", "privacy policy", "all rights reserved", "lorem ipsum", "sign in", "log in", "subscribe to", "click here", "skip to content")
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and hand it to body: a lambda variable, which the optimizer can't copy."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shift(a: Column, k: int) -> Column:
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def _joined(a: Column, k: int) -> Column:
    """Hash of the element and the one k further, for each element that has one."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - k, F.lit(0))), _shift(a, k), lambda x, y: F.xxhash64(x, y))


def gram_hashes(words: Column, n: int) -> Column:
    """Hashes of the runs of n words: runs are doubled, then two of them overlap, so few passes do."""
    if n == 1:
        return words
    half = 1 << ((n - 1).bit_length() - 1)
    return let(gram_hashes(words, half), lambda g: _joined(g, n - half))


def covered(grams: Column, width: int) -> Column:
    """Number of words covered by grams that occur twice or more; 0 without sorting where all differ."""

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ranked, count)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text column."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(F.filter(F.split(t, SPACE + "+"), lambda w: w != "")).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(gram_hashes(word_hashes(t), WINDOW), lambda g: covered(g, WINDOW)),
    }


def line_verdict(line: Column) -> Column:
    """Name of the rule that a line fails, null if it passes: its first failing rule."""
    low = F.lower(line)
    size = F.length(line)
    symbols = size - F.length(F.translate(line, SYMBOLS, ""))
    bars = size - F.length(F.translate(line, "|›»•", ""))
    said = F.lit(False)
    for phrase in BOILERPLATE:
        said = said | low.contains(phrase)
    return (
        F.when(~line.rlike(r"[\p{L}\p{N}]"), "no_text")
        .when((bars >= 3) & (bars * 40 >= size), "navigation")
        .when(symbols * 10 > size, "symbols")
        .when(said, "boilerplate")
        .when((size > 400) & ~line.rlike(r"[.!?;:…。！？]"), "punctuation")
    )


def clean(docs: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 5) -> DataFrame:
    """All columns (of clashing names ours win) with base measures, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_kept, clean_text, kept.
    """
    m = measures(F.col(text))
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    judged = let(split, lambda a: F.struct(F.size(a).alias("n"), F.filter(a, lambda x: line_verdict(x).isNull()).alias("good")))
    out = docs.withColumns(m | {"__judged_lines__": judged})
    good = F.array_join(F.col("__judged_lines__")["good"], "\n")
    out = out.withColumns({"n_lines": F.col("__judged_lines__")["n"].cast("long"), "n_lines_kept": F.size(F.col("__judged_lines__")["good"]).cast("long"), "clean_text": good}).drop("__judged_lines__")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.length(F.regexp_replace("clean_text", SPACE + "+", ""))
    words = F.size(F.filter(F.split("clean_text", SPACE + "+"), lambda w: w != ""))
    ok = (left >= (1 - max_loss) * F.col("word_chars")) & (words >= min_words)
    return out.withColumns({"base_failed": failed, "kept": ~failed & ok})
