"""Operator 4: quality rules, one table of thresholds compiled into one projection.

``RATIOS`` and ``MINIMA`` are the whole rule set; ``verdict`` turns them into a
single boolean expression over the measures.  The measures are one struct
expression of Spark functions over the text (no user functions, no shuffle).
Words are runs of anything but ASCII white space; a line counts if it has a
word.  All comparisons are between whole numbers (``100 * part`` against
``limit * whole``), so nothing depends on rounding.

Null and empty texts have no words and fail the base rules; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Common function words of English, Spanish, French and German, found in either case: fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "have", "this", "are",
    "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para",
    "le", "et", "les", "des", "du", "une", "est", "dans", "au", "sur", "pour", "qui", "pas",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
)

# part, whole, least and most hundredths of the whole
RATIOS = (
    ("word_chars", "n_words", 200, 1500),   # mean word length
    ("n_symbols", "n_words", 0, 10),        # symbols per word
    ("n_dup_lines", "n_lines", 0, 50),      # lines equal to an earlier line
    ("n_ellipsis_lines", "n_lines", 0, 30),
    ("n_bullet_lines", "n_lines", 0, 90),
    ("n_stop_words", "n_words", 5, 100),    # function words among all words
)
# measure and the least value that passes
MINIMA = (
    ("n_stop_words", 2),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that are part of a three-word window found twice or more."""
    ints = F.array().cast("array<int>")
    grams = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))))
    again = let(F.sort_array(grams), lambda s: F.filter(F.transform(s, lambda x, k: F.when(
        (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull()))
    covered = let(F.sort_array(F.coalesce(again, ints)), lambda s: F.aggregate(
        F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
        F.lit(0), lambda total, x: total + x))
    return covered


def measures(text: Column) -> Column:
    """A struct of every measure that the rules use."""
    text = F.coalesce(text, F.lit(""))
    solid = F.translate(text, WHITE, "")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.endswith(F.rtrim(y), F.lit("...")))).alias("n_ellipsis_lines"),
        F.size(F.filter(x, lambda y: F.startswith(F.ltrim(y), F.lit("- ")))).alias("n_bullet_lines")))
    of_chars = let(solid, lambda s: F.struct(
        F.length(s).alias("word_chars"), (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).alias("n_symbols")))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), of_chars.alias("chars"))


def verdict(ratios=RATIOS, minima=MINIMA) -> Column:
    """The rule tables as one boolean expression."""
    rules = [(F.col(part) * 100).between(F.col(whole) * low, F.col(whole) * high) for part, whole, low, high in ratios]
    rules += [F.col(name) >= low for name, low in minima]
    return reduce(and_, rules, F.lit(True))


def quality(docs: DataFrame, ratios=RATIOS, minima=MINIMA) -> DataFrame:
    """doc_id, every measure (long), base_failed and kept: one row per document."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    names = ("words.n_words", "chars.word_chars", "chars.n_symbols", "lines.n_dup_lines", "words.n_repeat_words",
             "lines.n_lines", "lines.n_ellipsis_lines", "lines.n_bullet_lines", "words.n_stop_words")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text").cast("string")).alias("m"))
    out = out.select("doc_id", *[F.col(f"m.{x}").cast("long").alias(x.split(".")[1]) for x in names])
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(ratios, minima))
