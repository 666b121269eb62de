"""Quality rules as one projection compiled from a threshold table.

``signals`` gives the counts of a text in O(n log n) of its words by built-in expressions; ``verdict`` compiles the rows
of ``THRESHOLDS`` into one boolean column. No user function, no shuffle: each row is judged where it is read.

Defined results: a null text has no words and no lines; a text of fewer than three words has no repeated words; very long
texts are judged whole; rows that repeat are rows of the result; an empty table gives an empty result. Other columns are
not touched, but names that begin with ``_signal`` are the operator's own. Windows of a text count as equal if their
64-bit hashes are: two of 10,000 windows that differ are taken as equal in one text of 10^11.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import SPACE, null_as_empty, words

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "this", "have", "from", "are",
    "der", "die", "das", "und", "in", "zu", "den", "von", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "er",
    "le", "la", "les", "et", "des", "en", "un", "une", "du", "dans", "que", "qui", "pour", "il", "elle", "est", "au",
    "el", "los", "las", "y", "que", "una", "por", "con", "para", "no", "se", "del", "su", "es", "lo",
)
SYMBOLS = "#*$%&|<>"


class Threshold(NamedTuple):
    """A text fails if numerator / denominator lies outside [low, high]; without a denominator it passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The threshold table. Each row is one test of the projection; counts come from ``signals``.
THRESHOLDS = (
    Threshold("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Threshold("symbol_ratio", "n_symbols", "n_words", 0.0, 0.1),
    Threshold("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1.0),
    Threshold("dup_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``_signals`` of the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words and n_stop_words.

    Repeated words: 3-word windows are hashed (64 bits), sorted by (hash, position) and compared with their neighbours;
    the positions of windows found twice or more are then swept once for the words that they cover.
    """
    text = null_as_empty(F.col(text_col))
    stop = sorted({w for x in STOP_WORDS for w in (x, x.capitalize())})
    staged = (
        df.withColumn("_signal_text", text)
        .withColumn("_signal_words", words(F.col("_signal_text")))
        .withColumn("_signal_n", F.size("_signal_words"))
        .withColumn("_signal_lines", F.filter(F.split("_signal_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
        .withColumn(
            "_signal_windows",
            F.sort_array(
                F.transform(
                    F.when(F.col("_signal_n") >= 3, F.sequence(F.lit(0), F.col("_signal_n") - 3)).otherwise(F.array().cast("array<int>")),
                    lambda p: F.struct(F.xxhash64(F.get("_signal_words", p), F.get("_signal_words", p + 1), F.get("_signal_words", p + 2)).alias("h"), p.alias("p")),
                )
            ),
        )
    )
    same = lambda x, i, d: F.coalesce(F.get("_signal_windows", i + d)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_signal_windows", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    long = lambda c, name: c.cast("long").alias(name)
    return staged.withColumn(
        "_signals",
        F.struct(
            long(F.col("_signal_n"), "n_words"),
            long(F.length(F.translate("_signal_text", SPACE, "")), "word_chars"),
            long(F.length("_signal_text") - F.length(F.translate("_signal_text", SYMBOLS, "")), "n_symbols"),
            long(F.size("_signal_lines"), "n_lines"),
            long(F.size("_signal_lines") - F.size(F.array_distinct("_signal_lines")), "n_dup_lines"),
            long(covered, "n_repeat_words"),
            long(F.size(F.filter("_signal_words", lambda w: w.isin(stop))), "n_stop_words"),
        ),
    ).drop("_signal_text", "_signal_words", "_signal_n", "_signal_lines", "_signal_windows")


def base_failed(s: Column) -> Column:
    """The base rule: fewer than 50 words, or over half of the words in repeated windows."""
    return (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)


def verdict(s: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """True where every row of the threshold table holds; a test without denominator holds."""
    test = F.lit(True)
    for t in thresholds:
        a, b = s[t.numerator].cast("double"), s[t.denominator].cast("double")
        test = test & ((b == 0) | ((a >= b * t.low) & (a <= b * t.high)))
    return test


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for each row."""
    judged = signals(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_in")), "_in")
    s = F.col("_signals")
    return judged.select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")],
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & verdict(s, thresholds)).alias("kept"),
    )
