"""Text expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; words are maximal runs of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(null_as_empty(text), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Words of a text in order; an empty array where there is none."""
    trimmed = F.btrim(null_as_empty(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK, -1))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
