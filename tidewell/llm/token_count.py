"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone; those that give exactly one token are proven to be
whole tokens and form a lookup set (bounded by the vocabulary, broadcast). A pre-token in the set counts as one token
without any merge; only the others are merged, each distinct one once per worker and batch.

Defined results: a null text is empty and has 0 tokens; special strings within a text count as the library counts them
by default; texts are counted whole whatever their length; an empty table gives an empty result. Only identifier and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.text import null_as_empty
from tidewell.llm.word_bpe import ChunkCache, WordBpe, slices

_counters: dict[str, tuple[WordBpe, ChunkCache]] = {}


class TokenCounter:
    """Counts the tokens of texts; ``whole`` is the proven set."""

    def __init__(self, bpe: WordBpe, whole: frozenset[str]) -> None:
        self.bpe, self.whole = bpe, whole
        self.cache = ChunkCache(self._counts)

    def _counts(self, chunks: list[str]) -> list[int]:
        pieces, many = self.bpe.cut([c for c in chunks if c not in self.whole])
        rest = [p for p in pieces if p not in self.whole]
        _, bounds = self.bpe.encode_pieces(rest)
        merged = dict(zip(rest, np.diff(bounds).tolist(), strict=True))
        return [sum(merged.get(p, 1) for p in many[c]) if c in many else merged.get(c, 1) for c in chunks]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.bpe.chunks(t) for t in texts]
        self.cache.learn(s for s in split if s is not None)
        return [len(self.bpe.encode([t])[0]) if s is None else sum(map(self.cache.__getitem__, s)) for s, t in zip(split, texts, strict=True)]


def token_count_column(spark: SparkSession, vocabulary: str):
    """A function from a text column to its token counts by the tokenizer file ``vocabulary``."""
    proven = spark.sparkContext.broadcast(WordBpe(vocabulary).whole_words())

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if vocabulary not in _counters:  # one per worker process
            _counters[vocabulary] = TokenCounter(WordBpe(vocabulary), proven.value)
        counter = _counters[vocabulary]
        for series in texts:
            rows = series.tolist()
            yield pd.Series([n for lo, hi in slices(rows) for n in counter.count(rows[lo:hi])], dtype="int64")

    return count


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row."""
    count = token_count_column(docs.sparkSession, vocabulary)
    return (
        docs.select(F.col(id_col).alias("doc_id"), null_as_empty(F.col(text_col)).alias("_text"))
        .select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), count("_text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
