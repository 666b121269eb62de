"""Spelling variants: frequent words one edit from a much more frequent word, found by PartEnum signatures.

Words are runs of Latin letters, lower-cased in ASCII; some of them lose a letter first, by a hash of document and run, so
that there are misspellings to find. Words of ``min_length`` code points and ``min_count`` occurrences stay.

Two words are near if they differ by one inserted, deleted or replaced code point. A word's letters, the k-th occurrence
of each a dimension of its own, are a binary vector; near words are at Hamming distance two at most (one if a letter is
inserted). PartEnum turns that into equality: the dimensions are dealt to ``PARTS`` parts by a hash, and for each choice
of all but two parts (all but one for insertions) the letters in them are a signature. Two vectors within the distance
agree in at least one signature. One edit also leaves the first or the second half of a word as it is, so each signature
comes twice, with either half. An equi-join of signatures, of words of equal length or of a word with those one letter
longer, then has every near pair, and an edit distance of exactly one confirms it. Signatures are joined as 64-bit
hashes, which can only add candidates. Both joins are of the vocabulary, not of the texts.

Words are counted where they are read and combined before the shuffle. Where many words share a signature, adaptive
execution splits the join.

Defined results: a null text has no words; a null identifier counts as an empty one; repeated rows count again; of near
words with equal counts the smallest in code-point order is the form; very long texts and runs are taken whole; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import null_as_empty
from tidewell.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the letters for replaced and for inserted ones: 6 signatures of two parts in four, and 3 of two in three.
PARTS = {2: 4, 1: 3}


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, one_in: int = 199) -> DataFrame:
    """``word, n``: the frequent words. One run in ``one_in`` loses a letter, by CRC-32 of ``<id>:<run>``; 0 leaves all as they are."""
    text = F.translate(null_as_empty(F.col(text_col)), UPPER, LOWER)
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), 0)).alias("run"))
    word = F.col("run")
    if one_in:
        h, size = F.col("h"), F.char_length("run")
        rows = rows.withColumn("h", F.crc32(F.concat("key", "run").cast("binary")))
        at = (h % size).cast("int")
        word = F.when(h % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def signed(words: DataFrame, distance: int, longer: int = 0) -> DataFrame:
    """``word, signature``: the PartEnum signatures of each word's letters for a Hamming distance, each with either half.

    ``longer``: by how much the word is longer than the words that it is to meet; the shorter length is part of all
    signatures and sets their halves.
    """
    parts = PARTS[distance]
    letters, word, size = F.col("letters"), F.col("word"), F.char_length("word") - longer
    # the place of a letter after the first one of its kind tells its occurrences apart
    dims = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))
    dealt = words.select("word", F.array_sort(F.split("word", "")).alias("letters")).select("word", dims.alias("dims"))
    part = lambda k: F.array_join(F.filter("dims", lambda d: F.crc32(d.cast("binary")) % parts == k), " ")
    half = F.floor(size / 2).cast("int")
    halves = [F.substring(word, F.lit(1), half), F.substring(word, F.char_length(word) - half + 1, half)]
    cut = dealt.select("word", *[part(k).alias(f"part{k}") for k in range(parts)], *[h.alias(f"half{k}") for k, h in enumerate(halves)])
    chosen = combinations(range(parts), parts - distance)
    return cut.select("word", F.explode(F.array(*[F.xxhash64(size, F.lit(j), *[F.lit(k) if k not in c else F.concat(F.lit("="), f"part{k}") for k in range(parts)], f"half{j}") for c in chosen for j in (0, 1)])).alias("signature"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of ``word``s at an edit distance of one, each once; a < b among equal lengths, else b is longer."""
    of = lambda name, *how: signed(words, *how).withColumnRenamed("word", name)
    near = F.levenshtein("a", "b", 1) == 1
    replaced = of("a", 2).join(of("b", 2), "signature").where((F.col("a") < F.col("b")) & near)
    inserted = of("a", 1).join(of("b", 1, 1), "signature").where((F.char_length("b") == F.char_length("a") + 1) & near)
    return replaced.select("a", "b").unionByName(inserted.select("a", "b")).distinct()


def with_roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``, where the forms of a word end.

    A form is ``ratio`` times as frequent as its word, so chains have at most log(most) steps to that base; each round
    doubles the steps taken.
    """
    steps, reach = 1, ratio
    while reach <= most:
        steps, reach = steps + 1, reach * ratio
    ahead = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(max(1, (steps - 1).bit_length())):
        onward = ahead.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        ahead = checkpointed(ahead.join(onward, F.col("root") == F.col("at")).select("word", F.col("onward").alias("root")))
    return forms.join(ahead, "word")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, one_in: int = 199) -> DataFrame:
    """A row for each frequent word: ``word, form, root, n, n_near, form_n``.

    The form is the near word of largest count if that is at least ``ratio`` times the word's, else null; the root is the
    last of the forms' forms, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("a form is more frequent than its words by a ratio of two or more")
    words = checkpointed(count_words(docs, id_col, text_col, min_length, min_count, one_in))
    pairs = checkpointed(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.withColumnRenamed("word", "b"), "b")
    best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, F.col("word") == F.col("a"), "left")
    found = -F.col("best.n") >= ratio * F.col("n")
    forms = checkpointed(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(found, F.col("best.form")).alias("form"),
            F.when(found, -F.col("best.n")).alias("form_n"),
        )
    )
    most = forms.agg(F.max("n")).first()[0] or 0
    return with_roots(forms, most, ratio).select("word", "form", "root", "n", "n_near", "form_n")
