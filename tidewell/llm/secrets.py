"""Secret scan: base patterns, and a guess-cost estimate for values in credential contexts.

The base patterns find assignments, access keys and hexadecimal runs. Beyond them, a value that follows a credential
word and a separator is segmented at minimum cost by dynamic programming. Segments are dictionary words (as they stand,
capitalised or with usual substitutions), dates, repeats of a block, straight keyboard walks, and spans of brute force;
the cost of a segment is the decimal logarithm of the guesses that find it, and each further segment doubles the guesses.
Every segment of at most ``WINDOW`` characters is tried at every place, and brute-force spans of any length, so the cost
is the minimum over all segmentations. A value of at least two kinds of characters that takes ``MIN_COST`` or more is a
secret. Values that overlap a base span are not reported again.

The dictionary is a short list of weak passwords, then the most frequent words of letters of all texts, ``n_words`` of
them at most: counts cover every document, and what is broadcast is bounded by that parameter. With 0 the texts are read
once, and the list is all.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; spans are ordered by
start, then kind in the order of ``KINDS``; texts and values of any length are scanned whole, in time linear in their
length (times ``WINDOW`` at worst); rows that repeat are rows of the result; words of equal counts rank by code point;
an empty table gives an empty result; columns other than identifier and text are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import checkpointed

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 9.0
MIN_LENGTH = 8

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Words that announce a credential, and frequent words of weak passwords, most frequent first.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>,;]{8,})""",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
WORDS = (
    "password", "admin", "welcome", "login", "master", "secret", "letmein", "monkey", "dragon", "user", "test", "guest", "root", "hello", "love", "sunshine",
    "princess", "football", "baseball", "shadow", "michael", "superman", "batman", "pass", "change", "changeme", "default", "demo", "example", "sample", "dummy",
    "your", "my", "me", "the", "and", "token", "key", "api", "here", "none", "null", "true", "false", "server", "access", "public", "private", "temp", "system",
    "house", "home", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "december", "company", "office", "google", "computer", "internet",
    "freedom", "whatever", "trust", "ninja", "mustang", "jordan", "harley", "ranger", "hunter", "buster", "soccer", "hockey", "killer", "george", "charlie",
    "andrew", "thomas", "robert", "daniel", "jessica", "pepper", "ginger", "cheese", "coffee", "banana", "orange", "purple", "silver", "golden", "flower",
)
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
_PLAIN = str.maketrans("@430$15", "aaeosis")
SEGMENT = math.log10(2)
WINDOW = 256
WORD_LENGTHS = (3, 24)
#: Neighbouring keys, and the way from one to the next: the row and its direction.
_STEPS: dict[str, frozenset[tuple[int, int]]] = {}
for _row, _keys in enumerate(KEY_ROWS):
    for _a, _b in zip(_keys, _keys[1:], strict=False):
        _STEPS[_a + _b] = _STEPS.get(_a + _b, frozenset()) | {(_row, 1)}
        _STEPS[_b + _a] = _STEPS.get(_b + _a, frozenset()) | {(_row, -1)}


def _alphabet(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


class Guesser:
    """Guess costs by a dictionary of ranked words."""

    def __init__(self, corpus_words: Iterable[str] = ()) -> None:
        ranked = dict.fromkeys([*WORDS, *corpus_words])
        self.rank = {w: k + 1 for k, w in enumerate(ranked)}
        self.longest = max(map(len, self.rank))
        self.is_secret = lru_cache(maxsize=4096)(self._is_secret)

    def word(self, piece: str, low: str, plain: str) -> float | None:
        """The cost of a piece as a word, given it lower-cased, and that with substitutions undone."""
        rank = self.rank.get(low) or 4 * self.rank.get(plain, 0)
        return math.log10(rank * (2 if piece != low else 1)) if rank else None

    def cost(self, value: str) -> float:
        """Decimal logarithm of the guesses for the cheapest segmentation of ``value``."""
        low, n = value.lower(), len(value)
        if len(low) != n:
            low = value
        plain = low.translate(_PLAIN)
        single = [_alphabet(c) for c in value]
        ahead = [0.0, *accumulate(single)]
        best = [0.0] + [math.inf] * n
        brute = math.inf  # the last segment is a brute-force one
        walks: dict[tuple[int, int], int] = {}  # characters of the walks that end here
        same = [0] * (min(n, WINDOW) // 2 + 1)  # for how many characters up to here each equals the one a period before
        for i in range(n):
            end = i + 1
            brute = min(best[i] + SEGMENT, brute) + single[i]
            least = min(brute, best[end])
            walks = {way: walks.get(way, 1) + 1 for way in _STEPS.get(low[i - 1 : end], ())} if i else {}
            for k in range(3, max(walks.values(), default=0) + 1):
                least = min(least, best[end - k] + SEGMENT + math.log10(80 * k))
            for p in range(1, len(same)):
                if i < p or value[i] != value[i - p]:
                    same[p] = 0
                    continue
                same[p] += 1
                for times in range(3 if p == 1 else 2, min(same[p] // p + 1, WINDOW // p) + 1):
                    least = min(least, best[end - p * times] + SEGMENT + ahead[end] - ahead[end - p] + math.log10(times))
            for k in range(2, min(end, self.longest) + 1):
                at = end - k
                cost = self.word(value[at:end], low[at:end], plain[at:end])
                if cost is not None:
                    least = min(least, best[at] + SEGMENT + cost)
            for k in (4, 8, 10):
                if k <= end and _DATE.fullmatch(value, end - k, end):
                    least = min(least, best[end - k] + SEGMENT + math.log10(120 * (365 if k > 4 else 1)))
            best[end] = least
        return best[n]

    def _is_secret(self, value: str) -> bool:
        kinds = {"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value}
        return len(kinds) > 1 and self.cost(value) >= MIN_COST

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """The spans (kind, start, end) of a text."""
        if not text:
            return []
        low = text.lower()
        hinted = any(h in low for h in HINTS)
        spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if hinted else []
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        if hinted:
            taken = sorted((a, b) for _, a, b in spans)
            reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans so far
            starts = [a for a, _ in taken]
            for m in CONTEXT.finditer(text):
                # marks that end a sentence belong to a value only inside quotes
                value = m[1] if text[m.end() : m.end() + 1] in ('"', "'") else m[1].rstrip(".!?)]}")
                lo, hi = m.start(1), m.start(1) + len(value)
                before = bisect_left(starts, hi)
                if len(value) >= MIN_LENGTH and not (before and reach[before - 1] > lo) and self.is_secret(value):
                    spans.append(("guess", lo, hi))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
N_WORDS = 20_000
_guessers: dict[str, Guesser] = {}


def frequent_words(docs: DataFrame, text_col: str = "text", n_words: int = N_WORDS) -> list[str]:
    """The most frequent words of letters of all texts, lower-cased, most frequent first.

    Words are classed by count (64 classes for each factor e, so a few thousand at any size); the uppermost classes come
    whole, as many as hold ``n_words`` together, and nothing else reaches the driver.
    """
    low, high = WORD_LENGTHS
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.where(F.length("word").between(low, high)).groupBy("word").count().withColumn("class", F.floor(F.log("count") * 64))
    counted = checkpointed(counted)
    held, least = 0, None
    for r in counted.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.col("class").desc()).collect():
        held += r["n"]
        if held > n_words:
            break
        least = r["class"]
    if least is None:
        return []
    return [r["word"] for r in counted.where(F.col("class") >= least).orderBy(F.col("count").desc(), "word").collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, stop) for each row."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text_col, n_words) if n_words else [])

    @F.pandas_udf(SPANS)
    def secret_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _guessers:  # one per worker process
            _guessers.clear()
            _guessers[name] = Guesser(shared.value)
        scan = _guessers[name].scan
        for series in texts:
            yield pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in scan(t)] for t in series], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col).cast("string")).alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS) -> DataFrame:
    """``doc_id``, counts by base kind, the digest of the base spans and all spans as text."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, id_col, text_col, n_words).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )
