"""Language ID by nearest centroids of TF-IDF n-gram vectors.

Texts are lower-cased, everything but letters becomes one space, and character 1- to 3-grams are hashed into ``DIM``
dimensions; counts are damped, weighted by inverse document frequency and normalised. A language has several centroids
(spherical k-means), as one language comes in several kinds of text. A text gets the language of the centroid with the
largest cosine; it is rejected if that cosine is under the language's limit for texts of its size. Own cosines grow
with the number of distinct n-grams, those of an unlearned language hardly do; so a limit is ``reject_scale`` times the
1% quantile of the cosines of the language's own training texts, and of their beginnings, with as many distinct n-grams
(by powers of two, interpolated from middle to middle). Below some 64 distinct n-grams, or five words, the two overlap,
and the limits keep the text.

The model is fitted on a bounded sample: at most ``per_language`` distinct labelled rows of each language, those with
the smallest hashes of identifier and text in the whole table; the bound is a parameter. The model (centroids, weights, limits) is broadcast;
its size is languages x clusters x ``DIM`` floats whatever the input. Every text is judged whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and counts as rejected; the same holds
for every text if no labelled row exists; an empty table gives an empty result. Ties go to the language first by code
point. Repeated rows are judged each for itself and count once in learning. Only text (and, for fitting, label and
identifier) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.text import free_name

DIM = 4096
UNKNOWN = "und"
CLASSES = DIM.bit_length()
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of a text; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = np.r_[letter[0], letter[1:] | letter[:-1]]
    c = np.concatenate(([32], codes[keep], [32][: int(letter[-1])])).astype(np.uint32)
    counts = np.zeros(DIM, dtype=np.int64)
    for lo in range(0, len(c), 1 << 20):  # pieces overlap by two, so that no gram is lost
        x = c[lo : lo + (1 << 20) + 2]
        a = x * np.uint32(2654435761)
        counts += np.bincount((a[: 1 << 20] >> np.uint32(20)), minlength=DIM)
        b = (a[:-1] ^ (x[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        counts += np.bincount(b[: 1 << 20] >> np.uint32(20), minlength=DIM)
        if len(x) > 2:
            t = (b[:-1] ^ (x[2:] * np.uint32(668265263))) * np.uint32(374761393)
            counts += np.bincount(t[: 1 << 20] >> np.uint32(20), minlength=DIM)
    return counts


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x DIM, unit rows
    idf: np.ndarray
    limits: np.ndarray  # of each centroid's language, by size class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def limit(self, centroid: int, counts: np.ndarray) -> float:
        return float(np.interp(np.log2(np.count_nonzero(counts)), np.arange(CLASSES) + 0.5, self.limits[centroid]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        found = [(i, c) for i, t in enumerate(texts) if (c := ngram_counts(t)) is not None]
        if found and self.langs:
            cosine = self.vectors(np.stack([c for _, c in found])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for (i, c), k, s in zip(found, best, cosine[np.arange(len(found)), best], strict=True):
                langs[i], scores[i], rejected[i] = self.langs[k], min(1.0, max(0.0, float(s))), s < self.limit(k, c)
        return langs, scores, rejected


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    mid = _unit(x.mean(axis=0, keepdims=True))
    chosen = [int((x @ mid[0]).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centers = x[chosen]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        centers = np.stack([_unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).any() else centers[j] for j in range(len(centers))])
    return centers


def beginnings(text: str) -> list[str]:
    """The text, and its beginnings of 1, 2, 4 and so on characters."""
    return [text, *[text[: 1 << k] for k in range(max(0, len(text) - 1).bit_length())]]


def _limits(classes: np.ndarray, cosines: np.ndarray, scale: float, least: int = 20) -> np.ndarray:
    """The limit of each size class; a class of under ``least`` pieces takes those of the next smaller ones too."""
    limits = np.zeros(CLASSES)
    for k in range(CLASSES):
        low = next((j for j in range(k, 0, -1) if ((classes >= j) & (classes <= k)).sum() >= least), 0)
        near = cosines[(classes >= low) & (classes <= k)]
        if len(near):
            limits[k] = scale * float(np.quantile(near, 0.01))
    return limits


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32(identifier as text) mod 4 is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """Of rows (id, text, lang): the ``per_language`` distinct ones of each language with the smallest hashes.

    A threshold that lets about twice as many of each language pass goes first, so that only these few are shuffled.
    """
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 2.0 * per_language / n + 64.0 / n))])
    place = F.xxhash64("id", "text", F.lit("langid"))  # even from -2^63 to 2^63
    few = rows.withColumn("place", place).where(F.col("place").cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")]).dropDuplicates(["lang", "place"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 4, reject_scale: float = 0.6
) -> LanguageModel:
    """The model of the labelled rows outside the held-out fold, from at most ``per_language`` rows of each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return LanguageModel([], np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros((0, CLASSES)))
    sample = labelled_sample(rows, sizes, per_language)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 32):  # full counts are 32 kB a piece, so each goes before the next comes
                found = [
                    (lang, k == 0, np.flatnonzero(c).astype("<u2").tobytes(), c[c > 0].astype("<f4").tobytes())
                    for lang, t in zip(batch["lang"][lo : lo + 32], batch["text"][lo : lo + 32], strict=True)
                    for k, p in enumerate(beginnings(t or ""))
                    if (c := ngram_counts(p)) is not None
                ]
                yield pd.DataFrame(found, columns=["lang", "whole", "at", "n"])

    columns = "lang string, whole boolean, at binary, n binary"
    got = sorted((r["lang"], r["whole"], bytes(r["at"]), bytes(r["n"])) for r in sample.mapInPandas(sparse, columns).collect())
    pieces = [(lang, np.frombuffer(at, "<u2"), np.frombuffer(n, "<f4")) for lang, _, at, n in got]
    wholes = [p for p, g in zip(pieces, got, strict=True) if g[1]]
    counts = np.zeros((len(wholes), DIM), dtype=np.float32)
    for i, (_, at, n) in enumerate(wholes):
        counts[i, at] = n
    idf = (np.log((1 + len(wholes)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    langs, centroids, limits = [], [], []
    for lang in sorted(sizes):
        own = x[[i for i, p in enumerate(wholes) if p[0] == lang]]
        if len(own):
            centers = _clusters(own, clusters)
            mine = [(at, np.log1p(n) * idf[at]) for g, at, n in pieces if g == lang]
            cosines = np.array([float((centers[:, at] @ v).max() / max(np.linalg.norm(v), 1e-12)) for at, v in mine])
            langs += [lang] * len(centers)
            centroids.append(centers)
            limits += [_limits(np.array([len(at).bit_length() - 1 for at, _ in mine]), cosines, reject_scale)] * len(centers)
    return LanguageModel(langs, np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIM), np.float32), idf, np.array(limits).reshape(-1, CLASSES))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a struct column ``to``: lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            out = [shared.value.predict(series[lo : lo + 256].tolist()) for lo in range(0, len(series), 256)]
            yield pd.DataFrame(
                {"lang_pred": [x for o in out for x in o[0]], "score": np.concatenate([np.zeros(0), *[o[1] for o in out]]), "rejected": np.concatenate([np.zeros(0, bool), *[o[2] for o in out]])}
            )

    return docs.withColumn(to, predict(F.col(text_col).cast("string")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row, by a model fitted on the same table."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    judged = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), model, "_text", "_language")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score", "_language.rejected")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    language = free_name(docs, "_language")
    judged = with_language(docs, fit(docs, id_col, text_col, lang_col, **options), text_col, language)
    return judged.where(~F.col(language)["rejected"]).drop(language)
