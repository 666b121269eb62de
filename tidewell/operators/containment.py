"""Which texts contain any of many known values.

A value is indexed by the hash of one of its windows: of its windows of 32 characters (or the largest power of two that
fits in it) the one with the smallest hash. The hashed windows of a whole text are joined with that index, and the whole
value is then looked for in the text, so hash collisions do no harm. A bitmap of fixed size over the index keeps windows
that no value has out of the join; it only saves work, whatever the number of values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 32
BITS = 23
ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Window lengths 1, 2, 4 to 32, as far as the text goes, and the hashes of all windows of that length."""
    h = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)) * ODD
    size = 1
    while len(h):
        yield size, h
        if size == LONGEST:
            return
        h = h[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[size:] ^ (h[size:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        size *= 2


def _slots(h: np.ndarray) -> np.ndarray:
    return (h * ODD) >> np.uint64(64 - BITS)


def _index(values: pd.Series) -> pd.DataFrame:
    rows = []
    for v in values:
        size, h = list(windows(v))[-1]
        least = h.min(keepdims=True)
        rows.append((size, int(least.view(np.int64)[0]), int(_slots(least)[0])))
    return pd.DataFrame(rows, columns=["size", "hash", "slot"])


def containing(texts: DataFrame, text: str, values: DataFrame, value: str) -> DataFrame:
    """The distinct other columns of the ``texts`` that contain any whole value; values are stripped, null and empty ones
    ignored."""
    stripped = values.select(F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", "").alias("_value")).where("_value <> ''").distinct()
    known = stripped.withColumn("_at", F.pandas_udf(_index, "size int, hash long, slot int")("_value")).select("_value", F.col("_at.hash").alias("_hash"), F.col("_at.size").alias("_size"), F.col("_at.slot").alias("_slot"))
    parts = known.groupBy(F.shiftright("_slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("_slot").bitwiseAND(32767).cast("long")).alias("bits"), F.collect_set("_size").alias("sizes")).collect()
    bitmap, sizes = np.zeros(1 << (BITS - 3), dtype=np.uint8), {s for r in parts for s in r["sizes"]}  # at most 2^8 rows of 4 KB
    for r in parts:
        bitmap[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("array<long>")
    def likely(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            hits = [np.zeros(0, dtype=np.uint64)]
            for size, h in windows(t or ""):
                if size in sizes:
                    slots = _slots(h)
                    hits.append(h[(shared.value[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1])
            out.append(np.unique(np.concatenate(hits)).view(np.int64))
        return pd.Series(out)

    found = texts.withColumn("_hash", F.explode(likely(F.col(text))))
    return found.join(known.select("_hash", "_value"), (found["_hash"] == known["_hash"]) & F.contains(found[text], known["_value"])).select(*[found[c] for c in texts.columns if c != text]).distinct()
