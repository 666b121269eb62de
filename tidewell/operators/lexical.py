"""Okapi BM25 of a user's words against offered documents, met in buckets of users.

A document travels as the list of its terms' numbers, once to each user that owns it or may be offered it; that a term of a
document is one of the user's words is seen within the bucket's task, so no shuffle holds pairs of user and term or of
document and term for each candidate. A bucket holds ``TERMS`` terms or so, which bounds a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import checkpointed

TERMS, LEAST_BUCKETS = 4_000_000, 32
SCORES = pa.schema([("user", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``id``, an integer: the place of each row from 0 in the order of ``key``, by sorted ranges and their sizes."""
    ranges = checkpointed(df.orderBy(key).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))  # a row for each range
    within = F.col("_at") - F.shiftleft("_range", 33)
    return ranges.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_offset") + within).cast("int").alias("id"))


def indexed(docs: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """``item, terms, idfs`` of rows docs(item, term): the numbers of an item's terms in the order of the terms, repeats
    included, with their idf. Negative values become ``epsilon`` times the mean idf."""
    tf = docs.groupBy("item", "term").agg(F.count("*").cast("int").alias("tf"))
    n = docs.agg(F.countDistinct("item").alias("n"))
    df = numbered(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
    raw = df.crossJoin(F.broadcast(n)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + F.lit(0.5)))  # one row
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "id", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))  # one row
    listed = tf.join(idf, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "idf"))).alias("found"))
    repeated = lambda c: F.flatten(F.transform("found", lambda x: F.array_repeat(x[c], x["tf"])))
    return listed.select("item", repeated("id").alias("terms"), repeated("idf").alias("idfs"))


def _terms(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term its row and its number, and of each row how many terms it has."""
    lists = rows.column("terms").combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(rows.num_rows), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size


def _first(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, how often each comes, and the values beside one of its rows."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.diff(np.r_[starts, len(keys)]), *(v[order[starts]] for v in values)


def _scores(top: int, k1: float, b: float, avg_len: float):
    def run(owned: pa.Table, offered: pa.Table) -> pa.Table:
        row, term, _ = _terms(owned)
        if not len(term) or not offered.num_rows:
            return SCORES.empty_table()
        users, place = np.unique(owned.column("user").to_numpy(), return_inverse=True)
        base = int(term.max()) + 2  # terms that no user of the bucket has are one number
        words, count, idf = _first(place[row] * base + term, owned.column("idfs").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        user = words // base
        if np.bincount(user).max() > top:
            order = np.lexsort((words, -count, user))
            rank = np.arange(len(words)) - np.searchsorted(user, user)
            kept = np.sort(order[rank < top])
            words, idf = words[kept], idf[kept]

        row, term, size = _terms(offered)
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
        tf, row, term = np.diff(np.r_[starts, len(row)]), row[starts], np.minimum(term[starts], base - 1)
        of = offered.column("user").to_numpy()
        place = np.searchsorted(users, of).clip(max=len(users) - 1)
        keys = np.where(users[place] == of, place, len(users))[row] * base + term
        at = np.searchsorted(words, keys).clip(max=len(words) - 1)
        met = np.flatnonzero(words[at] == keys)
        if not len(met):
            return SCORES.empty_table()
        row, tf = row[met], tf[met]
        gain = idf[at[met]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / avg_len))
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        user, item, score = of[row[starts]], offered.column("item").to_numpy()[row[starts]], np.add.reduceat(gain, starts)
        order = np.lexsort((item, user))  # an item may be offered twice
        user, item = user[order], item[order]
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (item[1:] != item[:-1])])
        return pa.table([user[starts], item[starts], np.add.reduceat(score[order], starts)], schema=SCORES)

    return run


def okapi(owned: DataFrame, offered: DataFrame, n_rows: int, avg_len: float, top: int, k1: float, b: float) -> DataFrame:
    """``user, item, score`` of rows offered(user, item, terms) by the ``top`` most frequent terms of the user's rows
    owned(user, terms, idfs), ties by the order of the terms; ``n_rows`` is about how many rows there are of both."""
    n = max(LEAST_BUCKETS, int(n_rows * avg_len) // TERMS + 1)
    bucket = F.pmod(F.xxhash64("user"), F.lit(n)).cast("int").alias("bucket")
    dealt = lambda rows, *columns: rows.where("terms IS NOT NULL").select(bucket, *[F.col(c).alias(c) for c in columns]).repartition(n, "bucket").groupBy("bucket")  # noqa: E731, both may come of one table
    # no list is null: a run of null lists makes the transfer of a batch to Python quadratic
    met = dealt(owned, "user", "terms", "idfs").cogroup(dealt(offered, "user", "item", "terms"))
    return met.applyInArrow(_scores(top, k1, b, avg_len), "user long, item long, score double")
