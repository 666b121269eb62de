"""Exact dedup by merging sorted digest runs in a tree.

Every input partition is one run: its rows as (SHA-256 digest, length, second hash, identifier), sorted by digest. In
each round, groups of ``fan_in`` neighbouring runs exchange their rows by (run group, digest) and merge them, keeping of
each digest the identifier that stays and the number of copies. With the default of eight, a round is three levels of the
binomial tree in one multiway merge; with two, it is one. Spark has no exchange that keeps runs in order, so the merge of
a round is its sort-based aggregation: what arrives is sorted by (run group, digest) again and reduced in one pass. After
log(runs) rounds one run is left, dealt out over all tasks by digest. A group of copies that holds a third of all rows is
thus at most ``fan_in`` rows per digest and merge task from the second round on, and partial aggregation shortens it
before the first exchange.

The digest is verified: rows merge only if digest, length and an independent 64-bit hash of the whole text agree.

Defined results: null text counts as empty; null identifiers sort before all others; of rows that repeat the kept
identifier too, exactly one stays (the one with the largest row number of the run table); an empty table gives an empty
result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import free_name, null_as_empty
from tidewell.session import checkpointed

DIGEST = ("digest", "n_bytes", "verify")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One sorted run of digests for each partition of ``docs``, kept as a checkpoint."""
    text = null_as_empty(F.col(text_col))
    runs = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.spark_partition_id().alias("run"),
        F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("verify"),
    )
    return checkpointed(runs.sortWithinPartitions("digest"))


def merge_runs(runs: DataFrame, keep: str = "max", fan_in: int = 8) -> DataFrame:
    """The last run: one row per digest with ``keep_id``, ``keep_row`` and ``group_size``."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    best = F.max if keep == "max" else F.min
    level = runs.select(
        "run", *DIGEST, F.struct(F.col("doc_id").alias("id"), F.col("row_no").alias("row")).alias("stays"), F.lit(1).cast("long").alias("n")
    )
    left = runs.rdd.getNumPartitions()
    while True:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *DIGEST)
            .agg(best("stays").alias("stays"), F.sum("n").alias("n"))
        )
        if left <= 1:
            break
    return level.select(*DIGEST, F.col("stays.id").alias("keep_id"), F.col("stays.row").alias("keep_row"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says whether the largest or the smallest identifier of equal texts stays.
    """
    runs = digest_runs(docs, id_col, text_col)
    # a digest that occurs once decides for itself: only the groups of copies go into the join
    groups = merge_runs(runs, keep, fan_in).where("group_size > 1")
    return runs.join(groups, [*DIGEST], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by (identifier, digest); of rows that repeat both, which are equal in text and identifier, one
    stays.
    """
    dropped = checkpointed(
        exact_dedup(docs, id_col, text_col, keep, fan_in)
        .where("NOT kept")
        .select(F.col("doc_id").alias("_dropped_id"), F.col("text_sha256").alias("_dropped_digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_same_id"))
        .distinct()
    )
    digest = F.sha2(null_as_empty(docs[text_col]), 256)
    repeated = dropped.where("_same_id").select("_dropped_id", "_dropped_digest")
    hit = lambda d: docs[id_col].eqNullSafe(d["_dropped_id"]) & (digest == d["_dropped_digest"])
    stays = docs.join(dropped, hit(dropped), "left_anti")
    if repeated.isEmpty():
        return stays
    by_digest = free_name(docs, "_digest")
    once = docs.join(repeated, hit(repeated), "left_semi").withColumn(by_digest, digest).dropDuplicates([id_col, by_digest]).drop(by_digest)
    return stays.unionByName(once)
