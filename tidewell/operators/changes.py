"""Record changes under optimistic checks, review, history, and audit chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judge_changes(changes: DataFrame, current: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """CHG1: each change (key, field, value, expected) against the current rows (key, field, old, stamp).

    ``allowed`` maps a field to the pattern of its values. Outcomes: bad_field, bad_value, missing, stale, applied.
    """
    ok = F.lit(False)
    for field, pattern in allowed.items():
        ok = F.when(F.col("field") == field, F.col("value").rlike(pattern)).otherwise(ok)
    joined = changes.join(current, ["key", "field"], "left")
    outcome = (
        F.when(~F.col("field").isin(*allowed), "bad_field").when(~ok, "bad_value").when(F.col("stamp").isNull(), "missing").when(F.col("stamp") != F.col("expected"), "stale").otherwise("applied")
    )
    return joined.withColumn("outcome", outcome)


def apply_changes(current: DataFrame, judged: DataFrame) -> DataFrame:
    """The snapshot after the applied changes; of several changes of a field the one with the highest id counts."""
    won = judged.where("outcome = 'applied'").groupBy("key", "field").agg(F.max_by("value", "change_id").alias("value"))
    return current.join(won, ["key", "field"], "left").select("key", "field", F.coalesce("value", "old").alias("value"), F.col("value").isNotNull().alias("changed"))


def review_queue(pending: DataFrame, reviews: DataFrame, current: DataFrame) -> DataFrame:
    """CHG2: pending changes with current value; reviewed ones become applied, conflict or rejected."""
    joined = pending.join(reviews, "change_id", "left").join(current, ["key", "field"], "left")
    still = F.col("stamp") == F.col("expected")
    state = F.when(F.col("approved").isNull(), "pending").when(~F.col("approved"), "rejected").when(still, "applied").otherwise("conflict")
    return joined.select("change_id", "key", "field", F.col("old").alias("current_value"), F.coalesce(still, F.lit(False)).alias("still_current"), state.alias("state"))


def history(log: DataFrame) -> DataFrame:
    """CHG3: validity intervals of each field value, newest open."""
    w = Window.partitionBy("key", "field").orderBy("ts", "change_id")
    return log.select("key", "field", "value", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), F.lead("ts").over(w).isNull().alias("latest"))


def chain_hash(*columns: str):
    """The digest of a row's fields; a null field keeps its place as an empty one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def verify_chain(audit: DataFrame, group: str, fields: tuple[str, ...], linked_hash: bool = True) -> DataFrame:
    """AUD1: per chain the number of rows, the first row whose sequence, link or own hash breaks, and its kind.

    Each row carries the hash of the row before it, so rows meet their neighbour in an equi-join on (chain, seq), and one
    very long chain is spread over all tasks. ``linked_hash``: whether the row's own hash covers the hash before it.
    A number that is missing, or is there twice, breaks the sequence; a null hash breaks what it should prove.
    """
    at = audit.groupBy(group, "seq").agg(F.count("*").alias("_times"), F.first("this_hash").alias("_hash"))
    before = at.select(F.col(group).alias("_group"), (F.col("seq") + 1).alias("_next"), F.col("_hash").alias("_before"), F.lit(True).alias("_known"))
    twice = at.where("_times > 1").select(F.col(group).alias("_g"), F.col("seq").alias("_s"), F.lit(True).alias("_twice"))
    joined = audit.join(before, audit[group].eqNullSafe(F.col("_group")) & (F.col("seq") == F.col("_next")), "left")
    joined = joined.join(twice, audit[group].eqNullSafe(F.col("_g")) & (F.col("seq") == F.col("_s")), "left")
    own = chain_hash(*fields, *(("prev_hash",) if linked_hash else ()))
    kind = (
        F.when(F.coalesce("_twice", F.lit(False)) | F.col("seq").isNull() | ((F.col("seq") != 0) & F.col("_known").isNull()), "sequence")
        .when(~F.col("prev_hash").eqNullSafe(F.when(F.col("seq") == 0, F.lit("0" * 64)).otherwise(F.col("_before"))), "link")
        .when(~F.col("this_hash").eqNullSafe(own), "hash")
    )
    broken = joined.select(audit[group].alias(group), "seq", kind.alias("kind"))
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("seq", "kind"))).alias("first")
    return broken.groupBy(group).agg(F.count("*").alias("n"), first).select(group, "n", F.col("first.seq").alias("broken_at"), F.col("first.kind").alias("kind"))
