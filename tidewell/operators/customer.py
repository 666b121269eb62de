"""Customer features: recency and frequency, lifecycle, frequent words, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.sampling import positions

DAY = 86400


def rfm(orders: DataFrame, reference: DataFrame) -> DataFrame:
    """AGG2: per user recency in days, orders per month of 30.4 days (span at least a second, at least one month), count."""
    seconds = lambda c: F.unix_timestamp(c)
    per = orders.groupBy("user").agg(F.min(seconds(F.col("ts"))).alias("first"), F.max(seconds(F.col("ts"))).alias("last"), F.count("*").alias("n"))
    span = F.greatest(F.col("last") - F.col("first"), F.lit(1))
    return per.crossJoin(F.broadcast(reference)).select(  # one row
        "user",
        F.round((seconds(F.col("reference")) - F.col("last")) / DAY, 6).alias("recency_days"),
        F.round(F.col("n") / F.greatest(span / (DAY * 30.4), F.lit(1.0)), 6).alias("frequency"),
        "n",
    )


def lifecycle(recency: Column, frequency: Column) -> Column:
    """AGG3: the stage of a customer; without orders (null recency) a prospect."""
    return (
        F.when(recency.isNull(), "prospect")
        .when(recency > 730, "churned")
        .when(recency > 365, F.when(frequency > 0.5, "win_back_candidate").otherwise("churned"))
        .when(recency > 180, "at_risk")
        .when(recency > 60, "active")
        .when(frequency > 1, "loyal_active")
        .when((recency < 30) & (frequency > 0.3), "active")
        .otherwise("acquisition")
    )


def frequent_words(texts: DataFrame, group: str, text: str, stop: DataFrame, n: int = 20) -> DataFrame:
    """AGG4: the ``n`` most frequent words of three letters or more of each group, ties in alphabetical order."""
    words = texts.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]{3,}"), 0)).alias("word"))
    counts = words.join(F.broadcast(stop), "word", "left_anti").groupBy(group, "word").agg(F.count("*").alias("n_word"))
    order = Window.partitionBy(group).orderBy(F.col("n_word").desc(), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_per(df: DataFrame, group: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """TOP2 and TOP3: the first ``n`` rows of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def stratify(users: DataFrame, n_a: int, n_b: int, n_c: int) -> DataFrame:
    """TOP1: group A has the most items (at least 5), B of the rest the most words (at least 5 items, over 100 words), C
    of the rest the fewest items; ties by user. Each stage is a distributed top-k and an anti join of bounded size."""
    a = users.where("items >= 5").orderBy(F.col("items").desc(), "user").limit(n_a).withColumn("grp", F.lit("A"))
    left = users.join(F.broadcast(a.select("user")), "user", "left_anti")
    b = left.where("items >= 5 AND words > 100").orderBy(F.col("words").desc(), "user").limit(n_b).withColumn("grp", F.lit("B"))
    left = left.join(F.broadcast(b.select("user")), "user", "left_anti")
    c = left.orderBy("items", "user").limit(n_c).withColumn("grp", F.lit("C"))
    return a.unionByName(b).unionByName(c)


def character_budget(rows: DataFrame, group: str, order: list[Column], line: str, cap: int) -> DataFrame:
    """WIN4: lines of a group, newest first, while their lengths plus one each stay within ``cap``; the line that crosses
    it is cut."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = rows.withColumn("used", F.sum(F.length(line) + 1).over(w)).withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    before = F.col("used") - F.length(line) - 1
    return used.where(before < cap).withColumn(line, F.when(F.col("used") <= cap, F.col(line)).otherwise(F.col(line).substr(F.lit(1), (F.lit(cap) - before).cast("int"))))


def pair_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *groups: str) -> DataFrame:
    """WIN9: the k-th row of a group on the left takes the k-th row of that group on the right, in hash order of the ids;
    without groups, of all rows."""
    return positions(left, left_id, *groups).join(positions(right, right_id, *groups), [*groups, "pos"]).drop("pos")


def nearest_controls(items: DataFrame, flagged: str, kind: str, size: str, key: str, n: int = 3) -> DataFrame:
    """JN11: for each flagged row the ``n`` others of its kind with the nearest size, ties by key: rows (dirty, clean).

    Rows are first reduced to the distinct sizes of each kind, each with its ``n`` smallest keys. Windows over these, one
    row per distinct size, bring each size the next ``n`` sizes that have controls below and above; a flagged row finds
    its controls among them, however far away they are.
    """
    clean = items.where(~F.col(flagged)).select(kind, size, F.col(key).alias("_id")).distinct()
    first = clean.withColumn("_k", F.row_number().over(Window.partitionBy(kind, size).orderBy("_id"))).where(F.col("_k") <= n)  # cut before the shuffle too
    ids = first.groupBy(kind, size).agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    of = items.select(kind, size).distinct().join(ids, [kind, size], "left").withColumn("_ids", F.coalesce("_ids", F.slice(F.array(F.lit(None).cast(items.schema[key].dataType)), 1, 0)))
    sizes = of.withColumn("_own", F.when(F.size("_ids") > 0, F.transform("_ids", lambda i: F.struct(F.col(size).alias("size"), i.alias("id")))))
    w = Window.partitionBy(kind).orderBy(size)
    some = sizes.where("_own IS NOT NULL")
    flat = lambda over: F.flatten(F.collect_list("_own").over(over))
    some = some.select(kind, size, flat(w.rowsBetween(1 - n, 0)).alias("_down"), flat(w.rowsBetween(0, n - 1)).alias("_up"))
    known = sizes.select(kind, size).join(some, [kind, size], "left")
    below = F.last("_down", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_up", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = known.select(kind, size, F.array_union(F.coalesce(below, F.array().cast("array<struct<size:long,id:long>>")), F.coalesce(above, F.array().cast("array<struct<size:long,id:long>>"))).alias("_near"))
    asked = items.where(F.col(flagged)).select(F.col(key).alias("dirty"), kind, size).join(near, [kind, size])
    ranked = F.slice(F.sort_array(F.transform("_near", lambda c: F.struct(F.abs(c["size"] - F.col(size)).alias("d"), c["id"].alias("id")))), 1, n)
    return asked.select("dirty", F.explode(ranked).alias("c")).select("dirty", F.col("c.id").alias("clean"))
