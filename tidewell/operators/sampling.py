"""Deterministic sampling: every draw is a hash of seed and keys, so that reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 by MD5 of the parts, joined by ``|``."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def positions(df: DataFrame, key: str, *groups: str, hashed: bool = False) -> DataFrame:
    """``df`` with ``pos``, the place of each row from 0 in the order of the key's MD5, in its group if there are groups.

    Numbering is in two levels, so that no task holds the table or a group: counts of the 4096 prefixes of the hash give
    each prefix its offset, and a window numbers the rows of one prefix. ``hashed``: the key is a hash already.
    """
    order = F.col(key).cast("string") if hashed else F.md5(F.col(key).cast("string"))
    slots = df.withColumn("_hash", order).withColumn("_slot", F.substring("_hash", 1, 3))
    keys = [*groups, "_slot"]
    counts = slots.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slot")  # 4096 rows at most
    offsets = counts.select(*keys, (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", key)) - 1
    placed = slots.withColumn("_within", within).join(offsets, keys)
    return placed.withColumn("pos", F.col("_offset") + F.col("_within")).drop("_hash", "_slot", "_offset", "_within")


def next_prime(n: int) -> int:
    """The least prime that is not less than ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fresh_items(wants: DataFrame, taken: DataFrame, catalog: DataFrame, seed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """For rows wants(user, n): the first ``n`` items of each user's own order that ``taken`` (user, item) does not hold.

    Rows (user, item, k), and of the catalogue the columns to ``keep``. A user's order walks the catalogue, in the order of its hashes, by steps of the user's own
    modulo a prime: no item comes twice, so n plus as many places as the user has taken items are enough, whatever n and
    the catalogue are, and users times items never exists. A user gets fewer only where the catalogue is spent.
    """
    items = positions(catalog.select("item", *keep), "item")
    n_items = catalog.count()
    prime = next_prime(n_items)
    held = taken.join(items.select("item", "pos"), "item").groupBy("user").agg(F.collect_list("pos").alias("held"))
    start, step = draw(seed, F.col("user").cast("string"), "start") % prime, draw(seed, F.col("user").cast("string"), "step") % (prime - 1) + 1
    walks = wants.select("user", "n", start.alias("start"), step.alias("step")).join(held, "user", "left").withColumn("held", F.coalesce("held", F.array().cast("array<bigint>")))
    # the walk and what it leaves out meet as places, within the user's row; only the items that stay are rows
    steps = F.least(F.col("n") + F.size("held") + F.lit(prime - n_items), F.lit(prime)).cast("int")
    walk = F.filter(F.transform(F.sequence(F.lit(0), steps - 1), lambda j: (F.col("step") * j + F.col("start")) % prime), lambda p: p < n_items)
    fresh = walks.select("user", F.posexplode(F.slice(F.array_except(walk, "held"), 1, F.col("n"))).alias("k", "pos"))
    return fresh.join(items, "pos").select("user", "item", (F.col("k") + 1).alias("k"), *keep)


def sampled_candidates(split: DataFrame, catalog: DataFrame, n: int = 100, seed: str = "7", keep: tuple[str, ...] = ()) -> DataFrame:
    """TOP5: ``n`` items that a user never bought (all of them, if the catalogue holds fewer), plus the hidden item.

    The columns to ``keep`` come along from the catalogue; they are null for a hidden item that it does not hold.
    """
    hidden = split.where("hidden").select("user", "item")
    negatives = fresh_items(hidden.select("user", F.lit(n).alias("n")), split.select("user", "item"), catalog, seed, keep)
    known = hidden.join(catalog.select("item", *keep), "item", "left") if keep else hidden
    return negatives.select("user", "item", *keep, F.lit(False).alias("hidden")).unionByName(known.withColumn("hidden", F.lit(True)))


def training_negatives(split: DataFrame, catalog: DataFrame, candidates: DataFrame, per_item: int = 5, seed: str = "n") -> DataFrame:
    """TOP7: ``per_item`` items for each item of a user's history, neither bought nor among the user's candidates."""
    wants = split.where("NOT hidden").groupBy("user").agg((F.count("*") * per_item).cast("int").alias("n"))
    taken = split.select("user", "item").union(candidates.where("NOT hidden").select("user", "item"))
    return fresh_items(wants, taken, catalog, seed).select("user", "item")


def shuffled(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """TOP8: a seeded permutation of the rows of each group, as column ``position`` from 1."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col(key).cast("string"))), key)
    return df.withColumn("position", F.row_number().over(order))


def quota_sample(df: DataFrame, group: str, key: str, forced: Column, quota: int, seed: str) -> DataFrame:
    """TOP6: ``quota`` rows of each group, forced members first by key, the rest by hash; too small a group is an error."""
    order = Window.partitionBy(group).orderBy(F.when(forced, 0).otherwise(1), F.when(forced, F.col(key)), F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    size = F.count("*").over(Window.partitionBy(group))
    checked = df.withColumn("_size", size).withColumn(
        "_n", F.when(F.col("_size") >= quota, F.row_number().over(order)).otherwise(F.raise_error(F.lit("a quota is larger than its group")).cast("int"))
    )
    return checked.where(F.col("_n") <= quota).drop("_size", "_n")


def weighted_draws(draws: DataFrame, population: DataFrame, weight: str, key: str, slot: str) -> DataFrame:
    """JN10: for each draw (column ``u`` in [0, 1)) the member of ``population`` whose cumulative weight range holds it.

    A range join over intervals: ranges and draws are cut into the same ``slot`` count of equal parts, so the join is an
    equi-join on the part with a check of the bounds.
    """
    slots = int(slot)
    # prefix sums in two levels: of the hash prefixes of the key, then within each
    hashed = population.select(key, weight, F.substring(F.md5(F.col(key).cast("string")), 1, 3).alias("_slot"))
    sums = hashed.groupBy("_slot").agg(F.sum(weight).alias("_sum"))
    offsets = sums.select("_slot", (F.sum("_sum").over(Window.orderBy("_slot")) - F.col("_sum")).alias("_offset"), F.sum("_sum").over(Window.partitionBy()).alias("total"))  # 4096 rows at most
    within = F.sum(weight).over(Window.partitionBy("_slot").orderBy(F.md5(F.col(key).cast("string")), key))
    ranges = hashed.withColumn("_within", within).join(F.broadcast(offsets), "_slot")
    ranges = ranges.select(key, (F.col("_offset") + F.col("_within") - F.col(weight)).alias("lo"), (F.col("_offset") + F.col("_within")).alias("hi"), "total")
    part = lambda c: F.floor(c * slots / F.col("total"))
    cut = ranges.withColumn("part", F.explode(F.sequence(part(F.col("lo")), F.least(part(F.col("hi")), F.lit(slots - 1)))))
    return draws.withColumn("part", F.floor(F.col("u") * slots)).join(cut, "part").where("u * total >= lo AND u * total < hi").drop("part", "lo", "hi", "total")


def hot_warm_assignment(ids: DataFrame, key: str, n_targets: int, seed: str = "hot") -> DataFrame:
    """TOP11: 45 % of the rows go to the first 8 % of targets, 35 % to the next 25 %, the rest to any."""
    p = draw(seed, F.col(key).cast("string")) % 1000
    pick = draw(seed + "-pick", F.col(key).cast("string"))
    hot, warm = max(1, n_targets * 8 // 100), max(1, n_targets * 25 // 100)
    target = F.when(p < 450, pick % hot).when(p < 800, hot + pick % warm).otherwise(pick % n_targets)
    return ids.withColumn("target", target).withColumn("tier", F.when(p < 450, "hot").when(p < 800, "warm").otherwise("any"))
