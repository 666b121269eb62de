"""Recommenders as joins: each gives rows (user, item, score); a missing row is no opinion.

Users times items never exists. Methods that score pairs through other users or items take the pairs to score from a
table of candidates and let joins on user or item do the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.cells import grid, vector_dots, vector_sums
from tidewell.operators.cobuyers import reached
from tidewell.operators.lexical import indexed, okapi
from tidewell.operators.sampling import fresh_items
from tidewell.session import checkpointed


def popularity(hist: DataFrame) -> DataFrame:
    """REC1: buyers per item over the histories, as rows (item, score)."""
    return hist.groupBy("item").agg(F.countDistinct("user").cast("double").alias("score"))


def for_candidates(candidates: DataFrame, item_scores: DataFrame) -> DataFrame:
    return candidates.select("user", "item").join(item_scores, "item").select("user", "item", "score")


def naive_bayes(hist: DataFrame, candidates: DataFrame, n_classes: int = 500) -> DataFrame:
    """REC4: multinomial naive Bayes in closed form by joins.

    Classes are the most bought items. Each (user, owned class) is a training row with the user's other items as
    features; a class's score is its log prior plus the smoothed log likelihoods of the user's whole history,
    normalised over all classes. Users times classes never exists: only classes that gain from the history get a row.
    """
    buyers = hist.groupBy("item").agg(F.count("*").alias("c"))
    classes = buyers.orderBy(F.col("c").desc(), "item").limit(n_classes).select(F.col("item").alias("cls"), F.col("c").alias("rows"))
    n_items = hist.select("item").distinct().agg(F.count("*").alias("n_items"))
    total_rows = classes.agg(F.sum("rows").alias("all_rows"))
    owners = hist.join(F.broadcast(classes.select(F.col("cls").alias("item"))), "item").select("user", F.col("item").alias("cls"))
    pairs = owners.join(hist.select("user", "item"), "user").where("item <> cls").groupBy("cls", "item").agg(F.count("*").alias("c"))
    mass = pairs.groupBy("cls").agg(F.sum("c").alias("mass"))
    prior = (
        classes.join(mass, "cls", "left")
        .crossJoin(F.broadcast(n_items.crossJoin(total_rows)))  # one row
        .select(
            "cls",
            F.ln(F.col("rows") / F.col("all_rows")).alias("prior"),
            (F.coalesce("mass", F.lit(0)) + F.col("n_items")).cast("double").alias("denominator"),
        )
    )
    sizes = hist.groupBy("user").agg(F.count("*").alias("n"))
    # an item that never met the class adds ln(1 / denominator); what it adds beyond that comes from the pairs that exist
    extra = hist.select("user", "item").join(pairs.withColumn("gain", F.ln(F.col("c") + F.lit(1.0))), "item").groupBy("user", "cls").agg(F.sum("gain").alias("gain"))
    # without gains a class's score depends on the history's size alone, so all classes meet the sizes, not the users
    base = sizes.select("n").distinct().crossJoin(F.broadcast(prior)).select("n", "cls", (F.col("prior") - F.col("n") * F.ln("denominator")).alias("base"))  # at most n_classes rows
    best = base.groupBy("n").agg(F.max("base").alias("best"))
    plain = base.join(best, "n").groupBy("n", "best").agg(F.sum(F.exp(F.col("base") - F.col("best"))).alias("mass"))
    gained = extra.join(sizes, "user").join(base, ["n", "cls"]).select("user", "n", "cls", "base", (F.col("base") + F.col("gain")).alias("raw"))
    tops = sizes.join(gained.groupBy("user").agg(F.max("raw").alias("raw")), "user", "left").join(plain, "n")
    tops = tops.select("user", "n", F.greatest("best", "raw").alias("top"), "best", "mass")
    over = gained.join(tops.select("user", "top"), "user").groupBy("user").agg(F.sum(F.exp(F.col("raw") - F.col("top")) - F.exp(F.col("base") - F.col("top"))).alias("over"))
    norm = tops.join(over, "user", "left").select("user", "n", (F.col("top") + F.ln(F.col("mass") * F.exp(F.col("best") - F.col("top")) + F.coalesce("over", F.lit(0.0)))).alias("norm"))
    wanted = candidates.select("user", F.col("item").alias("cls")).join(norm, "user").join(base, ["n", "cls"]).join(gained.select("user", "cls", "raw"), ["user", "cls"], "left")
    return wanted.select("user", F.col("cls").alias("item"), F.round(F.coalesce("raw", "base") - F.col("norm"), 6).alias("score"))


def pair_rules(hist: DataFrame, min_support: float, min_confidence: float, top_items: int = 2000) -> DataFrame:
    """REC5: rules a -> b between frequent items with support, confidence and lift, by a self join of baskets."""
    counts = hist.groupBy("item").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "item").limit(top_items)
    baskets = hist.select("user", "item").join(F.broadcast(counts), "item")
    n = baskets.agg(F.countDistinct("user").alias("n"))
    a, b = baskets.select("user", F.col("item").alias("a"), F.col("c").alias("ca")), baskets.select("user", F.col("item").alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, "user").where("a <> b").groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("both")).crossJoin(F.broadcast(n))  # one row
    return pairs.where((F.col("both") / F.col("n") >= min_support) & (F.col("both") / F.col("ca") >= min_confidence)).select(
        "a", "b", (F.col("both") / F.col("n")).alias("support"), (F.col("both") / F.col("ca")).alias("confidence"), (F.col("both") * F.col("n") / (F.col("ca") * F.col("cb"))).alias("lift")
    )


def rule_scores(hist: DataFrame, rules: DataFrame) -> DataFrame:
    """Sum of lift times confidence over the rules that a user's history fires."""
    fired = hist.select("user", F.col("item").alias("a")).join(rules, "a")
    return fired.groupBy("user", F.col("b").alias("item")).agg(F.round(F.sum(F.col("lift") * F.col("confidence")), 6).alias("score"))


def adamic_adar(hist: DataFrame, candidates: DataFrame) -> DataFrame:
    """REC6: sum over shared items and co-buyers of 1 / ln(buyers).

    Factorised: the weight of a pair of users is summed over their shared items once, then meets the owners of each
    candidate item, all within the user's bucket. ``candidates`` are read twice.
    """
    return reached(hist, candidates).select("user", "item", F.round("score", 6).alias("score"))


def bm25(split: DataFrame, catalog: DataFrame, docs: DataFrame, negatives: int = 100, seed: str = "7", top: int = 200, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """REC7: Okapi scores of the candidates of ``sampled_candidates`` by rows docs(item, term).

    A user's query is the ``top`` most frequent terms of the history, ties by the terms' order. Documents come along where
    candidates are drawn, so a candidate is shuffled once to its item and once to its user. Negative idf values become
    ``epsilon`` times the mean idf. No common term is no opinion. ``split`` is read three times.
    """
    index = checkpointed(indexed(docs, epsilon))
    avg_len = index.agg(F.avg(F.size("terms"))).first()[0] or 1.0
    sizes = split.agg(F.count("*"), F.count_if("hidden")).first()
    mine = split.select("user", "item", "hidden").join(index, "item")
    wants = split.where("hidden").select("user", F.lit(negatives).alias("n"))
    drawn = fresh_items(wants, split.select("user", "item"), catalog.select("item").join(index, "item", "left"), seed, keep=("terms",))
    offered = drawn.select("user", "item", "terms").union(mine.where("hidden").select("user", "item", "terms"))
    scores = okapi(mine.where("NOT hidden"), offered, sizes[0] + sizes[1] * negatives, avg_len, top, k1, b)
    return scores.select("user", "item", F.round("score", 6).alias("score"))


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the norm is bound once by a list of one, as within the inner function each element would compute it anew
    scaled = F.transform(F.array(F.when(norm > 0, norm).otherwise(1.0)), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    return vectors.select(key, scaled[0].alias("v"))


def mean_vectors(owned: DataFrame, vectors: DataFrame, blocks: tuple[int, int] | None = None) -> DataFrame:
    """``user, u``: the mean of the vectors(key, v) of the rows owned(user, key), at length one."""
    sums = vector_sums(owned, vectors, blocks or grid(owned, vectors))
    return unit(sums.select("user", F.transform("s", lambda x: x / F.col("n")).alias("mean")), "user", "mean").withColumnRenamed("v", "u")


def dense(owned: DataFrame, vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """REC8 and REC9: cosine of an item with the mean of the user's item vectors.

    ``owned`` has user and key, ``candidates`` also item; ``vectors`` has key and unit ``v``. Items may share a vector.
    """
    blocks = grid(owned, vectors)
    dots = vector_dots(candidates, mean_vectors(owned, vectors, blocks), vectors, blocks)
    return dots.select("user", "item", F.round("dot", 5).alias("score"))


def minmax(scores: DataFrame) -> DataFrame:
    """WIN8: scores of a user scaled to 0..1; a constant row becomes 0."""
    w = Window.partitionBy("user")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.select("user", "item", ((F.col("score") - lo) / F.when(hi - lo <= 1e-9, 1.0).otherwise(hi - lo)).alias("score"))


def hybrid(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """REC10: weighted sum of two scaled methods; what one has no opinion on counts as 0 there."""
    both = minmax(a).withColumnRenamed("score", "sa").join(minmax(b).withColumnRenamed("score", "sb"), ["user", "item"], "full_outer")
    return both.select("user", "item", F.round(weight * F.coalesce("sa", F.lit(0.0)) + (1 - weight) * F.coalesce("sb", F.lit(0.0)), 6).alias("score"))


def pair_features(hist: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """REC11: features of (user, item): history size / 100, mean rating / 5, title length / 100, description length /
    1000 and the share of the user's history in the item's category, over 10."""
    per_user = hist.groupBy("user").agg((F.count("*") / 100).alias("f_count"), F.round(F.avg("rating") / 5, 6).alias("f_rating"))
    shares = hist.join(items.select("item", "category"), "item").where("category IS NOT NULL").groupBy("user", "category").agg((F.count("*") / 10).alias("share"))
    people = per_user.join(shares.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("category", "share"))).alias("shares")), "user", "left")
    facts = items.select("item", "category", (F.length("title") / 100).alias("f_title"), (F.length("description") / 1000).alias("f_description"))
    met = pairs.join(facts, "item").join(people, "user")
    return met.withColumn("f_overlap", F.coalesce(F.try_element_at("shares", F.col("category")), F.lit(0.0))).drop("shares")


def ranked_list_scores(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """REC16: answers (user, ids) become scores k - position. A repeated or unknown item voids the answer; items left
    out are scored below all listed ones, in the order of their keys, and the answer counts as partial.

    Candidates and answers meet as lists in the user's row, so a candidate is shuffled once.
    """
    offered = candidates.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return list_scores(offered.join(answers.select("user", "ids"), "user"))


def list_scores(met: DataFrame) -> DataFrame:
    """``ranked_list_scores`` from rows met(user, items, ids) of sorted candidates and an answer."""
    known = (F.size("ids") > 0) & (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.size(F.array_except("ids", "items")) == 0)
    rest = F.array_except("items", "ids")
    good = met.where(known).select("user", F.size("items").alias("n"), (F.size(rest) > 0).alias("partial"), F.posexplode(F.concat("ids", rest)).alias("pos", "item"))
    return good.select("user", "item", (F.col("n") - F.col("pos") - 1).cast("double").alias("score"), "partial")


def best_query(queries: DataFrame, items: DataFrame) -> DataFrame:
    """REC18: rows queries(user, q) with unit vectors; an item's score is its largest cosine with any of the queries.

    All items are met, so the queries of the whole table are a bounded list (a few for each of a few users), which is
    broadcast.
    """
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return items.crossJoin(F.broadcast(queries)).groupBy("user", "item").agg(F.round(F.max(dot), 5).alias("score"))


def price_offer(recommended: DataFrame, discount: int = 15, from_rank: int = 3) -> DataFrame:
    """REC20: list price for rank 1, the discount for the lowest-ranked priced item from ``from_rank`` on; no row where
    either is missing. Rounding is half to even."""
    priced = recommended.where(F.col("price").isNotNull() & (F.col("price") != 0))
    picks = priced.groupBy("user").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("item", "price"))).alias("full"),
        F.max_by(F.struct("item", "price"), F.when(F.col("rank") >= from_rank, F.col("rank"))).alias("low"),
        F.max(F.when(F.col("rank") >= from_rank, F.col("rank"))).alias("low_rank"),
    )
    list_price = F.bround("low.price", 0).cast("long")
    return picks.where("full IS NOT NULL AND low_rank IS NOT NULL").select(
        "user", F.col("full.item").alias("full_item"), F.bround("full.price", 0).cast("long").alias("full_price"), F.col("low.item").alias("low_item"),
        list_price.alias("list_price"), F.bround(list_price * (100 - discount) / 100, 0).cast("long").alias("offer_price"),
    )
