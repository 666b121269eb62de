"""Purchases as interactions, and the leave-one-out split that every evaluation starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.session import table

#: Columns that put the purchases of a customer into one order; (order, line) alone is not unique.
RECENCY = ("ts", "order_id", "line_no", "price", "rating")


def purchase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: purchases with their order and product keys, one row per line; rating is 1 to 5."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_extendedprice").alias("price"),
        (F.pmod(F.col("l_quantity").cast("int"), F.lit(5)) + 1).alias("rating"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    return lines.join(orders, "order_id")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, item): the last purchase, so that a hidden item never stays in the history.

    The maximum of a struct is a map-side combined aggregate; a window would sort all rows.
    """
    last = F.max(F.struct(*RECENCY)).alias("last")
    return purchase_rows(spark, sf_dir).groupBy("user", "item").agg(last).select("user", "item", "last.*")


def leave_one_out(inter: DataFrame) -> DataFrame:
    """WIN1: ``hidden`` marks the last item of each user with at least two; ties go to the highest keys."""
    newest = Window.partitionBy("user").orderBy(*[F.col(c).desc() for c in ("ts", "order_id", "line_no", "item")])
    ranked = inter.withColumn("pos", F.row_number().over(newest)).withColumn("n", F.count("*").over(Window.partitionBy("user")))
    return ranked.where("n >= 2").select("user", "item", "rating", "ts", "n", (F.col("pos") == 1).alias("hidden"))


def history(split: DataFrame) -> DataFrame:
    return split.where("NOT hidden").select("user", "item", "rating", "ts")


def hidden(split: DataFrame) -> DataFrame:
    return split.where("hidden").select("user", "item")


def population(rows: DataFrame, held: DataFrame) -> DataFrame:
    """REC14: all purchase rows but those of the pairs held(user, item), one row per (user, item) with the sum of ratings.

    Nothing else is left out: users with a single item, earlier purchases of an item and other users' last items stay. A
    purchase weighs 1 + rating and the method adds 1 for a pair, so each further purchase of the pair adds 1 here.
    """
    summed = rows.groupBy("user", "item").agg((F.sum(F.col("rating") + 1) - 1).alias("rating"))
    return summed.join(held.select("user", "item"), ["user", "item"], "left_anti")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with title, category, description and price."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("description"),
        F.col("p_retailprice").alias("price"),
    )
