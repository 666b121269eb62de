"""Connected components of a link table in distributed large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import checkpointed


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One round over directed rows (u, v): every neighbour v of u is linked to the least of u and its neighbours.

    The large star moves the neighbours greater than u; the small star moves u and the neighbours less than u.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = links.join(least, "u")
    if small:
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
    return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (vertex, component) for every vertex of the link table (a, b) of longs; the component is its least vertex.

    Each round is cut by a checkpoint; a round that changes nothing ends the search. Nothing but a count and a sum of
    hashes reaches the driver.

    Defined results: links of a vertex to itself are left out, and with it a vertex that has no other; so are links with a
    null end; links that repeat count once; an empty table gives an empty result.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen = digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, small=False)
        edges = checkpointed(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True))
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
