"""URL rules by expansion, hash-prefix join, digest check and precedence.

Each distinct (host, path) is expanded into its host suffixes, each followed by those prefixes of its path that are as
long as the path of some rule. The expressions meet the rules in an equi-join on the first 32 bits of their SHA-256;
full digests confirm a hit. The longest rule wins, then the rule with the longer host, then a block.

Scale: urls are reduced to distinct (host, path) before the expansion, so a url on a third of all rows is expanded once;
the expansion has at most (labels of the longest rule host) x (distinct lengths of rule paths) rows for each of them.
Rules come as a table; Spark broadcasts it only while it is under the session's threshold and shuffles it otherwise.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the default verdict; rows
that repeat give rows that repeat; an empty table gives an empty result. Only the identifier and the url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict``. ``rules`` has the columns host, path, verdict ('allow' or 'block')."""
    host, path = url_parts(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")
    ).first()  # one row: the labels of the longest host and the distinct path lengths
    labels, lengths = shape["labels"] or 0, shape["lengths"] or []
    hashed = rules.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("host_length"),
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, 8))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
        lambda k: F.array_join(F.slice(parts, -k, k), "."),
    )
    expanded = (
        urls.where("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("take", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
        .where("length(path) >= take")
        .withColumn("digest", F.sha2(F.concat("suffix", F.expr("substring(path, 1, take)")), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    best = (
        expanded.join(hashed, "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
