"""Sinks: whole databases, run outputs, table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_database(tables: dict[str, DataFrame], folder: str, force: bool = False) -> None:
    """SNK1: all tables in the given (foreign key) order; an existing target is refused unless forced, then replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite" if force else "errorifexists").parquet(f"{folder}/{name}.parquet")


def write_run(df: DataFrame, folder: str, run_id: str, kind: str = "json") -> None:
    """SNK2: results of one run under its own partition, as csv, json or parquet."""
    tagged = df.withColumn("run_id", F.lit(run_id))
    getattr(tagged.write.mode("append").partitionBy("run_id"), kind)(folder)


def fingerprint(df: DataFrame) -> DataFrame:
    """SNK3: rows and an order-free digest of a table's content."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))
