"""Queries that drain a stream over the given tables, and round trips through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import identifiers as I
from tidewell.operators import sampling as S
from tidewell.plans.customer import KEYS
from tidewell.plans.registry import Registry
from tidewell.session import checkpointed, ensure_checkpoint_dir, table
from tidewell.sources import readers, writers
from tidewell.streaming import jobs

area = Registry()


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    rows = table(spark, d, name)
    parts = rows.inputFiles()  # a table is one file or a folder of files
    return jobs.file_stream(spark, f"{d}/{name}.parquet", rows.schema, single_file=parts[0].endswith(f"/{name}.parquet"))


MASK = "text"
for _kind in jobs.STREAMED:
    MASK = f"regexp_replace({MASK}, '{I.SHAPES[_kind]}', '<{_kind}>', 'g')"


@area.query(f"SELECT doc_id, {MASK} AS text FROM documents")
def st1_masking_stream(spark, d):
    return jobs.drained(jobs.masked_stream(_stream(spark, d, "documents").select("doc_id", "text")), _folder(spark))


@area.query("SELECT o_custkey AS user, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*) AS n FROM orders GROUP BY 1")
def st2_rfm_stream(spark, d):
    orders = _stream(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
    return jobs.drained(jobs.rfm_stream(orders), _folder(spark), "complete")


@area.query("SELECT user_id AS session, event_type AS entity, '<EVENT_' || row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) || '>' AS token FROM events GROUP BY 1, 2")
def st3_session_vault_stream(spark, d):
    mentions = _stream(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("entity"), F.col("event_id").alias("seq"))
    return jobs.drained(jobs.vault_stream(mentions), _folder(spark))


@area.query("SELECT event_id, event_type, value FROM events")
def src1_json_lines(spark, d):
    """Events written as JSON lines, every tenth as a Python literal, and read back."""
    folder = _folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    literal = F.format_string("{'event_id': %d, 'event_type': '%s', 'value': %s}", F.col("event_id"), F.col("event_type"), F.col("value").cast("string"))
    e.select(F.when(F.col("event_id") % 10 == 0, literal).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))).write.text(folder, compression="gzip")
    return readers.json_lines(spark, folder, e.schema, 8)[0]


@area.query("SELECT n_nationkey, n_name, n_name || '|' || n_regionkey AS tags FROM nation")
def src2_commented_csv(spark, d):
    folder = _folder(spark)
    lines = table(spark, d, "nation").select(F.concat(F.lit("# provenance\nn_nationkey,n_name,tags\n"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")))).alias("value"), "n_nationkey")
    lines.repartition(25, "n_nationkey").select("value").write.text(folder)
    back = readers.commented_csv(spark, folder, "n_nationkey int, n_name string, tags string", ("tags",))
    return back.where("n_nationkey IS NOT NULL").select("n_nationkey", "n_name", F.array_join("tags", "|").alias("tags"))


@area.query("SELECT c_nationkey AS nation, 'Žďár ' || c_mktsegment AS place, array_to_string(list_sort(list_distinct(list(c_custkey % 10)))::VARCHAR[], '|') AS codes FROM customer GROUP BY ALL")
def src3_legacy_csv(spark, d):
    """Codes per (nation, place), through semicolon CSV in a legacy encoding."""
    folder = _folder(spark)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = table(spark, d, "customer").select("c_nationkey", F.concat(F.lit("Žďár "), "c_mktsegment").alias("place"), (F.col("c_custkey") % 10).alias("code"))
    rows.write.csv(folder, sep=";", header=True, encoding="windows-1250")
    back = readers.legacy_csv(spark, folder, "nation long, place string, code long")
    return back.groupBy("nation", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_set("code")), lambda c: c.cast("string")), "|").alias("codes"))


@area.query("SELECT name, n, hint FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, NULL AS hint FROM {t}" for t in ("part", "orders", "lineitem")) + ") UNION ALL SELECT 'absent', NULL, 'build the tables first'")
def src5_table_access(spark, d):
    """Rows of tables opened by name, and the hint that a missing one gives."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(None).cast("string").alias("hint")) for name, df in readers.require_tables(spark, d, ("part", "orders", "lineitem")).items()]
    try:
        readers.require_tables(spark, d, ("absent",))
        hint = None
    except FileNotFoundError as e:
        hint = str(e).rpartition(": ")[2]
    parts.append(spark.range(1).select(F.lit("absent").alias("name"), F.lit(None).cast("long").alias("n"), F.lit(hint).alias("hint")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@area.query("SELECT ['ok', 'size-mismatch', 'md5-mismatch', 'missing'][(row_number() OVER (ORDER BY md5(s_name || chr(10))) - 1) % 4 + 1] AS state, count(*) AS n FROM supplier GROUP BY ALL".replace("SELECT [", "SELECT state, count(*) AS n FROM (SELECT [").replace(" AS state, count(*) AS n FROM supplier GROUP BY ALL", " AS state FROM supplier) GROUP BY state"))
def src6_pinned_files(spark, d):
    """One file per supplier against a manifest of which three quarters are off, each in its own way."""
    folder = _folder(spark)
    names = table(spark, d, "supplier").select("s_name")
    # a task writes many files, and puts them in place itself instead of the driver
    spread = min(names.count(), spark.sparkContext.defaultParallelism * 4)
    names.repartition(max(1, spread)).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")  # a task without names may leave an empty file
    listed = checkpointed(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5")))
    k = S.positions(listed, "md5", hashed=True)
    off = F.col("pos") % 4
    manifest = k.select(F.when(off == 3, F.concat("name", F.lit(".gone"))).otherwise(F.col("name")).alias("name"), F.when(off == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(off == 2, "x").otherwise(F.col("md5")).alias("md5"))
    return readers.verify_pinned(spark, folder, manifest).groupBy("state").agg(F.count("*").alias("n"))


@area.query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def src4_wrapped_json(spark, d):
    """Conversations nested as one JSON document each, and exploded again."""
    folder = _folder(spark)
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns"))
    nested.write.json(folder)
    back = readers.wrapped_json(spark, folder, "conv_id long, turns array<struct<turn: long, text: string>>", "turns", multi_line=False)
    return back.select("conv_id", "turn", F.length("text").alias("n"))


@area.query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier")))
def snk1_database(spark, d):
    """Tables written in key order, refused a second time, and read back."""
    folder = _folder(spark)
    names = ("region", "nation", "supplier")
    writers.write_database({n: table(spark, d, n) for n in names}, folder)
    back = readers.require_tables(spark, folder, names)
    parts = [back[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return parts[0].union(parts[1]).union(parts[2])


@area.query("SELECT event_type, count(*) AS n, 'r1' AS run_id FROM events GROUP BY 1 UNION ALL SELECT event_type, count(*), 'r2' FROM events WHERE value > 10 GROUP BY 1")
def snk2_run_outputs(spark, d):
    folder = _folder(spark)
    e = table(spark, d, "events")
    for run, rows in (("r1", e), ("r2", e.where("value > 10"))):
        writers.write_run(rows.groupBy("event_type").agg(F.count("*").alias("n")), folder, run)
    return spark.read.schema("event_type string, n long, run_id string").json(folder)


@area.query()
def snk3_fingerprints(spark, d):
    parts = [writers.fingerprint(table(spark, d, t)).select(F.lit(t).alias("table_name"), "n", "xor_hash", "sum_hash") for t in KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
