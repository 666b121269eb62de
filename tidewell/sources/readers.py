"""Sources: JSON lines, commented and legacy CSV, JSON documents, pinned files."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC1: JSON objects by line, from plain or gzip files: (rows, counts of read, parsed and dropped lines).

    Blank lines are skipped. Only lines that are no JSON go through a parser of Python literals; what neither reads is
    dropped and counted. A gzip file cannot be split, so its lines are dealt out before any parsing.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    if partitions:
        lines = lines.repartition(partitions)
    parsed = lines.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.where("row._corrupt_record IS NULL").select("row.*").drop("_corrupt_record")
    bad = parsed.where("row._corrupt_record IS NOT NULL").select("value")

    def literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for line in batch["value"]:
                try:
                    value = ast.literal_eval(line)
                except (ValueError, SyntaxError):
                    continue
                if isinstance(value, dict):
                    found.append({f.name: value.get(f.name) for f in schema.fields})
            yield pd.DataFrame(found, columns=[f.name for f in schema.fields])

    rescued = bad.mapInPandas(literals, schema)
    rows = good.unionByName(rescued)
    counts = lines.agg(F.count("*").alias("lines")).crossJoin(rows.agg(F.count("*").alias("rows"))).withColumn("dropped", F.col("lines") - F.col("rows"))  # one row each
    return rows, counts


def commented_csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """SRC2: CSV below a ``#`` header; the named columns are lists joined by ``|``."""
    df = spark.read.csv(path, schema=schema, header=True, comment="#")
    return df.withColumns({c: F.split(c, r"\|") for c in lists})


def legacy_csv(spark: SparkSession, path: str, schema: str, encoding: str = "windows-1250") -> DataFrame:
    """SRC3: semicolon CSV in a legacy encoding, for which the session is set to accept all of Java's charsets."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, schema=schema, sep=";", header=True, encoding=encoding)


def wrapped_json(spark: SparkSession, path: str, schema: str, items: str, multi_line: bool = True) -> DataFrame:
    """SRC4: a JSON document (or one per line) that lists wrappers, one row per element of the array column ``items``."""
    df = spark.read.json(path, schema=schema, multiLine=multi_line)
    return df.select(*[c for c in df.columns if c != items], F.explode_outer(items).alias("item")).select("*", "item.*").drop("item")


def require_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """SRC5: read-only access to the named tables, with a hint when one is missing."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        except AnalysisException as e:
            raise FileNotFoundError(f"table {name} is missing under {sf_dir}: build the tables first") from e
    return out


def _pinned_state(folder: str, chunk: int = 4 << 20):
    """A function over batches of manifest rows that looks each file up, sizes first."""

    def state(name: str, size: float, md5: str | None) -> str:
        scheme, _, rest = f"{folder.rstrip('/')}/{name}".partition(":")
        host, _, tail = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest)
        system, root = (fs.LocalFileSystem(), "/") if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")
        path = f"{root.rstrip('/')}/{tail.lstrip('/')}"
        found = system.get_file_info(path)
        if not found.is_file:
            return "missing"
        if found.size != size:
            return "size-mismatch"
        digest = hashlib.md5()
        with system.open_input_stream(path, compression=None) as stream:
            while part := stream.read(chunk):
                digest.update(part)
        return "ok" if digest.hexdigest() == md5 else "md5-mismatch"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = ["missing" if n is None else state(n, s, m) for n, s, m in zip(batch["name"], batch["size"], batch["md5"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "state": pd.Series(states, dtype=object)})

    return run


def verify_pinned(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """SRC6: state of each file of a manifest (name, size, md5): ok, missing, size-mismatch or md5-mismatch.

    The folder is on a shared path or in a store that Arrow can open. Sizes come first; only files of the right size are
    read, by chunks of a few MB, so that a file may be of any size. Each row of the manifest has its state: a null name is
    missing, a null size or digest matches no file, an empty file is a file, and an empty manifest gives no rows.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # a row per file is little data and much work, so the files are dealt out before any is read
    dealt = manifest.select("name", "size", "md5").repartition(spark.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(_pinned_state(whole), "name string, state string")
