"""Sources and sinks on files written here."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import types as T

from tidewell.sources import readers, writers

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_json_lines_with_literals_and_garbage(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "name": "a"}\n\n{\'id\': 2, \'name\': None}\nnonsense\n')
    rows, counts = readers.json_lines(spark, f"file://{tmp_path}", SCHEMA)
    assert sorted(r["id"] for r in rows.collect()) == [1, 2]
    assert counts.first()["dropped"] == 1


def test_commented_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# source: somewhere\nid,tags\n1,a|b\n")
    assert readers.commented_csv(spark, f"file://{tmp_path}/x.csv", "id int, tags string", ("tags",)).first()["tags"] == ["a", "b"]


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("kod;nazev\n1;Žďár\n".encode("cp1250"))
    assert readers.legacy_csv(spark, f"file://{tmp_path}/x.csv", "kod int, nazev string").first()["nazev"] == "Žďár"


def test_wrapped_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"user": "u", "items": [{"a": 1}, {"a": 2}]}]')
    got = readers.wrapped_json(spark, f"file://{tmp_path}/x.json", "user string, items array<struct<a: int>>", "items")
    assert sorted((r["user"], r["a"]) for r in got.collect()) == [("u", 1), ("u", 2)]


def test_pinned_files(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("abc")
    (tmp_path / "size.txt").write_text("abcd")
    (tmp_path / "sum.txt").write_text("abd")
    md5 = hashlib.md5(b"abc").hexdigest()
    manifest = spark.createDataFrame([(n, 3, md5) for n in ("ok.txt", "size.txt", "sum.txt", "gone.txt")], "name string, size long, md5 string")
    got = {r["name"]: r["state"] for r in readers.verify_pinned(spark, f"file://{tmp_path}", manifest).collect()}
    assert got == {"ok.txt": "ok", "size.txt": "size-mismatch", "sum.txt": "md5-mismatch", "gone.txt": "missing"}


def test_pinned_files_of_several_chunks_and_odd_names(spark, tmp_path):
    big = bytes(range(256)) * 40_000
    contents = {"big.bin": big, "a b%20c.gz": b"not packed", "empty": b"", "ž.txt": "ž".encode()}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = [(n, len(c), hashlib.md5(c).hexdigest()) for n, c in contents.items()]
    rows += [("big.bin", len(big), hashlib.md5(big[:-1]).hexdigest()), ("big.bin", 1, "x"), ("empty", None, "x"), ("gone", None, None), (None, 1, "x")]
    manifest = spark.createDataFrame(rows, "name string, size long, md5 string")
    got = sorted((r["name"] or "-", r["state"]) for r in readers.verify_pinned(spark, f"file://{tmp_path}", manifest).collect())
    odd = [("big.bin", "md5-mismatch"), ("big.bin", "size-mismatch"), ("empty", "size-mismatch"), ("gone", "missing"), ("-", "missing")]
    assert got == sorted([(n, "ok") for n in contents] + odd)
    assert readers.verify_pinned(spark, f"file://{tmp_path}", manifest.limit(0)).count() == 0


def test_database_is_not_overwritten_unasked(spark, tmp_path):
    df = spark.range(3)
    writers.write_database({"t": df}, f"file://{tmp_path}/db")
    with pytest.raises(Exception, match="exist"):
        writers.write_database({"t": df}, f"file://{tmp_path}/db")
    writers.write_database({"t": spark.range(5)}, f"file://{tmp_path}/db", force=True)
    assert readers.require_tables(spark, f"file://{tmp_path}/db", ("t",))["t"].count() == 5
    with pytest.raises(FileNotFoundError):
        readers.require_tables(spark, f"file://{tmp_path}/db", ("u",))


def test_fingerprint_ignores_order(spark):
    df = spark.range(100)
    assert writers.fingerprint(df).first() == writers.fingerprint(df.orderBy(df["id"].desc())).first()
    assert writers.fingerprint(df).first() != writers.fingerprint(spark.range(1, 101)).first()
