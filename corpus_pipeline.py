"""From raw documents to encoded training text: the five stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
run writes what each stage keeps as Parquet into the folder that the cluster shares, and the next stage reads it from
there: no stage is worked out twice, and a lost executor costs a reread.

Defined results: documents with a null text or one without letters, and those of an unlearned language, go in the first
stage; a null label is only left out of learning, a null source is a source of its own; of equal texts the largest
identifier stays, of near ones the smallest; rows that repeat an identifier are judged by their texts in exact dedup and
as one document in near-dedup; ties and very long texts are settled as the operators say; an empty table gives an empty
result with the columns of its stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, exact_dedup, langid, mixing, simhash
from tidewell.session import ensure_checkpoint_dir, remove_folder, table

#: Bytes of the encoder's cache in a worker process; less than its default, as the executors still hold what the stages
#: before have left in their memory.
CACHE_BYTES = 40_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects."""
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the smallest identifier stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by target weights; a document comes once for each epoch that takes any of its words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token IDs of each document, and whether decoding them gives its text again."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.round_trip_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary, pattern, cache_bytes=CACHE_BYTES)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Language ID, SimHash and BPE are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")  # the next stage's input is whole
    return docs
