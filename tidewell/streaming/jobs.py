"""The incremental jobs: masking, customer features and session tokens as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions import identifiers as I


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, single_file: bool = False) -> DataFrame:
    """A stream over the parquet files of a folder, or over one file by its name in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if single_file else reader.parquet(path)


#: The types of the stream, in the order of masking. It blanks what has the shape, whether or not a checksum holds.
STREAMED = ("EMAIL", "IBAN_CZ", "DIC", "RC", "BBAN", "PHONE", "ICO", "PSC")


def masked_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """ST1: each text masked by type as it arrives, longer shapes first; stateless, so any sink and mode will do."""
    out = F.col(text_col)
    for kind in STREAMED:
        out = F.regexp_replace(out, I.SHAPES[kind], f"<{kind}>")
    return texts.withColumn(text_col, out)


def rfm_stream(orders: DataFrame) -> DataFrame:
    """ST2: first and last order and number of orders per user, all mergeable, in update or complete mode."""
    return orders.groupBy("user").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


VAULT = T.StructType([T.StructField("session", T.LongType()), T.StructField("entity", T.StringType()), T.StructField("token", T.StringType())])


def vault_stream(mentions: DataFrame, prefix: str = "EVENT", idle: str | None = None) -> DataFrame:
    """ST3: the same value of a session gets the same token across batches; state is one list per session and, if ``idle`` is
    given (as '1 hour'), ends after that long without rows. Input rows: session, entity, seq. Each new token is emitted once."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def assign(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        seen, new = set(known), []
        rows = pd.concat(list(batches)).sort_values("seq")
        for entity in rows["entity"]:
            if entity not in seen:
                seen.add(entity)
                known.append(entity)
                new.append((key[0], entity, f"<{prefix}_{len(known)}>"))
        state.update((known,))
        if millis:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(new, columns=["session", "entity", "token"])

    kept = T.StructType([T.StructField("known", T.ArrayType(T.StringType()))])
    return mentions.groupBy("session").applyInPandasWithState(assign, VAULT, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives what it wrote; ``complete`` results are one overwritten table."""
    spark = stream.sparkSession
    out, state = f"{folder}/out", f"{folder}/state"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        replace = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)
