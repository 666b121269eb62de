"""Mixing sources to target weights by weighted fair queueing.

Sources ordered by code point (null last) get the weights 5, 2, 1, repeating. They share a budget of all words; a target
stops at ``max_epochs`` times its source's size and the excess is shared out again by weight. Documents of a source queue
in the order of an MD5 of identifier and text, epoch after epoch. The queue serves packets: a document, or ``packet``
words of a longer one. A packet's virtual finish time is the number of words of its source up to its end divided by the
source's target. All packets of all sources are range-sorted by finish time, and the line is cut where its words reach
the budget; the packet at the cut is taken in part. A source thus gets its target but for a packet, and a share of what
the other sources' last packets leave over.

Scale: a source that holds a third of all rows is never one window. Positions within a source are prefix sums in two
levels: sums per (source, first three hex digits of the hash) make a table of at most 4096 rows per source, and each of
its rows is the offset of a window over one 4096th of the source. Positions in the line are too: sums per range of finish
times, then windows within ranges. As every source is served at an even rate, ranges of equal length hold equally many
words (about ``RANGE_WORDS``) however sizes are spread. Packets that start after the line's proven end are not made. The
tables of sources (a row each) and of ranges (a row for ``RANGE_WORDS`` words) are ordered in one task.

Defined results: null text has size 0; null sources are one source; sources of size 0 have target 0; documents of size 0
make no packet and have ``taken`` 0; rows that repeat an identifier queue by their texts; an empty table gives an empty
result; columns other than identifier, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.text import free_name, word_count
from tidewell.session import checkpointed

WEIGHTS = (5, 2, 1)
PACKET = 256
RANGE_WORDS = 4_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """From rows (source, size): one row per source with ``source_size``, ``weight`` and ``target``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long"))
    # the source that reaches its limit first has the smallest ratio of limit to weight; all before it are at their limit
    order = Window.orderBy((F.col("source_size") * max_epochs / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    level = weighted.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * max_epochs).over(full), F.lit(0)).alias("limits_before"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights_from"),
        F.sum("source_size").over(Window.partitionBy()).alias("budget"),
    )
    share = (F.col("budget") - F.col("limits_before")).cast("double") / F.col("weights_from")
    capped = level.withColumn("share", share).withColumn("fits", F.col("share") * F.col("weight") <= F.col("source_size") * max_epochs)
    # the first source that stays under its limit sets the share of all after it
    common = F.first(F.when(F.col("fits"), F.col("share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return capped.withColumn("common", common).select(
        "source",
        "source_size",
        "weight",
        F.least(
            (F.col("source_size") * max_epochs).cast("double"), F.coalesce(F.col("common") * F.col("weight"), (F.col("source_size") * max_epochs).cast("double"))
        ).alias("target"),
    )


def _key(id_col: Column, text_col: Column) -> Column:
    """The place of a document in its source's shuffled order."""
    text = F.md5(F.coalesce(text_col.cast("string"), F.lit("")))
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), text))


def _placed(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """``queue`` with its source's columns and ``begin``, the words of its source queued before it."""
    slots = queue.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before_slot = F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size")
    offsets = slots.select(F.col("source").alias("o_source"), F.col("slot").alias("o_slot"), before_slot.alias("offset"))
    offsets = offsets.join(targets, offsets["o_source"].eqNullSafe(targets["source"])).drop("source")
    within = Window.partitionBy("source", "slot").orderBy("shuffled", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = queue.withColumn("within", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["o_source"]) & (placed["slot"] == offsets["o_slot"]))
    return placed.withColumn("begin", F.col("offset") + F.col("within")).drop("o_source", "o_slot", "offset", "within")


def _line(placed: DataFrame, targets: DataFrame, max_epochs: int, packet: int) -> DataFrame:
    """The packets in the line: ``row_no, epoch, finish, words, served``, where ``served`` of its ``words`` are within the budget."""
    shape = targets.agg(
        F.sum("source_size").alias("budget"), F.min(F.when((F.col("target") > 0) & (F.col("target") < F.col("source_size") * max_epochs), F.col("target"))).alias("open")
    ).first()  # one row
    budget = shape["budget"] or 0
    # by this time every source has served its target or more, in whole packets, and so all have served the budget
    end = 1.0 + 1.001 * packet / shape["open"] if shape["open"] else 1.0
    ranges = max(1, -(-budget // RANGE_WORDS))
    time = lambda words: F.try_divide(words.cast("double"), F.col("target"))
    epochs = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = epochs.withColumn("begin", F.col("begin") + F.col("epoch") * F.col("source_size")).where(time(F.col("begin")) <= end)
    n_packets = F.floor((F.col("size") + packet - 1) / packet).cast("int")
    packets = copies.withColumn("at", F.explode(F.sequence(F.lit(0), n_packets - 1))).withColumn("at", F.col("at") * F.lit(packet).cast("long"))
    words = F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at"))
    packets = packets.withColumn("words", words).withColumn("position", F.col("begin") + F.col("at") + F.col("words")).withColumn("finish", time(F.col("position")))
    packets = packets.select("row_no", "source", "epoch", "position", "words", "finish", F.floor(F.col("finish") / end * ranges).cast("long").alias("range"))
    sums = packets.groupBy("range").agg(F.sum("words").alias("range_words"))
    before = sums.select(F.col("range").alias("r"), (F.sum("range_words").over(Window.orderBy("range")) - F.col("range_words")).alias("before"))
    order = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "position").rowsBetween(Window.unboundedPreceding, 0)
    lined = packets.withColumn("until", F.sum("words").over(order)).join(before, F.col("range") == F.col("r"))
    left = F.lit(budget).cast("long") - F.col("before") - F.col("until") + F.col("words")
    return lined.select("row_no", "epoch", "finish", "words", F.greatest(F.lit(0).cast("long"), F.least("words", left)).alias("served"))


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: ``doc_id, source, size, shuffled, slot, row_no``, kept as a checkpoint."""
    return checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            _key(F.col(id_col), F.col(text_col)).alias("shuffled"),
            F.monotonically_increasing_id().alias("row_no"),
        ).withColumn("slot", F.substring("shuffled", 1, 3))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    packet: int = PACKET,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts the words that the line serves within the budget, over all epochs.
    """
    queue = _queue(docs, id_col, text_col, source_col)
    targets = checkpointed(source_targets(queue.select("source", "size"), weights, max_epochs))
    served = _line(_placed(queue, targets), targets, max_epochs, packet).where("served > 0").groupBy("row_no").agg(F.sum("served").alias("served"))
    of = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rows = queue.join(served, "row_no", "left").join(of, F.col("source").eqNullSafe(F.col("t_source")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("served", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    packet: int = PACKET,
) -> DataFrame:
    """The documents of the mix in the order of their virtual finish times, with the columns of ``docs``.

    A document comes once, whole, for each epoch that serves any of its words. Rows that repeat identifier and text come
    as often as that one of them which is served most. The line is decided on sizes alone; texts are joined to what it
    serves, and range-sorted by the finish times, so no task holds more than its range.
    """
    queue = _queue(docs, id_col, text_col, source_col)
    targets = checkpointed(source_targets(queue.select("source", "size"), weights, max_epochs))
    placed = _placed(queue, targets)
    copies = _line(placed, targets, max_epochs, packet).where("served > 0").groupBy("row_no", "epoch").agg(F.max("finish").alias("finish"))
    keyed = copies.join(queue.select("row_no", "shuffled"), "row_no").groupBy("shuffled", "epoch").agg(F.min("finish").alias("finish"))
    key, times, finish = [free_name(docs, n) for n in ("_mix_key", "_mix_times", "_mix_finish")]
    served = keyed.groupBy(F.col("shuffled").alias(key)).agg(F.collect_list("finish").alias(times))  # max_epochs of them at most
    joined = docs.join(served, _key(docs[id_col], docs[text_col]) == served[key])
    ordered = joined.withColumn(finish, F.explode(times)).orderBy(finish, key)
    return ordered.select(*[docs[c] for c in docs.columns])
