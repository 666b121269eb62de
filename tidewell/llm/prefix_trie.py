"""Conversation prefix trie by ROLLUP over blocks of turn columns.

Conversations are sequences of turns (role, text). Each distinct sequence of the first d turns is a node of depth d; the
root is the empty sequence. The trie is never walked: a conversation is cut into blocks of ``BLOCK`` turns, a block is
one row with the turns' IDs in positional columns and the identity of the node that the block continues, and one ROLLUP
over those columns, grouped by block and node, aggregates all prefixes of all blocks at once. ``grouping_id`` tells a
column that is rolled up from one past a conversation's end. A conversation of any length is some rows more.

* A turn's ID is 128 bits of SHA-256 over role and text, with the text's length behind them.
* The node before a block is known from two sums, of 60 hashed bits each, over the conversation's earlier blocks; each
  conversation ends with a block that holds an empty column, so that the node at a block's edge has all its members.
* Places in a conversation, and these sums, are running sums in two levels (per slab of consecutive turn numbers or
  blocks, then within a slab), so that a conversation of any length is not one task's.
* A node is identified by its smallest member and its depth, so nodes with the same smallest member form a chain down
  the trie. What a subtree holds is what hangs from chains of its members: a second ROLLUP sums the totals of chains
  over all prefixes, and a running sum along the node's own chain takes off what lies above the node.
* The members that end at a node are first sorted into runs of at most ``RUN`` identifiers by aggregation; one stream
  over the sorted runs then feeds the hash, so that no list of all members is ever built.

Counts and sums combine before every shuffle; joins are equi-joins of thin rows that adaptive execution can split.

Defined results: turns are ordered by turn number (null first), repeated numbers by the turn's ID; repeated rows are turns
of their own; null role and null text are empty; rows without a conversation have no place and are left out; other
columns are not read; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import checkpointed

BLOCK = 8
SLAB = 1024
RUN = 256
_T = [f"t{k}" for k in range(1, BLOCK + 1)]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _hex(*parts: Column) -> Column:
    """128 bits of SHA-256 over the parts, in hex; a null part is told from an empty one."""
    marked = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat(*marked).cast("binary"), 256), 1, 32)


def _length(turn: Column) -> Column:
    """Code points of a turn's text, from its ID."""
    return F.substring(turn, 33, 20).cast("long")


def _with_sums_before(rows: DataFrame, key: str, slab: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over the rows of the same key that come before, in two levels.

    ``slab`` does not decrease in ``order``; no window holds more than the rows of a slab, or a row for each slab of a key.
    """
    rows = rows.withColumns({"_slab": slab, **{f"_v_{n}": c for n, c in sums.items()}})
    slabs = rows.groupBy(key, "_slab").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    over = Window.partitionBy(key).orderBy(F.col("_slab").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slabs.select(F.col(key).alias("_key"), F.col("_slab").alias("_of"), *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(key, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"_w_{n}": F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in sums})
    joined = placed.join(offsets, (F.col(key) == F.col("_key")) & F.col("_slab").eqNullSafe(F.col("_of")))
    done = joined.withColumns({n: F.col(f"_o_{n}") + F.col(f"_w_{n}") for n in sums})
    return done.drop("_slab", "_key", "_of", *[f"_{x}_{n}" for n in sums for x in "vow"])


def turns_in_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, t``: the ID of each turn and its place in its conversation, from 0."""
    text, role = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col)]
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("no"),
        F.concat(_hex(role, text), F.char_length(text).cast("string")).alias("t"),
    )
    order = [F.col("no").asc_nulls_first(), F.col("t")]
    return _with_sums_before(rows, "conv", F.floor(F.col("no") / SLAB), order, {"pos": F.lit(1).cast("long")}).drop("no")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with shared openings: turns ``conv, pos, t``, and ``conv, n`` for all conversations.

    Conversation c takes its first h turns from conversation c - c % ``every`` (fewer if that has fewer, none if there is
    none) and goes on with its own turns after the first h; h is the CRC-32 of c in decimal, modulo ``most``. An opening
    is asked for by fewer than twice ``every`` conversations.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    base = F.col("conv") - F.col("conv") % every
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), F.col("pos"), "t")
    lengths = sizes.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_n"))
    taken = sizes.withColumn("base", base).join(lengths, "base", "left").withColumn("head", F.least(h("conv"), F.coalesce("base_n", F.lit(0).cast("long"))))
    taken = checkpointed(taken.select("conv", "base", "head", (F.col("head") + F.greatest(F.col("own") - h("conv"), F.lit(0))).alias("n")))
    opening = taken.join(heads, "base").where(F.col("pos") < F.col("head")).select("conv", "pos", "t")
    rest = turns.where(F.col("pos") >= h("conv")).join(taken.select("conv", "head"), "conv")
    rest = rest.select("conv", (F.col("pos") - h("conv") + F.col("head")).alias("pos"), "t")
    return opening.unionByName(rest), taken.select("conv", "n")


def _identity(*turns: Column) -> Column:
    return _hex(F.col("block").cast("string"), F.col("k1").cast("string"), F.col("k2").cast("string"), *turns)


def _step(name: str) -> Column:
    """What a full block adds to the first or the second sum: 60 bits of a hash over its place and turns."""
    digest = F.sha2(F.concat(F.col("block").cast("string"), *[x for t in _T for x in (F.lit("|"), F.coalesce(F.col(t), F.lit("")))]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 if name == "k1" else 33, 15), 16, 10).cast("decimal(20,0)")


def _blocks(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``conv, block, k1, k2, t1 .. t8``: floor(n / 8) + 1 rows for each conversation of n turns."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    # a row without turns stands for the end of a conversation at a block's edge
    ends = sizes.where(F.col("n") % BLOCK == 0).select("conv", F.floor(F.col("n") / BLOCK).cast("long").alias("block"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("t"))
    cells = turns.select("conv", block.alias("block"), (F.col("pos") % BLOCK).cast("int").alias("at"), "t").unionByName(ends)
    rows = cells.groupBy("conv", "block").agg(*[F.max(F.when(F.col("at") == k, F.col("t"))).alias(t) for k, t in enumerate(_T)])
    return _with_sums_before(rows, "conv", F.floor(F.col("block") / SLAB), [F.col("block")], {"k1": _step("k1"), "k2": _step("k2")}).select(
        "conv", "block", F.col("k1").cast("decimal(38,0)").alias("k1"), F.col("k2").cast("decimal(38,0)").alias("k2"), *_T
    )


def _rolled_up(blocks: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: ``node, parent, depth, last`` and the measures.

    The level of a prefix is the number of its turn columns that are not rolled up. Level 0 repeats the node before a
    block and is kept for the root alone; a full block is the node that the next block continues, and bears its identity.
    """
    turns = ", ".join(_T)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {turns}, {BLOCK} - bit_count(grouping_id()) AS level, {measures} FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({turns})", blocks=blocks
    )
    level, last = F.col("level"), F.element_at(F.array(*_T), F.greatest(F.col("level"), F.lit(1)))
    prefixes = rolled.withColumn("last", last).where(F.when(level == 0, F.col("block") == 0).otherwise(F.col("last").isNotNull()))
    edge = _hex((F.col("block") + 1).cast("string"), *[(F.col(k) + _step(k)).cast("decimal(38,0)").cast("string") for k in ("k1", "k2")], *[F.lit(None).cast("string")] * BLOCK)
    above = _identity(*[F.when(level > k, F.col(t)) for k, t in enumerate(_T, 1)])
    return prefixes.withColumns(
        {
            "node": F.when(level == BLOCK, edge).otherwise(_identity(*map(F.col, _T))),
            "parent": F.when(level > 0, above),
            "depth": F.col("block") * BLOCK + level,
            "last": F.when(level > 0, F.col("last")),
        }
    ).drop("block", "k1", "k2", "level", *_T)


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's sorted runs of identifiers, joined by commas, in one pass over the sorted rows."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["end_node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["end_node", "ends_sha256"])


def _end_hashes(blocks: DataFrame) -> DataFrame:
    """``end_node, ends_sha256`` of the nodes at which conversations end: those whose last block is not full."""
    ends = blocks.where(F.col(_T[-1]).isNull()).select(_identity(*map(F.col, _T)).alias("node"), "conv")
    runs = ends.groupBy("node", F.floor(F.col("conv") / RUN).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(_hashed_runs, "end_node string, ends_sha256 string")


def trie_of(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie of ordered turns (``conv, pos, t``) of the conversations ``conv, n``; see ``prefix_trie`` for the columns."""
    blocks = checkpointed(_blocks(turns, sizes))
    nodes = checkpointed(_rolled_up(blocks, "count(*) AS n_convs, min(conv) AS conv_id"))
    kids = nodes.groupBy("parent").agg(F.count("*").alias("kids")).where("parent IS NOT NULL").withColumnRenamed("parent", "of")
    parents = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    own = (F.col("n_convs") - 1) * F.coalesce(_length(F.col("last")), F.lit(0))
    linked = nodes.join(kids, F.col("node") == F.col("of"), "left").join(parents, F.col("parent") == F.col("above"), "left")
    linked = checkpointed(linked.select("node", "parent", "depth", "last", "conv_id", "parent_conv_id", "n_convs", F.coalesce("kids", F.lit(0)).alias("n_children"), own.alias("own")))

    chains = linked.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    hung = blocks.join(chains, F.col("conv") == F.col("conv_id")).drop("conv_id")
    below = _rolled_up(hung, "sum(saved) AS saved, sum(leaves) AS n_leaves").select(F.col("node").alias("top"), "saved", "n_leaves")
    placed = _with_sums_before(linked, "conv_id", F.floor(F.col("depth") / SLAB), [F.col("depth")], {"passed": F.col("own")})
    whole = placed.join(below, F.col("node") == F.col("top")).join(_end_hashes(blocks), F.col("node") == F.col("end_node"), "left")
    return whole.select(
        "node",
        "parent",
        F.substring("last", 1, 32).alias("turn_id"),
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("saved") - F.col("passed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = False) -> DataFrame:
    """A row for each node of the trie of ``conversations``, a row of which is a turn.

    ``node, parent`` (identities; the root's parent is null), ``turn_id`` (of the last turn), ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs`` (members), ``n_children, n_leaves`` (childless nodes of the subtree, which
    includes its top), ``saved_tokens`` (over the subtree: code points of a node's last text, for each member but one) and
    ``ends_sha256`` (SHA-256 of the identifiers of the members that end here, ascending, joined by commas).
    ``shared_heads`` rebuilds conversations with shared openings first.
    """
    turns = checkpointed(turns_in_order(conversations, conv_col, turn_col, role_col, text_col))
    if shared_heads:
        return trie_of(*with_shared_heads(turns))
    return trie_of(turns, turns.groupBy("conv").agg(F.count("*").alias("n")))
