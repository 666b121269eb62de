"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of distinct documents are linked at ``max_bits`` or fewer differing bits; groups are the components of the
links.

Index. The top level has four masks of 16 bits: two fingerprints with at most three differing bits agree on all bits of
at least one mask, so a fingerprint joins the four nodes whose masked pattern it shares, and nodes are dealt out over the
tasks by a shuffle of 64-bit fingerprints. Within a node, fingerprints are sorted by Gray rank, so that neighbours share
most bits. Groups of ``FAN`` neighbours factor the bits they all share into a parent (pattern and mask), parents again,
up to the node. A search carries the number of differing bits accumulated on the way down, counts at each level only the
bits that were not counted above, and drops a whole group once the count exceeds ``max_bits``.

Scale and skew. Equal fingerprints meet in a map-side combined aggregation first, so copies never reach the index. A
node with more than ``HOT_NODE`` distinct fingerprints is split by the same argument once more: its other 48 bits are
cut into four parts, one of which must be equal; results are the same on both sides of that size. A task emits a star per local group, at most one link per fingerprint
and node, never all pairs. Components are found by distributed large-star / small-star rounds, cut by checkpoints.

Defined results: a null or wordless text has fingerprint zero, which links like any other; null identifiers count after
all others in the choice of the smallest; rows that repeat are rows of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import connected_components
from tidewell.session import checkpointed

SEED = 42
FAN = 8
HOT_NODE = 4096
FLUSH_ROWS = 200_000
FRONTIER = 2_000_000
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text over its word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() and bytes.split() are ASCII only
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(parts), 1 << 15):
        some = parts[lo : lo + (1 << 15)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), dtype="<u8", count=len(some))
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(parts)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series(np.array([fingerprint(t) for t in series], dtype=np.uint64).view(np.int64))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray code: the prefix parity of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fp: np.ndarray, node: np.ndarray) -> list[dict[str, np.ndarray]]:
    """From the rows (sorted by node and Gray rank) up to one root per node: pattern, mask, first child and child count."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [{"pat": fp, "mask": np.full(len(fp), full), "node": node}]
    while len(levels[-1]["node"]) > 1 and (levels[-1]["node"][1:] == levels[-1]["node"][:-1]).any() or len(levels) == 1:
        low = levels[-1]
        starts = np.flatnonzero(np.r_[True, low["node"][1:] != low["node"][:-1]])
        place = np.arange(len(low["node"])) - np.repeat(starts, np.diff(np.r_[starts, len(low["node"])]))
        first = np.flatnonzero(place % FAN == 0)
        ones = np.bitwise_and.reduceat(low["pat"] | ~low["mask"], first) & np.bitwise_and.reduceat(low["mask"], first)
        zeros = np.bitwise_and.reduceat(~low["pat"] | ~low["mask"], first) & np.bitwise_and.reduceat(low["mask"], first)
        levels.append({"pat": ones, "mask": ones | zeros, "node": low["node"][first], "first": first, "n": np.diff(np.r_[first, len(low["node"])])})
    return levels


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of each pair in ``label``, which maps a row to the first row of its group."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def linked_groups(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, first fingerprint of its local group) among the fingerprints of each node."""
    order = np.lexsort((gray_rank(fp), node))
    fp, node = fp[order], node[order]
    levels = _levels(fp, node)
    root_of = np.searchsorted(levels[-1]["node"], node)
    label = np.arange(len(fp))

    def search(lo: int, hi: int) -> None:
        q = np.arange(lo, hi)
        at = root_of[lo:hi]
        top = levels[-1]
        acc = np.bitwise_count((fp[q] ^ top["pat"][at]) & top["mask"][at])
        for depth in range(len(levels) - 1, 0, -1):
            up, low = levels[depth], levels[depth - 1]
            n = up["n"][at]
            if n.sum() > FRONTIER and hi - lo > 1:
                search(lo, (lo + hi) // 2)
                search((lo + hi) // 2, hi)
                return
            which = np.repeat(np.arange(len(at)), n)
            child = up["first"][at][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            rest = low["mask"][child] & ~up["mask"][at][which]
            total = acc[which] + np.bitwise_count((fp[q[which]] ^ low["pat"][child]) & rest)
            near = total <= max_bits
            q, at, acc = q[which[near]], child[near], total[near]
        later = at > q
        _unite(label, q[later], at[later])

    step = 1 << 16
    for lo in range(0, len(fp), step):
        search(lo, min(len(fp), lo + step))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _links_of(max_bits: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = linked_groups(fps.view(np.uint64), nodes, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        nodes, fps, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], FLUSH_ROWS
        for batch in batches:  # sorted by node: only the last node of what was read may go on
            nodes.append(batch.column("node").to_numpy())
            fps.append(batch.column("fp").to_numpy())
            if sum(map(len, nodes)) >= full:
                n, f = np.concatenate(nodes), np.concatenate(fps)
                cut = np.searchsorted(n, n[-1])
                if cut:
                    yield star(n[:cut], f[:cut])
                nodes, fps = [n[cut:]], [f[cut:]]
                full = max(FLUSH_ROWS, 2 * len(n[cut:]))  # a node that goes on is put together a few times only
        n, f = np.concatenate(nodes), np.concatenate(fps)
        if len(n):
            yield star(n, f)

    return links


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def near_links(distinct: DataFrame, max_bits: int = 3, hot_node: int = HOT_NODE) -> DataFrame:
    """Links (a, b) that connect what is within ``max_bits`` of each other, from a column ``fp`` of distinct values."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the four top masks are exact up to 3 differing bits")
    fp = F.col("fp")
    rest = lambda k: _block(fp, (k + 1) % 4) + F.shiftleft(_block(fp, (k + 2) % 4), 16) + F.shiftleft(_block(fp, (k + 3) % 4), 32)
    level1 = distinct.select(
        "fp", F.explode(F.array(*[F.struct((_block(fp, k) + F.lit(k << 16)).alias("node"), rest(k).alias("rest")) for k in range(4)])).alias("x")
    ).select("fp", "x.node", "x.rest")
    hot = level1.groupBy("node").count().where(F.col("count") > hot_node).select("node", F.lit(True).alias("hot"))
    marked = level1.join(hot, "node", "left")
    part = lambda j: F.shiftrightunsigned("rest", 12 * j).bitwiseAND(F.lit(0xFFF).cast("long"))
    finer = F.array(*[F.col("node") + F.lit((j + 1) << 20) + F.shiftleft(part(j), 24) for j in range(4)])
    dealt = marked.select("fp", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("node"))).alias("node"))
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_links_of(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, fingerprint, component_id``."""
    prints = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col).cast("string")).alias("fp")))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")))
    groups = connected_components(near_links(distinct.select("fp"), max_bits))
    linked = distinct.join(groups, distinct["fp"] == groups["vertex"]).select("fp", "smallest", "component")
    least = linked.groupBy("component").agg(F.min("smallest").alias("least"))
    # a fingerprint of one document without a link decides for itself: only copies and linked ones go into the last join,
    # whose sides are then plain shuffles that Spark can split where a fingerprint has very many documents
    copies = distinct.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("smallest").alias("least"))
    shared = checkpointed(linked.join(least, "component").select("fp", "least").unionByName(copies).withColumn("found", F.lit(True)))
    component = F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id"))
    return prints.join(shared, "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose document stays: of each group the one with the smallest identifier.

    Rows that share an identifier are one document, which stays if any of its rows does.
    """
    judged = checkpointed(
        simhash_groups(docs, id_col, text_col, max_bits).groupBy(F.col("doc_id").alias("_judged_id")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_stays"))
    )
    gone = judged.where("NOT _stays").select("_judged_id")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_judged_id"]), "left_anti")
