"""Packing: bounded-space online best fit of documents into sequences of equal length.

Each partition is packed as it is read, with at most ``windows`` open windows. A document that fits into open windows
goes whole into the one it fills best. What is longer than a window first fills windows of its own. When none fits and
all windows are open, the fullest is filled up with the beginning of the document and emitted, and the rest is placed
like a document of its own: a gap costs one cut and no padding.

What a partition leaves open, at most ``windows`` windows, goes on with its token IDs to a next round, in which a task
packs the leftovers of ``FAN_IN`` partitions in the same way, until one task has the leftovers of ``FAN_IN`` at most.
There the open windows are filled from each other, and what remains of less than a window is cut at powers of two, which
need no padding. No round sees more than windows times ``FAN_IN`` windows a task, however large the input.

Texts are read once and do not travel. The rows of a round are a table in the cluster's shared folder, so a lost
executor costs the tasks it ran. A task holds its open windows, one slice of texts and one batch of pieces.

Defined results: a null text is empty and consists of its end token; identifiers that repeat or are null are documents
of their own; texts of any length are packed whole; the order within a partition is that of the rows, so equal
partitions give equal sequences; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import null_as_empty
from tidewell.llm.token_files import _encoder
from tidewell.llm.word_bpe import slices
from tidewell.session import ensure_checkpoint_dir

LENGTH = 2048
WINDOWS = 64
FAN_IN = 8
ROWS = 2000
DTYPE = np.dtype("<u4")
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, round int, part long"
_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("round", pa.int32()), ("part", pa.int64())]
)
#: doc_id, start, doc_tokens, IDs as bytes
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Open windows of one task; full ones are handed out by ``add`` and ``close``."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS) -> None:
        self.length, self.windows = length, windows
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int]] = []  # (free tokens, window) in order
        self.opened = 0

    def _put(self, window: int, gap: int, piece: Piece) -> list[Piece] | None:
        """Adds a piece to a window that is not in ``gaps``; the window if that makes it full."""
        pieces = self.open.setdefault(window, [])
        pieces.append(piece)
        gap -= len(piece[3]) // DTYPE.itemsize
        if gap == 0:
            return self.open.pop(window)
        insort(self.gaps, (gap, window))
        return None

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece; yields the windows that it fills."""
        key, start, total, ids = piece
        whole, width = self.length * DTYPE.itemsize, DTYPE.itemsize
        for at in range(0, len(ids) - whole + 1, whole):
            yield [(key, start + at // width, total, ids[at : at + whole])]
        done = len(ids) - len(ids) % whole
        ids, start = ids[done:], start + done // width
        while ids:
            at = bisect_left(self.gaps, (len(ids) // width, -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
            elif len(self.open) < self.windows:
                self.opened += 1
                gap, window = self.length, self.opened
            else:
                gap, window = self.gaps.pop(0)
            full = self._put(window, gap, (key, start, total, ids[: gap * width]))
            if full:
                yield full
            ids, start = ids[gap * width :], start + gap

    def left(self) -> Iterator[list[Piece]]:
        """The windows that are still open."""
        yield from self.open.values()

    def close(self) -> Iterator[list[Piece]]:
        """Fills the open windows from each other; less than a window is left, and cut at powers of two."""
        pieces = [p for _, window in sorted(self.gaps) for p in self.open[window]]
        rest, width = sum(len(p[3]) for p in pieces) // DTYPE.itemsize, DTYPE.itemsize
        sequence: list[Piece] = []
        gap = size = min(self.length, 1 << rest.bit_length() - 1) if rest else 0
        for key, start, total, ids in pieces:
            while ids:
                part, ids = ids[: gap * width], ids[gap * width :]
                sequence.append((key, start, total, part))
                n = len(part) // width
                start, gap = start + n, gap - n
                if not gap:
                    yield sequence
                    rest -= size
                    sequence, gap = [], min(self.length, 1 << rest.bit_length() - 1) if rest else 0
                    size = gap


def _rows(found: Iterable[tuple[int | None, list[Piece]]], round_no: int, part: int) -> Iterator[pa.RecordBatch]:
    """Batches of the pieces of sequences (number, pieces); those of open windows have no number and bear their IDs alone."""
    rows: list[tuple] = []
    for number, pieces in found:
        offset = 0
        for key, start, total, ids in pieces:
            n = len(ids) // DTYPE.itemsize
            rows.append((key, start, n, total, number, None if number is None else offset, ids, round_no, part))
            offset += n
        if len(rows) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _packed(pieces: Iterable[Piece], round_no: int, part: int, last: bool, length: int, windows: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(length, windows)

    def numbered() -> Iterator[tuple[int | None, list[Piece]]]:
        number = (round_no << 56) + (part << 32)  # 2^32 sequences of a part, 2^24 parts of a round
        for piece in pieces:
            for window in packer.add(piece):
                yield number, window
                number += 1
        for window in packer.close() if last else packer.left():
            yield number if last else None, window
            number += 1

    return _rows(numbered(), round_no, part)


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH, windows: int = WINDOWS
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``start`` counts the document's tokens before the piece, ``offset`` the sequence's; ``ids`` are the piece's token IDs
    as little-endian unsigned 32-bit integers, the end token among them. ``length`` is a power of two.
    """
    if length & length - 1 or windows < 1:
        raise ValueError("sequences have a power of two of tokens, and at least one window is open")
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    end = np.array([end_id], DTYPE).tobytes()

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[Piece]:
        bpe, cache = _encoder(vocabulary, DTYPE.str)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                split = [bpe.chunks(t) for t in texts[lo:hi]]
                cache.learn(s for s in split if s is not None)
                for key, s, t in zip(keys[lo:hi], split, texts[lo:hi], strict=True):
                    ids = np.array([*bpe.encode([t])[0], end_id], DTYPE).tobytes() if s is None else b"".join([*map(cache.__getitem__, s), end])
                    yield key, 0, len(ids) // DTYPE.itemsize, ids

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(encoded(batches), 0, TaskContext.get().partitionId(), False, length, windows)

    def further_round(round_no: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = chain.from_iterable(zip(*[b.column(k).to_pylist() for k in range(5)], strict=True) for b in batches)
            for group, pieces in groupby(rows, key=lambda r: r[0]):
                yield from _packed((r[1:] for r in pieces), round_no, group, last, length, windows)

        return run

    def kept(packed: DataFrame, round_no: int) -> DataFrame:
        packed.write.parquet(f"{folder}/{round_no}")
        return spark.read.schema(packed.schema).parquet(f"{folder}/{round_no}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), null_as_empty(F.col(text_col)).alias("text"))
    table, round_no, emitted = kept(rows.mapInArrow(first_round, PIECES), 0), 0, []
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        emitted.append(table.where("sequence_id IS NOT NULL"))
        if round_no and parts == 1:
            return reduce(DataFrame.unionByName, emitted).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
        parts, round_no = -(-parts // FAN_IN), round_no + 1
        left = table.where("sequence_id IS NULL").withColumn("group", F.floor(F.col("part") / FAN_IN))
        # a group is one task's, and the part of that number in the next round
        dealt = left.repartition(parts, "group").sortWithinPartitions("group", "part", "doc_id", "start", F.crc32("ids"))
        table = kept(dealt.select("group", "doc_id", "start", "doc_tokens", "ids").mapInArrow(further_round(round_no, parts == 1), PIECES), round_no)
