"""Token IDs as Arrow files of equal-length sequences.

``write_token_files`` range-partitions documents by identifier, sorts each partition, encodes it and streams the IDs into
one Arrow IPC file per partition. A record batch has two fixed-size-list columns, of sequences of equal ``length`` (a
multiple of 8): ``ids`` (uint16 or uint32, by the size of the vocabulary) and ``mask`` (bytes of eight positions, the
first in the lowest bit; a bit is 1 where a position holds a token; only the last sequence of a file is padded). Sequence
k of a file is item k modulo batch size of batch k div batch size, so a memory-mapped file gives any sequence and its
mask as views, without a copy. A second file beside it lists identifier and number of tokens of its documents.

``read_token_files`` gives documents back from the files alone. Files go to a folder that all executors share, by
pyarrow's file systems. Every attempt of a task writes files of its own names, and the manifest names those of the
attempt that Spark took: it is the commit record, nothing is renamed, and retried, speculative or lost tasks cannot
damage each other. A failed attempt removes its files; ``remove_leftovers`` removes those of lost executors. A task holds
one batch of sequences and one batch of texts at a time.

Defined results: a null text is empty and consists of its end token; null identifiers come first; rows that repeat an
identifier follow each other in the order of a hash of the text, which also splits an identifier that many rows share;
other columns are not read; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.text import null_as_empty
from tidewell.llm.word_bpe import ChunkCache, WordBpe, slices
from tidewell.session import checkpointed, ensure_checkpoint_dir

LENGTH = 2048
BATCH = 128
_encoders: dict[str, tuple[WordBpe, ChunkCache]] = {}


def _file_system(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _encoder(vocabulary: str, dtype: str) -> tuple[WordBpe, ChunkCache]:
    """The tokenizer and its cache chunk -> bytes of IDs, one per worker process."""
    if vocabulary not in _encoders:
        bpe = WordBpe(vocabulary)

        def resolve(chunks: list[str]) -> list[bytes]:
            pieces, many = bpe.cut(chunks)
            flat, bounds = bpe.encode_pieces(pieces)
            raw, at = flat.astype(dtype).tobytes(), (bounds * np.dtype(dtype).itemsize).tolist()
            ids = {p: raw[a:b] for p, a, b in zip(pieces, at, at[1:], strict=False)}
            return [b"".join(map(ids.__getitem__, many[c])) if c in many else ids[c] for c in chunks]

        _encoders[vocabulary] = bpe, ChunkCache(resolve)
    return _encoders[vocabulary]


class SequenceWriter:
    """Packs documents into fixed-size-list batches of one Arrow file."""

    def __init__(self, sink, dtype: str, length: int) -> None:
        if length % 8:
            raise ValueError("the length of sequences is a multiple of 8")
        self.length, self.dtype = length, np.dtype(dtype)
        kinds = [("ids", pa.from_numpy_dtype(self.dtype), length), ("mask", pa.uint8(), length // 8)]
        self.schema = pa.schema([(n, pa.list_(pa.field("item", k, nullable=False), items)) for n, k, items in kinds], {"length": str(length), "batch": str(BATCH)})
        self.file = pa.ipc.new_file(sink, self.schema)
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.ids.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        if self.held >= self.length * BATCH:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids, size, at = np.frombuffer(b"".join(self.ids), dtype=self.dtype), self.length * BATCH, 0
        while self.held - at >= size or last and at < self.held:
            part = ids[at : at + size]
            padded = np.pad(part, (0, -len(part) % self.length))
            columns = [padded, np.packbits(np.arange(len(padded)) < len(part), bitorder="little")]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(columns, self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            at += len(part)
        self.ids, self.held = [ids[at:].tobytes()], self.held - at

    def close(self) -> None:
        self._flush(last=True)
        self.file.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes the files into ``folder`` and returns their manifest: ``part, file, n_docs, n_tokens``, in ``part`` order."""
    size = WordBpe(vocabulary).tokenizer.get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype=dtype).tobytes()

    def encoded(texts: list[str]) -> Iterator[bytes]:
        bpe, cache = _encoder(vocabulary, dtype)
        for lo, hi in slices(texts):
            split = [bpe.chunks(t) for t in texts[lo:hi]]
            cache.learn(s for s in split if s is not None)
            for s, t in zip(split, texts[lo:hi], strict=True):
                yield np.array([*bpe.encode([t])[0], end_id], dtype=dtype).tobytes() if s is None else b"".join([*map(cache.__getitem__, s), end])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, top = _file_system(folder)
        fs.create_dir(top, recursive=True)
        paths = [f"{top}/{name}.{kind}.arrow" for kind in ("tokens", "docs")]
        n_docs = n_tokens = 0
        try:
            with fs.open_output_stream(paths[0]) as tokens, fs.open_output_stream(paths[1]) as docs_of:
                writer, index = SequenceWriter(tokens, dtype, length), pa.ipc.new_file(docs_of, INDEX)
                for batch in chain([first], batches):
                    counts = []
                    for ids in encoded(batch.column(1).to_pylist()):
                        writer.add(ids)
                        counts.append(len(ids) // len(end))
                    index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], schema=INDEX))
                    n_docs, n_tokens = n_docs + len(counts), n_tokens + sum(counts)
                writer.close()
                index.close()
        except BaseException:
            for path in paths:
                if fs.get_file_info(path).type != FileType.NotFound:
                    fs.delete_file(path)
            raise
        row = [pa.array([part], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())]
        yield pa.RecordBatch.from_arrays(row, ["part", "file", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), null_as_empty(F.col(text_col)).alias("text"))
    n = max(1, rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return checkpointed(dealt.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"))


def documents_of(tokens: pa.ipc.RecordBatchFileReader, sizes: Iterator[int]) -> Iterator[np.ndarray]:
    """The token IDs of the documents of a file, in order, by their numbers of tokens; pads are left out by the mask."""
    k, held = 0, np.zeros(0, np.uint16)
    for size in sizes:
        parts = [held[:size]]
        held, missing = held[size:], size - len(parts[0])
        while missing:
            batch = tokens.get_batch(k)
            ids, mask = (batch.column(i).values.to_numpy() for i in range(2))  # views into the file's buffers
            held, k = ids if mask[-1] == 255 else ids[: np.bitwise_count(mask).sum(dtype=np.int64)], k + 1
            parts.append(held[:missing])
            held, missing = held[missing:], missing - len(parts[-1])
        yield parts[0] if len(parts) == 1 else np.concatenate([p for p in parts if len(p)])
    if len(held) or k < tokens.num_record_batches:
        raise ValueError("a token file holds more tokens than its documents")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the tokens of all documents before it."""
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # one row per file
    files = manifest.select("file", before.cast("long").alias("offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}.tokens.arrow") as f, fs.open_input_file(f"{top}/{name}.docs.arrow") as g:
                    index = pa.ipc.open_file(g)
                    listed = [index.get_batch(k) for k in range(index.num_record_batches)]
                    found = documents_of(pa.ipc.open_file(f), (n for x in listed for n in x.column(1).to_pylist()))
                    for x in listed:
                        docs = list(islice(found, x.num_rows))
                        n, crc = np.array([len(d) for d in docs], np.int64), np.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(starts), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    if next(found, None) is not None:
                        raise ValueError(f"{name} holds more documents than its index")

    n = max(1, manifest.rdd.getNumPartitions())
    return files.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def remove_leftovers(manifest: DataFrame, folder: str) -> int:
    """Removes the files of attempts that the manifest (one row per file) does not name, and says how many."""
    fs, top = _file_system(folder)
    named = {r["file"] for r in manifest.select("file").collect()}
    left = [f.path for f in fs.get_file_info(FileSelector(top, allow_not_found=True)) if f.base_name.split(".")[0] not in named]
    for path in left:
        fs.delete_file(path)
    return len(left)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"


def remove_folder(folder: str) -> None:
    fs, top = _file_system(folder)
    fs.delete_dir(top)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` to a shared folder, reads them back, keeps what was read and removes the files."""
    folder = new_folder(docs.sparkSession)
    manifest = write_token_files(docs, folder, vocabulary, id_col, text_col)
    result = checkpointed(read_token_files(manifest, folder))
    if not manifest.isEmpty():
        remove_folder(folder)
    return result
