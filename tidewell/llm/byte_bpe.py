"""Byte-level BPE encoding and decoding by DuckDB queries within each partition.

Encoding. A text is cut into pre-tokens by the vocabulary's pattern; each distinct pre-token is encoded once per worker
process, within a cache of bounded size. Its bytes become token-position rows that meet the merge table in a recursive
query: every round contracts each word's leftmost pair of the lowest rank, until no row joins. Words of over ``SHORT``
bytes go through a second query, a round of which contracts in many places at once wherever that is proven to give the
same tokens, so that a long word does not need a round for each of its merges:

* The merge table also holds the pairs that no merge joins but some merge spans: one whose left part ends with the left
  token and whose right part begins with the right one. Between two tokens that are in neither way in the table no merge
  can ever happen. Such boundaries cut a word into segments, and each segment contracts its own lowest pair.
* Within a segment all occurrences of that pair are contracted, every second one where they overlap, up to and with the
  first one whose new neighbours, or two new tokens side by side, form a pair of a lower rank still.

Rows carry the next position, the next token, their segment and the rank of their pair, so that a round looks up only
the pairs that it has just made, and rows of finished segments leave the recursion. A word of 100,000 random letters
takes some 16 rounds.

Decoding. The token IDs of the documents become rows, join the vocabulary and are put together by an ordered aggregation
per document. Bytes travel as Latin-1 characters, one for each byte.

Everything is per partition: no shuffle, no files. The memory of a worker process is bounded by ``SLICE``
characters of text or one text, a cache of about ``cache_bytes`` (``CACHE_BYTES`` unless given) that lasts from task to task, and some 100 bytes for each
byte of the rows of one query (``ROWS`` or one pre-token).

Defined results: a null text is empty and has no tokens; a column of the same name as a result is replaced; an empty
table gives an empty result; texts and words of any length are encoded whole; rows that repeat are rows of the result;
unknown IDs raise an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.word_bpe import marked_word, ranges, slices

SLICE = 2_000_000
DECODE_SLICE = 100_000
CACHE_BYTES = 120_000_000
ENTRY_BYTES = 200
ROWS = 300_000
SHORT = 64
_NONE = 2_147_483_647
_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, Decoder] = {}

#: x, y: this and the next position; t, n: this and the next token (-1 at a boundary); s: first position of the segment;
#: rk: rank of the pair (t, n). A row is done once its segment has no pair left.
MERGE = f"""
WITH RECURSIVE b(x, y, t, n, s, rk, done) AS (
  SELECT x, x + 1, t, n, s, rk, false FROM word_bytes
  UNION ALL
  (WITH lowest AS (SELECT s, min((rk::BIGINT << 32) + x) AS m FROM b WHERE NOT done GROUP BY s),
        live AS (SELECT x, y, t, n, b.s, rk, m & 4294967295 AS hx, (m >> 32)::INT AS r FROM b JOIN lowest USING (s) WHERE NOT done),
        hit AS (SELECT s, x AS hx, y AS hy FROM live WHERE x = hx AND r < {_NONE}),
        pair AS (SELECT h.s, h.hx, h.hy, live.y AS y2, live.n AS n2 FROM live JOIN hit h ON live.x = h.hy),
        -- the left row becomes the new token, the row before it gets a new neighbour, the right row goes
        edit AS (SELECT x, CASE WHEN x = p.hx THEN y2 ELSE y END AS y, CASE WHEN x = p.hx THEN r ELSE t END AS t,
                        CASE WHEN x = p.hx THEN n2 WHEN y = p.hx AND n >= 0 THEN r ELSE n END AS n, live.s, rk, r = {_NONE} AS done, x = p.hx OR y = p.hx AS changed
                 FROM live LEFT JOIN pair p ON p.s = live.s WHERE p.hy IS NULL OR x <> p.hy)
   SELECT x, y, t, n, s, rk, done FROM edit WHERE changed IS NOT TRUE
   UNION ALL
   SELECT x, y, t, n, s, coalesce(m.rk, {_NONE}), done FROM merges m RIGHT JOIN (SELECT * FROM edit WHERE changed) e ON m.lr = e.t::BIGINT * 65536 + e.n))
SELECT x, t FROM b WHERE done ORDER BY x
"""

MERGE_LONG = f"""
WITH RECURSIVE b(x, y, t, n, s, rk, done) AS (
  SELECT x, x + 1, t, n, s, rk, false FROM word_bytes
  UNION ALL
  (WITH lowest AS (SELECT s, min(rk) AS r FROM b WHERE NOT done GROUP BY s),
        live AS (SELECT x, y, t, n, b.s, rk, r FROM b JOIN lowest USING (s) WHERE NOT done),
        hit AS (SELECT x, y, s, r FROM live WHERE rk = r AND r < {_NONE}),
        -- of occurrences that overlap, every second one
        linked AS (SELECT *, row_number() OVER o AS i, lag(y) OVER o IS DISTINCT FROM x AS fresh FROM hit WINDOW o AS (ORDER BY x)),
        run AS (SELECT *, i - max(CASE WHEN fresh THEN i END) OVER (ORDER BY i) AS nth FROM linked),
        pair AS (SELECT h.x, h.y AS q, h.s, h.r, live.y AS y2, live.n AS n2 FROM live JOIN (SELECT * FROM run WHERE nth % 2 = 0) h ON live.x = h.y),
        before AS (SELECT live.x, live.y, live.t, pair.s, pair.r FROM live JOIN pair ON live.y = pair.x WHERE live.n >= 0),
        -- of several occurrences in a segment, those up to the first that makes a lower pair
        several AS (SELECT s FROM pair GROUP BY s HAVING count(*) > 1),
        made AS (SELECT s, x, r, unnest([r::BIGINT * 65536 + r, r::BIGINT * 65536 + n2]) AS lr FROM pair SEMI JOIN several USING (s)
                 UNION ALL SELECT s, y, r, t::BIGINT * 65536 + r FROM before SEMI JOIN several USING (s)),
        stop AS (SELECT s, min(x) AS last FROM made JOIN pairs m USING (lr) WHERE m.rk < made.r GROUP BY s),
        take AS (SELECT p.x, q, p.s, r, y2, n2 FROM pair p LEFT JOIN stop USING (s) WHERE p.x <= coalesce(last, p.x)),
        -- the left row becomes the new token, the row before it gets a new neighbour, the right row goes
        edit AS (
          SELECT p.x, p.s, p.y2 AS y, p.r AS t, coalesce(f.r, p.n2) AS n FROM take p LEFT JOIN take f ON f.x = p.y2 AND p.n2 >= 0
          UNION ALL SELECT v.x, v.s, v.y, v.t, p.r FROM before v JOIN take p ON p.x = v.y ANTI JOIN take g ON g.q = v.x
          UNION ALL SELECT q, s, NULL, NULL, NULL FROM take),
        ranked AS (SELECT e.x, e.s, e.y, e.t, CASE WHEN m.lr IS NULL THEN -1 ELSE e.n END AS n, m.lr IS NULL AND e.n >= 0 AS cut, coalesce(m.rk, {_NONE}) AS rk
                   FROM edit e LEFT JOIN pairs m ON m.lr = e.t::BIGINT * 65536 + e.n),
        parted AS (SELECT DISTINCT s, true AS parts FROM ranked WHERE cut),
        after AS (SELECT live.x, live.s, r = {_NONE} AS done, cut, parts, CASE WHEN e.x IS NULL THEN live.y ELSE e.y END AS y, CASE WHEN e.x IS NULL THEN live.t ELSE e.t END AS t,
                         CASE WHEN e.x IS NULL THEN live.n ELSE e.n END AS n, CASE WHEN e.x IS NULL THEN live.rk ELSE e.rk END AS rk
                  FROM live LEFT JOIN ranked e ON e.x = live.x LEFT JOIN parted ON parted.s = live.s)
   SELECT x, y, t, n, s, rk, done FROM after WHERE t IS NOT NULL AND parts IS NULL
   UNION ALL
   SELECT x, y, t, n, greatest(s, max(CASE WHEN cut THEN y END) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), rk, done
   FROM after WHERE t IS NOT NULL AND parts))
SELECT x, t FROM b WHERE done ORDER BY x
"""

DECODE = """
SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


class _Coder:
    """The ranks of a file and a DuckDB connection of one thread; one of each kind per worker process."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("token IDs are packed into 16 bits")
        # no folder to spill to; joins in the order of their text, as the small side always comes second
        self.db = duckdb.connect(config={"memory_limit": "1GB", "threads": 1, "temp_directory": ""})
        self.db.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")

    def _store(self, name: str, rows: pa.Table) -> None:
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def _run(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)


def _spanned_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (left * 65536 + right) that a merge joins or spans, and the rank of the merge that joins them."""
    split: list[tuple[int, int, int]] = []
    tails: list[list[int]] = [[] for _ in range(1 << 16)]
    heads: list[list[int]] = [[] for _ in range(1 << 16)]
    for token, t in ranks.items():
        tails[t].append(t)
        heads[t].append(t)
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None:
                heads[t].append(left)
            if right is not None:
                tails[t].append(right)
                if left is not None:
                    split.append((left, right, t))
    a, b, made = np.array(split, dtype=np.int64).T

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists])
        return np.array([y for x in lists for y in x], dtype=np.int64), np.cumsum(sizes) - sizes, sizes

    (tail, tail_at, tail_n), (head, head_at, head_n) = flat(tails), flat(heads)
    times = tail_n[a] * head_n[b]
    merge = np.repeat(np.arange(len(a)), times)
    k = np.arange(len(merge)) - np.repeat(np.cumsum(times) - times, times)
    spans = tail[tail_at[a][merge] + k // head_n[b][merge]] * 65536 + head[head_at[b][merge] + k % head_n[b][merge]]
    pairs = np.unique(spans)
    rank = np.full(len(pairs), _NONE, dtype=np.int32)
    rank[np.searchsorted(pairs, a * 65536 + b)] = made
    return pairs, rank


class Encoder(_Coder):
    """Texts to token IDs."""

    def __init__(self, vocabulary: str, pattern: str, cache_bytes: int | None = None) -> None:
        super().__init__(vocabulary)
        self.pattern = regex.compile(pattern)
        self.cache_bytes = cache_bytes or CACHE_BYTES
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs, ranks = _spanned_pairs(self.ranks)
        self._store("pairs", pa.table({"lr": pairs, "rk": ranks}))
        ids = self.byte_id.astype(np.int64)
        joined = ranks < _NONE
        self._store("merges", pa.table({"lr": pairs[joined], "rk": ranks[joined]}))
        lr = ids[:, None] * 65536 + ids
        at = np.minimum(np.searchsorted(pairs, lr), len(pairs) - 1)
        self.warm = pairs[at] == lr  # between which two bytes a merge can happen
        self.first_rank = np.where(self.warm, ranks[at], _NONE).astype(np.int32)  # the rank of two bytes side by side
        self.forget()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The token IDs, two bytes each, of byte strings that are no tokens themselves."""
        short, long = [iter(self._merged([w for w in words if (len(w) > SHORT) == k], sql)) for k, sql in enumerate((MERGE, MERGE_LONG))]
        return [next(long if len(w) > SHORT else short) for w in words]

    def _merged(self, words: list[bytes], sql: str) -> list[bytes]:
        out: list[bytes] = []
        for lo, hi in slices(words, ROWS):
            raw = np.frombuffer(b"".join(words[lo:hi]), dtype=np.uint8)
            ends = np.cumsum([len(w) for w in words[lo:hi]])
            t, x = self.byte_id[raw], np.arange(len(raw), dtype=np.int32)
            goes_on = np.append(self.warm[raw[:-1], raw[1:]], False)
            goes_on[ends - 1] = False
            n = np.where(goes_on, np.append(t[1:], -1), -1).astype(np.int32)
            s = np.maximum.accumulate(np.where(np.append(True, ~goes_on[:-1]), x, 0))
            rk = np.where(goes_on, np.append(self.first_rank[raw[:-1], raw[1:]], _NONE), _NONE).astype(np.int32)
            got = self._run("word_bytes", pa.table({"x": x, "t": t, "n": n, "s": s, "rk": rk}), sql)
            ids = got.column("t").to_numpy().astype("<u2").tobytes()
            at = (np.searchsorted(got.column("x").to_numpy(), np.append(0, ends)) * 2).tolist()
            out += [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
        return out

    def _code(self, words: list[bytes]) -> list[bytes]:
        out = [self.ranks[w].to_bytes(2, "little") if w in self.ranks else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.merge([words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def _piece(self, piece: str) -> bytes:
        return self.chunks[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.others[piece]

    def _learn(self, splits: list[list[str]], whole: list[list[str]]) -> None:
        """IDs of all new chunks, and of all new pre-tokens of texts that are cut as a whole."""
        if splits and self.held > self.cache_bytes // 2:  # what is not met again while the cache fills once more goes
            self.old_chunks, self.old_others, self.chunks, self.others, self.held = self.chunks, self.others, {}, {}, 0
        seen: set[str] = set()
        for chunks in splits:
            seen.update(chunks)
        new = self._kept({c for c in seen if c not in self.chunks}, self.chunks, self.old_chunks)
        many = {c: [f" {cut[0]}", cut[1]] if (cut := marked_word(c)) else self.pattern.findall(f" {c}") for c in new if not c.isalpha()}
        plain, others = new.difference(many), set()
        more: set[str] = set()
        for piece in set().union(*many.values(), *whole):
            if piece[0] == " " and piece[1:].isalpha():
                if piece[1:] not in self.chunks:
                    more.add(piece[1:])
            elif piece not in self.others:
                others.add(piece)
        plain |= self._kept(more, self.chunks, self.old_chunks)
        others = self._kept(others, self.others, self.old_others)
        coded = self._code([f" {c}".encode() for c in plain] + [p.encode() for p in others])
        self.chunks.update(zip(plain, coded, strict=False))
        self.others.update(zip(others, coded[len(plain) :], strict=True))
        self.held += sum(map(len, coded)) + 2 * (sum(map(len, new)) + sum(map(len, others))) + ENTRY_BYTES * (len(coded) + len(many))
        for c, pieces in many.items():
            # white space at a chunk's edge can belong to a run that goes on in the next chunk
            self.chunks[c] = None if not c or c[0].isspace() or c[-1].isspace() else b"".join(map(self._piece, pieces))

    def _kept(self, new: set[str], to: dict, old: dict) -> set[str]:
        """Moves what the older half of the cache has of ``new``; the rest."""
        found = {c: old[c] for c in new if c in old} if old else {}
        to.update(found)
        self.held += sum(ENTRY_BYTES + 2 * len(c) for c in found)
        return new.difference(found) if found else new

    def forget(self) -> None:
        """Empties the cache. It is filled again from the texts at hand."""
        self.old_chunks: dict[str, bytes | None] = {}
        self.old_others: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}  # what stands between two spaces, encoded with the space before it
        self.others: dict[str, bytes] = {}  # pre-tokens that are no letters after a space
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token IDs of each text.

        A lone space between two other characters that are no white space always begins a pre-token, so texts are cut
        there first; a text with white space next to such a space is cut by the pattern as a whole.
        """
        splits = [t.split(" ") for t in texts]
        heads = [self.pattern.findall(s[0]) for s in splits]
        self._learn([s[1:] for s in splits], heads)
        out = []
        for text, split, head in zip(texts, splits, heads, strict=True):
            try:
                if len(split) > 1 and split[0][-1:].isspace():
                    raise TypeError
                ids = b"".join(map(self._piece, head)) + b"".join(map(self.chunks.__getitem__, split[1:]))
            except TypeError:
                pieces = self.pattern.findall(text)
                self._learn([], [pieces])
                ids = b"".join(map(self._piece, pieces))
            out.append(np.frombuffer(ids, dtype="<u2").astype(np.int32))
        return out


class Decoder(_Coder):
    """Token IDs to bytes."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__(vocabulary)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self._store("vocabulary", pa.table({"id": np.array([i for _, i in tokens], dtype=np.int32), "piece": [b.decode("latin-1") for b, _ in tokens]}))
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[[i for _, i in tokens]] = True
        del self.ranks  # the table has them

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of token IDs."""
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= 1 << 16 or not self.known[flat].all()):
            raise ValueError("a token ID is not in the vocabulary")
        rows = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        got = self._run("ids", rows, DECODE)
        out = [b""] * len(ids)
        for doc, text in zip(got.column("doc").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[doc] = text.encode("latin-1")
        return out


def encoder(vocabulary: str, pattern: str, cache_bytes: int | None = None) -> Encoder:
    if (vocabulary, pattern) not in _encoders:
        _encoders[vocabulary, pattern] = Encoder(vocabulary, pattern)
    coder = _encoders[vocabulary, pattern]
    coder.cache_bytes = cache_bytes or CACHE_BYTES
    return coder


def decoder(vocabulary: str) -> Decoder:
    if vocabulary not in _decoders:
        _decoders[vocabulary] = Decoder(vocabulary)
    return _decoders[vocabulary]


def _append(df: DataFrame, columns: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns made batch-wise from ``make(batch) -> iterator of (lo, hi, arrays)``."""
    kept = [f for f in df.schema.fields if f.name not in columns]
    names = [*[f.name for f in kept], *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, made in make(batch):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *made], names)

    return df.mapInArrow(run, T.StructType([*kept, *[T.StructField(c, kind) for c, kind in columns.items()]]))


def _encoded(batch: pa.RecordBatch, vocabulary: str, pattern: str, text_col: str, cache_bytes: int | None) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    column = batch.column(text_col)
    for lo, hi in ranges(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), SLICE):
        yield lo, hi, encoder(vocabulary, pattern, cache_bytes).encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _decoded(ids: list[np.ndarray], vocabulary: str) -> list[bytes]:
    return [b for lo, hi in slices(ids, DECODE_SLICE) for b in decoder(vocabulary).decode(ids[lo:hi])]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", to: str = "ids", cache_bytes: int | None = None) -> DataFrame:
    """``docs`` with the token IDs of ``text_col`` in the array column ``to``."""

    def make(batch: pa.RecordBatch):
        for lo, hi, ids in _encoded(batch, vocabulary, pattern, text_col, cache_bytes):
            yield lo, hi, [_id_lists(ids)]

    return _append(docs, {to: T.ArrayType(T.IntegerType())}, make)


def decode_documents(docs: DataFrame, vocabulary: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the token IDs of ``ids_col`` in the binary column ``to``; null IDs give no bytes."""

    def make(batch: pa.RecordBatch):
        column = batch.column(ids_col)
        ids = [np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in column]
        for lo, hi in slices(ids, DECODE_SLICE):
            yield lo, hi, [pa.array(decoder(vocabulary).decode(ids[lo:hi]), pa.binary())]

    return _append(docs, {to: T.BinaryType()}, make)


def round_trip_documents(
    docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", to: str = "ids", decoded: str = "decoded", cache_bytes: int | None = None
) -> DataFrame:
    """``docs`` with token IDs and the bytes decoded from them, by one worker process per task instead of two."""

    def make(batch: pa.RecordBatch):
        for lo, hi, ids in _encoded(batch, vocabulary, pattern, text_col, cache_bytes):
            yield lo, hi, [_id_lists(ids), pa.array(_decoded(ids, vocabulary), pa.binary())]

    return _append(docs, {to: T.ArrayType(T.IntegerType()), decoded: T.BinaryType()}, make)
