"""Chunk-wise encoding with a word-end BPE tokenizer file of the tokenizers library.

The tokenizer lower-cases, drops white space and merges within pre-tokens only. What stands between white space (a
chunk) therefore encodes alone as it does within a text, and each distinct chunk is encoded once per worker. Texts with
anything for which this does not hold are encoded whole by the library.

Defined results: an empty text, or one of white space, has no chunks and no tokens; callers turn nulls into empty texts;
texts and chunks of any length are encoded whole; repeated chunks are encoded once.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer, normalizers, pre_tokenizers  # noqa: E402

#: Python's str.split() also splits here, the tokenizer's white space does not; and a sigma's lower case depends on its place.
_ODD = re.compile("[\x1c-\x1fΣ]")
MAX_CHUNKS = 800_000


class WordBpe:
    """The tokenizer of a file, with its text pipeline opened up into chunks and pre-tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError(f"{path} is no word-end BPE file of the kind that this operator handles")
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.vocabulary = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer, self.merger.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.to_alphabet = {b: c for c, b in _byte_alphabet().items() if b != 32}
        self.ends_word = np.zeros(max(self.vocabulary.values()) + 3, dtype=bool)
        self.ends_word[[i for t, i in self.vocabulary.items() if t.endswith(self.suffix)]] = True
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def chunks(self, text: str) -> list[str] | None:
        """The chunks of a text; None if it has to be encoded whole."""
        if _ODD.search(text) or any(s in text for s in self.specials):
            return None
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """IDs of distinct pre-tokens, one after the other, and where each begins (with the end of the last).

        Pre-tokens are normal already, so they go to a copy of the tokenizer without a text pipeline, in its byte
        alphabet and many to a text: white space separates them, and only the last token of each carries the suffix.
        """
        step = 4096
        texts = [" ".join(pieces[lo : lo + step]).encode().decode("latin-1").translate(self.to_alphabet) for lo in range(0, len(pieces), step)]
        ids = [np.array(e.ids, dtype=np.int32) for e in self.merger.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        stops = np.flatnonzero(self.ends_word[flat]) + 1
        if len(stops) != len(pieces):
            raise ValueError("a pre-token does not end with a word end")
        return flat, np.concatenate(([0], stops))

    def cut(self, chunks: list[str]) -> tuple[list[str], dict[str, list[str]]]:
        """All distinct pre-tokens of some chunks, and the pre-tokens of those chunks that are not one themselves."""
        many = {c: marked_word(c) or self.pattern.findall(c) for c in chunks if not c.isalpha()}
        return list({*(c for c in chunks if c not in many), *chain.from_iterable(many.values())}), many

    def whole_words(self) -> frozenset[str]:
        """The vocabulary strings proven to be one pre-token that encodes alone as one token."""
        byte_of = _byte_alphabet()
        words = []
        for entry in self.vocabulary:
            if entry.endswith(self.suffix):
                try:
                    word = bytes(byte_of[c] for c in entry[: -len(self.suffix)]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue
                if word and self.pattern.fullmatch(word) and self.pattern.findall(word) == [word] and word.lower() == word:
                    words.append(word)
        return frozenset(w for w, ids in zip(words, self.encode(words), strict=True) if len(ids) == 1)


def marked_word(chunk: str) -> list[str] | None:
    """Letters and the ASCII punctuation after them, which patterns of this kind cut once, in between; None for others."""
    word = chunk.rstrip(string.punctuation)
    return [word, chunk[len(word) :]] if word.isalpha() and len(word) < len(chunk) else None


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkCache(dict):
    """chunk -> value, resolved for all new chunks of a batch at once; bounded by ``MAX_CHUNKS`` between batches."""

    def __init__(self, resolve: Callable[[list[str]], Iterable]) -> None:
        super().__init__()
        self.resolve = resolve

    def learn(self, lists: Iterable[list[str]]) -> None:
        if len(self) > MAX_CHUNKS:
            self.clear()
        seen: set[str] = set()
        for chunks in lists:
            seen.update(chunks)
        new = [c for c in seen if c not in self]
        self.update(zip(new, self.resolve(new), strict=True))


def ranges(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows whose sizes come to about ``most``, at least one row."""
    lo = hi = n = 0
    for size in sizes:
        hi, n = hi + 1, n + size
        if n >= most:
            yield lo, hi
            lo, n = hi, 0
    if lo < hi:
        yield lo, hi


def slices(texts: Sequence, chars: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each, at least one row."""
    return ranges(map(len, texts), chars)
