"""The first word of MD5 for a text that ends in one of many keys, as numpy arrays over the keys.

Order by the hash of user and item is the tie rule of ranks; where a user ties with thousands of items, a call for each of
them would be most of the work.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDED = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
STEP, FEW = 16_384, 512  # keys hashed at once, so that their words stay in a core's cache, and those hashed one by one


def _first_word(words: list, n: int) -> np.ndarray:
    """The first four bytes of the digest as a number; ``words`` are the sixteen of one block, arrays or plain numbers."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't reach the first word
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((word + ADDED[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(ADDED[i])
        turn = TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    return (b + np.uint32(START[0])).byteswap()


class Keys:
    """Integer keys as the ends of texts, by the number of their digits."""

    def __init__(self, keys: np.ndarray):
        self.by_length, self.few = [], []
        texts = keys.astype("S21")
        lengths = np.char.str_len(texts)
        for size in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == size)
            for lo in range(0, len(of), STEP):
                part = of[lo : lo + STEP]
                if len(part) < FEW:
                    self.few += keys[part].tolist()
                    continue
                letters = np.frombuffer(texts[part].tobytes(), np.uint8).reshape(len(part), 21)[:, :size]
                self.by_length.append((size, keys[part], letters, {}))

    def ahead(self, prefix: bytes, known: bytes) -> int:
        """How many texts ``prefix`` + key have a digest below ``known``."""
        full, rest = divmod(len(prefix), 4)
        limit, n = int.from_bytes(known[:4], "big"), sum(hashlib.md5(prefix + b"%d" % k).digest() < known for k in self.few)
        head = np.frombuffer(prefix[: full * 4], "<u4").tolist()
        first = np.uint32(int.from_bytes(prefix[full * 4 :], "little"))
        for size, keys, letters, shifted in self.by_length:
            if rest not in shifted:
                width = -(-(rest + size + 1) // 4)
                block = np.zeros((len(keys), width * 4), np.uint8)
                block[:, rest : rest + size] = letters
                block[:, rest + size] = 0x80
                shifted[rest] = np.ascontiguousarray(block.view("<u4").T)
            tail = shifted[rest]
            words = [*head, tail[0] | first, *tail[1:]]
            words += [0] * (14 - len(words)) + [(len(prefix) + size) * 8, 0]
            found = _first_word(words, len(keys))
            n += int(np.count_nonzero(found < limit))
            for k in keys[found == limit].tolist():  # equal in the first word: the whole digest decides
                n += hashlib.md5(prefix + b"%d" % k).digest() < known
        return n
