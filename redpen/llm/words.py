"""Words of whole texts as 64-bit hashes, and tables that look many of them up at once."""

from __future__ import annotations

from itertools import chain

import numpy as np

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def byte_words(text: str | None) -> list[bytes]:
    """Words between ASCII spaces with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_texts(texts: list[str | None], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after the other, words per text); ``end`` is added to each text."""
    tail = [] if end is None else [end]
    split = [byte_words(t) + tail for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return hashes(list(chain.from_iterable(split))), sizes


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two hashes; order matters."""
    x = (left * MIX_A) ^ (right + MIX_B)
    x = (x ^ (x >> np.uint64(32))) * MIX_B
    return x ^ (x >> np.uint64(29))


class Lookup:
    """Rows of 64-bit keys by open addressing; ``find`` gives the row of each key or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        waiting, at = np.arange(len(keys)), self._home(keys.astype(np.uint64))
        while len(waiting):
            free = self.rows[at] < 0
            self.rows[at[free]] = waiting[free]  # of several rows for a place the last stays
            lost = self.rows[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX_A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.rows[at]
        open_ = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got[open_] = self.rows[at[open_]]
            open_ = open_[(got[open_] >= 0) & (self.keys[got[open_]] != keys[open_])]
        return got


def signed(keys: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark longs."""
    return keys.view(np.int64)
