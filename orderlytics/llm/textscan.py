"""Words of many texts at once: 64-bit hashes and byte positions, computed with
numpy over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a
polynomial over a random value per byte, read off one running sum for all words
of a block, then mixed. Hashes depend on the bytes alone, so they agree between
tasks, runs and tables.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at once; a longer text is one block of its own.
BLOCK = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 5)
_STEP = U(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    lo: int             # first text of the block in the column
    hash: np.ndarray    # uint64 per word
    start: np.ndarray   # byte position within its text
    end: np.ndarray
    first: np.ndarray   # index of each text's first word; one more entry at the end
    data: np.ndarray    # the bytes of the block's texts, one after the other
    at: np.ndarray      # where each text begins in them; one more entry at the end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and two
    share a machine's memory with their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Scanner:
    def __init__(self, lower: bool = False, punctuation: bool = False):
        """``lower``: A-Z count as a-z; ``punctuation``: ASCII bytes that are neither
        letters nor digits separate words too."""
        self.value = mix(np.arange(1, 257, dtype=U) * _STEP)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        if punctuation:
            self.space[[b for b in range(128) if not chr(b).isalnum()]] = True
        self.power = self.inverse = np.ones(1, dtype=U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            back = pow(int(_BASE), -1, 1 << 64)
            self.power = np.cumprod(np.r_[U(1), np.full(n, _BASE)], dtype=U)
            self.inverse = np.cumprod(np.r_[U(1), np.full(n, U(back))], dtype=U)

    def blocks(self, column: pa.Array) -> Iterator[Words]:
        """The words of every text (NULL counts as empty), block by block."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
            yield self._scan(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            lo = hi
        release()

    def _scan(self, lo: int, data: np.ndarray, at: np.ndarray) -> Words:
        n = len(data)
        if not n:
            return Words(lo, np.zeros(0, U), *(np.zeros(0, np.int64),) * 2, np.zeros(len(at), np.int64), data, at)
        self._powers(n)
        word = ~self.space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.r_[False, word[:-1]] & ~edge[:-1]
        after = np.r_[word[1:], False] & ~edge[1:]
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(self.value[data] * self.power[:n], out=total[1:])
        first = np.searchsorted(start, at)
        shift = np.repeat(at[:-1], np.diff(first))
        return Words(lo, mix((total[end] - total[start]) * self.inverse[start]), start - shift, end - shift, first, data, at)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of the block, hash) of every run of ``k`` words, in order; a text of
    fewer words has one, of all its words; a text without words has none."""
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    runs = max(0, len(text) - k + 1)
    rolled = np.zeros(runs, dtype=U)
    for j in range(k):
        rolled = rolled * _STEP + words.hash[j:j + runs]
    whole = text[:runs] == text[k - 1:] if runs else np.zeros(0, bool)
    of, out = text[:runs][whole], mix(rolled[whole])
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            rolled = np.full(len(short), U(size))
            for j in range(size):
                rolled = rolled * _STEP + words.hash[words.first[short] + j]
            of, out = np.r_[of, short], np.r_[out, mix(rolled)]
    return of, out


def previous(words: Words) -> np.ndarray:
    """The hash of the word before each word; 0 before the first of a text."""
    before = np.empty_like(words.hash)
    before[1:] = words.hash[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = 0
    return before


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + b)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [first[i], first[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in ``sorted_keys``, or their number where it is missing."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, len(sorted_keys))


class Tally:
    """Counts by 64-bit key, merged whenever ``limit`` entries are waiting, so that
    a task holds few more than its distinct keys. ``extra`` columns go with the key."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.waiting, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: list[np.ndarray], extra: tuple[np.ndarray, ...] = ()) -> None:
        self.waiting.append((keys, counts, extra))
        self.size += len(keys)
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def merge(self):
        if self.waiting:
            keys = np.concatenate([w[0] for w in self.waiting])
            counts = [np.concatenate(c) for c in zip(*(w[1] for w in self.waiting))]
            extra = [np.concatenate(c) for c in zip(*(w[2] for w in self.waiting))]
            keys, at, group = np.unique(keys, return_index=True, return_inverse=True)
            counts = [np.bincount(group, c, len(keys)).astype(np.int64) for c in counts]
            self.waiting, self.size = [(keys, counts, tuple(e[at] for e in extra))], len(keys)
            return self.waiting[0]
        return None
