"""Whole-batch text scanning in numpy over Arrow's UTF-8 buffers.

A chunk holds whole documents laid end to end. Words are maximal runs of bytes other than U+0020
and U+0009 to U+000D. Span hashes come from prefix sums of byte * base**position modulo 2**64, so
the hash of any span takes one subtraction and one multiplication by an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one chunk; a longer document is a chunk of its own.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 1
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """data: bytes of its documents; at: their n + 1 offsets; first: number of the first in the batch."""

    data: np.ndarray
    at: np.ndarray
    first: int

    def __post_init__(self) -> None:
        n = len(self.data)
        self.n_docs = len(self.at) - 1
        space = _SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.at] = True
        before = np.ones(n + 1, dtype=bool)
        before[1:] = space
        after = np.ones(n + 1, dtype=bool)
        after[:n] = space
        self.space = space
        self.start = np.flatnonzero(~space & (before[:n] | edge[:n]))
        self.end = np.flatnonzero(~space & (after[1:] | edge[1:])) + 1
        self.word_at = np.searchsorted(self.start, self.at)
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n_docs), self.n_words)

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            power, self._inverse = powers(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
            self._prefix = total
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.prefix()
        return mix((total[end] - total[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        if not hasattr(self, "_words"):
            self._words = self.span_hash(self.start, self.end)
        return self._words

    def grams(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the n-word windows that lie in one document (of those at, if given)."""
        h = self.word_hash()
        at = np.arange(max(0, len(h) - n + 1)) if at is None else at[at <= len(h) - n]
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
        return at, mix(out + np.uint64(n))

    def code_points(self) -> np.ndarray:
        """Prefix counts of code points by byte offset."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array in each document."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def duplicates(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (doc, key): whether an equal row exists, and whether an equal row comes earlier."""
    if not len(key):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    both = mix(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    some, earlier = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    earlier[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return some, earlier


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of the width that begins at one of at."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0


def string_array(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, nulls as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Whole documents of an Arrow string column in chunks of about size bytes, in order."""
    column = string_array(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(raw[at[first] : at[last]], (at[first : last + 1] - at[first]).astype(np.int64), first)
        first = last
