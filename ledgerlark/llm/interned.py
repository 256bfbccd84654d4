"""Lists of numbers by string, learned once and kept by a Python worker within a bound.

The lists lie end to end in one array, so the lists of many strings are gathered at once. Any string may be a key, the empty
one too, and a list may be empty. Strings asked for twice in a call are learned once. No strings give no numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its last, end to end."""
    size = last - first
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(int(size.sum()))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words between U+0020 and U+0009 to U+000D, maybe an empty one; the number of each word of the texts; where each text's begin, and the end."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    return coded.dictionary, np.asarray(coded.indices), np.asarray(lists.offsets)


class Interned:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.length = np.zeros(1 << 12, dtype=np.int64)
        self.seen = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def bound(self, most: int) -> None:
        """Above most strings, keep those seen three times or more, none if they are over half; halve what they have been seen."""
        n = len(self.index)
        if n <= most:
            return
        stay = np.flatnonzero(self.seen[:n] > 2)
        if len(stay) > most // 2:
            stay = stay[:0]
        names = list(self.index)
        self.index = dict(zip((names[i] for i in stay.tolist()), range(len(stay)), strict=True))
        first, length = self.start[stay], self.length[stay]
        flat = self.flat[ranges(first, first + length)]
        self.flat[: len(flat)] = flat
        self.used = len(flat)
        for own, new in ((self.start, np.cumsum(length) - length), (self.length, length), (self.seen, self.seen[stay] // 2)):
            own[: len(stay)] = new
        self.seen[len(stay) :] = 0

    def codes(self, names: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The codes of strings, for gather(); learn: the lists of new ones, end to end, and how long each is."""
        codes = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            asked = [names[i] for i in missing.tolist()]
            new = list(dict.fromkeys(asked))
            self._add(new, *learn(new))
            codes[missing] = np.fromiter(map(self.index.__getitem__, asked), dtype=np.int64, count=len(asked))
        np.add.at(self.seen, codes, 1)
        return codes

    def _add(self, names: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        n = len(self.index)
        if n + len(names) > len(self.start):
            size = 2 * (n + len(names))
            self.start, self.length = np.resize(self.start, size), np.resize(self.length, size)
            self.seen = np.concatenate([self.seen, np.zeros(size - len(self.seen), dtype=np.int64)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(names)] = self.used + np.cumsum(length) - length
        self.length[n : n + len(names)] = length
        self.used += len(flat)
        self.index.update(zip(names, range(n, n + len(names)), strict=True))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists end to end, and their n + 1 offsets."""
        first, length = self.start[codes], self.length[codes]
        return self.flat[ranges(first, first + length)], np.append(0, np.cumsum(length))
