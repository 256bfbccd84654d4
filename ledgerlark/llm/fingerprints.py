"""Document fingerprints from prefix polynomial hashes.

Code point c at position i adds (c + 1) * base**i modulo a prime to the prefix hash, for two primes. The
hash of any span is a difference of two prefix hashes; spans at different positions compare after
multiplication by a power of the base. A fingerprint holds the prefix hashes at anchors and at the end of the text. An
anchor is where the hash of the WINDOW code points before it, taken from the prefix array, is a multiple of a power of
two, the least that is LEAST or more and gives about CELLS anchors at most. Anchors depend on what stands there, not on where,
so an insertion changes one cell and moves the others, and the anchors of a coarser fingerprint are among those of a finer one.

Likeness is the share of the longer text in common runs of cells: equal cells are found by their hash, wherever they are,
and a run's longest common extension by binary search over span equality.

Null texts are empty. Null doc_ids come last in descending order. Rows that repeat a doc_id follow each
other by text. A table of one row is its own neighbour. Empty tables give empty tables; extra
columns don't matter. Very long texts are hashed whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import textscan as S
from ledgerlark.llm.common import map_arrow, text_of

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CELLS, LEAST, WINDOW = 96, 8, 8
#: Level of the end of a text, which is in every fingerprint.
_END = 255
_LOWEST = -(1 << 63)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    def run(base: int, prime: int) -> np.ndarray:
        x = np.ones(n, dtype=np.uint64)
        have, step = 1, base
        while have < n:  # x[have:2 * have] = x[:have] * base**have
            more = min(have, n - have)
            x[have : have + more] = x[:more] * np.uint64(step) % np.uint64(prime)
            have, step = 2 * have, step * step % prime
        return x

    return tuple((run(base, prime), run(pow(base, -1, prime), prime)) for base, prime in zip(BASES, PRIMES, strict=True))


def powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For each prime, the first n or more powers of the base and of its inverse."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def prefix_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For each prime, the prefix hashes at 0 to len(points)."""
    out = []
    for (power, _), q in zip(powers(len(points) + 1), PRIMES, strict=True):
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points + np.uint64(1)) * power[: len(points)] % np.uint64(q), out=total[1:])
        out.append(total % np.uint64(q))
    return out


class Prefix:
    """Prefix hashes of a text at every position."""

    def __init__(self, text: str) -> None:
        self.n = len(text)
        self.sums = prefix_hashes(code_points(text))

    def same(self, i: int, other: Prefix, j: int, n: int) -> bool:
        """Whether n code points from i equal the other's from j."""
        if n < 0 or i + n > self.n or j + n > other.n:
            return False
        shift = powers(max(self.n, other.n) + 1)
        for a, b, (p, _), q in zip(self.sums, other.sums, shift, PRIMES, strict=True):
            x, y = (int(a[i + n]) - int(a[i])) % q, (int(b[j + n]) - int(b[j])) % q
            if x * int(p[max(0, j - i)]) % q != y * int(p[max(0, i - j)]) % q:
                return False
        return True

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """How many code points from i on equal the other's from j on, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low


def level_of(n: int) -> int:
    """The power of two that anchors' hashes are multiples of."""
    return max(LEAST.bit_length() - 1, math.ceil(math.log2(n / CELLS)) if n > CELLS else 0)


def _moved(high: np.ndarray, low: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hashes of spans as if they began at 0, from prefix hashes at their ends."""
    inverse, q = powers(int(start.max(initial=0)) + 1)[k][1], np.uint64(PRIMES[k])
    return (high + q - low) % q * inverse[start] % q


@dataclass
class Print:
    """n: code points of the text; at: the anchors and n; sums: the prefix hashes there; level: how many times two divides an anchor's hash."""

    n: int
    at: np.ndarray
    sums: np.ndarray
    level: np.ndarray

    def coarse(self, level: int) -> Print:
        own = self.level >= level
        return Print(self.n, self.at[own], self.sums[:, own], self.level[own])

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the cells begin, with the end of the last, and their hashes, free of the place."""
        edge = np.append(0, self.at)
        sums = np.concatenate([np.zeros((2, 1), dtype=np.uint64), self.sums], axis=1)
        a, b = (_moved(sums[k, 1:], sums[k, :-1], edge[:-1], k) for k in range(2))
        return edge, a << np.uint64(32) | b

    def span(self, i: int, j: int, k: int) -> int:
        """The hash of cells i to j - 1 times the base to where they begin."""
        low = int(self.sums[k, i - 1]) if i else 0
        return (int(self.sums[k, j - 1]) - low) % PRIMES[k]


def made(text: str | None) -> Print:
    points = code_points(text or "")
    n = len(points)
    sums = prefix_hashes(points)
    at, level = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    if n > WINDOW:
        window = S.mix(_moved(sums[0][WINDOW:-1], sums[0][: n - WINDOW], np.arange(n - WINDOW), 0))
        at = np.flatnonzero(window & np.uint64((1 << level_of(n)) - 1) == 0)
        low = window[at] & (~window[at] + np.uint64(1))
        at, level = at + WINDOW, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.uint8)
    if n:
        at, level = np.append(at, n), np.append(level, np.uint8(_END))
    return Print(n, at, np.stack([x[at] for x in sums]), level)


def written(p: Print) -> str:
    """The length in hexadecimal, and anchors, levels and prefix hashes as little-endian numbers in base64."""
    parts = p.at.astype("<u4"), p.level, p.sums[0].astype("<u4"), p.sums[1].astype("<u4")
    return f"{p.n:x}." + base64.b64encode(b"".join(x.tobytes() for x in parts)).decode()


def parsed(fingerprint: str) -> Print:
    n, _, rest = fingerprint.partition(".")
    raw = base64.b64decode(rest)
    k = len(raw) // 13
    at, a, b = (np.frombuffer(raw, dtype="<u4", count=k, offset=x).astype(kind) for x, kind in ((0, np.int64), (5 * k, np.uint64), (9 * k, np.uint64)))
    return Print(int(n, 16), at, np.stack([a, b]), np.frombuffer(raw, dtype=np.uint8, count=k, offset=4 * k))


def fingerprint(text: str | None) -> str:
    return written(made(text))


def _same_run(x: Print, i: int, u: np.ndarray, y: Print, j: int, v: np.ndarray, n: int) -> bool:
    """Whether n cells of x from i and of y from j hold the same; u, v: where cells begin."""
    if u[i + n] - u[i] != v[j + n] - v[j]:
        return False
    far = powers(max(int(u[i]), int(v[j])) + 1)
    return all(x.span(i, i + n, k) * int(far[k][0][v[j]]) % PRIMES[k] == y.span(j, j + n, k) * int(far[k][0][u[i]]) % PRIMES[k] for k in range(2))


def likeness(a: Print, b: Print) -> float:
    """Code points in common runs of cells, each cell in one run, as a share of the longer text."""
    if not a.n or not b.n:
        return 1.0 if a.n == b.n else 0.0
    if a.n == b.n and (a.sums[:, -1] == b.sums[:, -1]).all():
        return 1.0
    if (a.n, *a.sums[:, -1].tolist()) > (b.n, *b.sums[:, -1].tolist()):
        a, b = b, a  # the same either way
    level = max(level_of(a.n), level_of(b.n))
    x, y = a.coarse(level), b.coarse(level)
    (u, p), (v, q) = x.cells(), y.cells()
    places: dict[int, list[int]] = {}
    for j in np.flatnonzero(np.isin(q, p)).tolist()[::-1]:
        places.setdefault(int(q[j]), []).append(j)
    taken = np.zeros(len(q) + 1, dtype=bool)
    taken[-1] = True
    i = common = 0
    while places and i < len(p):
        free = places.get(int(p[i]), [])
        while free and taken[free[-1]]:
            free.pop()
        n = 0
        if free:
            j = free.pop()
            n, high = 1, min(len(p) - i, int(np.argmax(taken[j:])))
            while n < high:
                mid = (n + high + 1) // 2
                n, high = (mid, high) if _same_run(x, i, u, y, j, v, mid) else (n, mid - 1)
            taken[j : j + n] = True
            common += int(u[i + n] - u[i])
        i += max(1, n)
    return common / max(a.n, b.n)


def _in_order(docs: DataFrame) -> DataFrame:
    """Runs of documents in descending order, a run for each partition, with the first of the next run behind each."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"))
    runs = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top")).collect()
    tops = sorted(r.top for r in runs)
    if not tops:
        return rows.select("doc_id", "text", "key", F.lit(0).alias("run"), F.lit(False).alias("guest")).limit(0)
    step = max(1, math.isqrt(len(tops)))
    every, coarse = (F.array(*(F.lit(t) for t in x)) for x in (tops, tops[step - 1 :: step]))
    full = F.size(F.filter(coarse, lambda t: t < F.col("key"))) * step
    run = full + F.size(F.filter(F.slice(every, full + 1, F.lit(step)), lambda t: t < F.col("key")))
    own = rows.withColumn("run", run.cast("int")).withColumn("guest", F.lit(False))
    at = F.create_map(*(F.lit(x) for k, t in enumerate(tops) for x in (t, (k + 1) % len(tops))))
    guests = rows.where(F.col("key").isin(tops)).select("doc_id", "text", "key", at[F.col("key")].alias("run"), F.lit(True).alias("guest"))
    both = own.unionByName(guests).repartitionById(len(tops), "run")
    return both.sortWithinPartitions("guest", F.col("key").desc(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int | None, text: str, own: Print, following: str, theirs: Print) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        new = made(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(new), likeness(own, new), likeness(own, theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ended = False
        for b in batches:
            out = []
            for doc_id, text, guest in zip(b.column(0), b.column(1), b.column(2), strict=True):
                if ended:
                    continue
                text, ended = text.as_py(), guest.as_py()
                own = made(text)
                if held:
                    out.append(row(*held, text, own))
                held = doc_id.as_py(), text, own
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(_in_order(docs).select("doc_id", "text", "guest"), run, schema)
