"""Repetition coverage: how much of a text lies inside repeated n-grams and lines.

Nulls and texts without words have no words and fail the base rule. Very long texts are scanned
whole, a chunk each. Repeated rows each get their row. Extra columns are ignored by measure() and
kept by keep(), whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm import textscan as S
from ledgerlark.llm.common import map_arrow

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """A text is rejected above any of these shares, in hundredths.

    grams: n to the share of word characters inside n-grams that occurred before.
    lines, line_chars: shares of lines, and of word characters in lines, equal to an earlier line.
    symbols: symbols per hundred words.
    """

    min_words: int = 50
    repeat_words: int = 50
    grams: dict[int, int] = field(default_factory=lambda: {5: 30, 6: 28, 8: 25, 10: 20})
    lines: int = 30
    line_chars: int = 30
    symbols: int = 40


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", "dup_gram_chars")


def measure_chunk(c: S.Chunk, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The columns of measure() for a chunk's documents."""
    n, words = c.n_docs, len(c.start)
    points = c.code_points()
    length = points[c.end] - points[c.start]
    out: dict[str, np.ndarray] = {"n_words": c.n_words.astype(np.int64)}
    out["word_chars"] = np.bincount(c.doc, length, n).astype(np.int64)
    out["n_symbols"] = c.per_doc(SYMBOLS[c.data])
    _lines(c, points, out)
    at, key = c.grams(3)
    some, _ = S.duplicates(c.doc[at], key)
    inside = S.covered(words, at[some], 3)
    out["n_repeat_words"] = np.bincount(c.doc[inside], minlength=n).astype(np.int64)
    rejected = np.zeros(n, dtype=bool)
    starts = np.zeros(words + 1, dtype=bool)
    starts[at[some]] = True
    width = 3
    for size, share in sorted(limits.grams.items()):
        # A repeated window has only repeated shorter windows inside: the rest need no hash.
        hope = np.flatnonzero(starts[:words])
        hope = hope[hope <= words - size]
        hope = hope[starts[hope + size - width]]
        at, key = c.grams(size, hope)
        some, earlier = S.duplicates(c.doc[at], key)
        inside = S.covered(words, at[earlier], size)
        chars = np.bincount(c.doc[inside], length[inside], n).astype(np.int64)
        rejected |= 100 * chars > share * out["word_chars"]
        if size == min(limits.grams):
            out["dup_gram_chars"] = chars
        starts[:] = False
        starts[at[some]] = True
        width = size
    rejected |= 100 * out["n_dup_lines"] > limits.lines * out["n_lines"]
    rejected |= 100 * out["dup_line_chars"] > limits.line_chars * out["word_chars"]
    rejected |= 100 * out["n_symbols"] > limits.symbols * out["n_words"]
    failed = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_words * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & ~rejected}


def _lines(c: S.Chunk, points: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Lines are parts between \\n of one document; only those with a word count."""
    n = len(c.data)
    start = np.unique(np.concatenate([c.at[:-1], np.flatnonzero(c.data == 10) + 1]))
    start = start[start < n]
    following = np.append(start[1:], n)[: len(start)]
    end = following - (c.data[following - 1] == 10)
    first, last = np.searchsorted(c.start, start), np.searchsorted(c.start, end)
    start, end, first, last = (x[last > first] for x in (start, end, first, last))
    doc = np.searchsorted(c.at, start, side="right") - 1
    _, earlier = S.duplicates(doc, c.span_hash(start, end))
    total = np.zeros(len(c.start) + 1, dtype=np.int64)
    np.cumsum(points[c.end] - points[c.start], out=total[1:])
    out["n_lines"] = np.bincount(doc, minlength=c.n_docs).astype(np.int64)
    out["n_dup_lines"] = np.bincount(doc[earlier], minlength=c.n_docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(doc[earlier], (total[last] - total[first])[earlier], c.n_docs).astype(np.int64)


def _measured(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    parts = [measure_chunk(c, limits) for c in S.chunks(column)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id with COLUMNS, base_failed and kept, a row for each row of docs."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"
    names = ["doc_id", *COLUMNS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = _measured(b.column(1), limits)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k]) for k in names[1:])], names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_measured(b.column(where), limits)["kept"]))

    return map_arrow(docs, run, docs.schema)
