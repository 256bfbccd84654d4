"""Main text of pages by a bidirectional LSTM over leaf blocks, in numpy.

A block's input is the mean of its path tokens' vectors, the mean of its words' vectors (both hashed to
rows of trained tables) and a few shares and sizes. The LSTM reads the page's blocks both ways, so every
block is judged with all others in view. Weights come from block_lstm_train and lie beside this
file; inference only needs numpy.

Null and empty pages have no text. Rows that repeat a page_id each get their row. Very long pages are read whole.
Empty tables give empty tables. Extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import map_arrow
from ledgerlark.llm.html_blocks import Block, blocks

PATHS, WORDS = 1024, 512
PATH_SIZE, WORD_SIZE, HIDDEN = 16, 12, 20
N_NUMBERS = 12
STOPS = ".,;:!?"
#: A block is main text from this probability on: a line lost costs more than one kept.
KEEP = 0.4
WEIGHTS = Path(__file__).with_name("block_lstm_weights.npz")

_rows: dict[str, int] = {}


def _row(token: str, size: int) -> int:
    if (got := _rows.get(token)) is None:
        if len(_rows) > 200_000:
            _rows.clear()
        got = _rows[token] = zlib.crc32(token.encode("utf-8", "replace"))
    return got % size


def numbers(b: Block, at: int, n: int) -> list[float]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    stops = sum(map(b.text.count, STOPS))
    return [
        min(np.log1p(size) / 7, 2.0),
        min(words / 60, 2.0),
        min(b.linked / size, 1.0),
        min(stops / words, 1.0),
        float(b.text[-1] in ".!?\"'»”"),
        float(b.text[0].isupper()),
        float("\N{COPYRIGHT SIGN}" in b.text),
        float(words <= 3),
        min(len(b.path) / 12, 2.0),
        at / max(1, n - 1),
        float(at == 0),
        min(n / 50, 2.0),
    ]


def inputs(page: Sequence[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of path tokens and of words with their offsets by block, and the numbers."""
    paths = [[_row(t, PATHS) for t in (*b.path, ">" + b.path[-1] if b.path else ">")] for b in page]
    words = [[_row(w.strip(STOPS) or w, WORDS) for w in b.text.lower().split()] for b in page]
    ends = [np.append(0, np.cumsum([len(x) for x in rows])) for rows in (paths, words)]
    flat = [np.array([r for rows in group for r in rows], dtype=np.int64) for group in (paths, words)]
    return flat[0], ends[0], flat[1], ends[1], np.array([numbers(b, i, len(page)) for i, b in enumerate(page)], dtype=np.float32).reshape(len(page), N_NUMBERS)


def mean_rows(table: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[rows], ends[:-1]) / np.diff(ends)[:, None] if len(ends) > 1 else np.zeros((0, table.shape[1]), table.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def run_lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States (steps, pages, HIDDEN) of one direction; gates in the order input, forget, output, candidate."""
    steps, n, _ = x.shape
    h = c = np.zeros((n, HIDDEN), dtype=x.dtype)
    ready = x @ w + b
    out = np.zeros((steps, n, HIDDEN), dtype=x.dtype)
    for t in range(steps):
        z = ready[t] + h @ u
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        c = f * c + i * np.tanh(z[:, 3 * HIDDEN :])
        h = o * np.tanh(c)
        out[t] = h
    return out


def reversed_pages(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps backwards, padding still behind; its own inverse."""
    step = np.arange(len(x))[:, None]
    back = np.where(step < lengths, lengths - 1 - step, step)
    return np.take_along_axis(x, back[:, :, None], axis=0)


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def vectors(p: dict[str, np.ndarray], page: Sequence[Block]) -> np.ndarray:
    path_rows, path_ends, word_rows, word_ends, nums = inputs(page)
    return np.concatenate([mean_rows(p["paths"], path_rows, path_ends), mean_rows(p["words"], word_rows, word_ends), nums], axis=1)


def label(pages: Sequence[Sequence[Block]], p: dict[str, np.ndarray] | None = None, cells: int = 1 << 14) -> list[np.ndarray]:
    """For each page the probability of each block to be main text; pages of like length go together."""
    p = weights() if p is None else p
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        n = max(1, cells // len(pages[order[-1]]))
        batch, order = order[-n:], order[:-n]
        lengths = np.array([len(pages[i]) for i in batch])
        x = np.zeros((lengths.max(), len(batch), PATH_SIZE + WORD_SIZE + N_NUMBERS), dtype=np.float32)
        for k, i in enumerate(batch):
            x[: lengths[k], k] = vectors(p, pages[i])
        ahead = run_lstm(x, p["fw"], p["fu"], p["fb"])
        behind = reversed_pages(run_lstm(reversed_pages(x, lengths), p["bw"], p["bu"], p["bb"]), lengths)
        logit = np.concatenate([ahead, behind, x], axis=2) @ p["out"] + p["bias"]
        for k, i in enumerate(batch):
            out[i] = sigmoid(logit[: lengths[k], k])
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, kept_blocks of each row."""
    names = ["page_id", "url", "text", "n_chars", "n_blocks", "kept_blocks"]
    run_size = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, run_size):
                part = b.slice(at, run_size)
                found = [blocks(x.as_py()) for x in part.column(2)]
                kept = [[x.text for x, y in zip(page, score.tolist(), strict=True) if y >= KEEP] for page, score in zip(found, label(found), strict=True)]
                texts = [" ".join(k) for k in kept]
                counts = (pa.array(list(map(len, x)), pa.int64()) for x in (texts, found, kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), *counts], names)

    schema = "page_id long, url string, text string, n_chars long, n_blocks long, kept_blocks long"
    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, schema)
