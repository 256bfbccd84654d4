"""Cost-balanced packing of token ids into sequences.

A document of n tokens costs n + n * n / scale. Whole sequences of a long document stand alone. The
others of a group of documents (consecutive rows of a task, a bounded number of tokens) go, the most
costly first, each to the sequence of least cost that has room for it; one that fits nowhere is cut
to fill the sequences with most room. A group gets just as many sequences as its tokens fill, and
what is left over goes to sequences of powers of two, so nothing is padded.

Null texts are empty and have the end id alone. Rows that repeat a doc_id are documents of their
own. An empty table gives no pieces. Extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import tokens
from ledgerlark.llm.common import map_arrow


@dataclass(frozen=True)
class Pack:
    length: int = 4096
    end: int = 2
    scale: int = 4096
    group: int = 1 << 22


def place(sizes: np.ndarray, pack: Pack) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) of documents of the given sizes, sequences from 0."""
    sizes = sizes.astype(np.int64)
    whole, rest = sizes // pack.length, sizes % pack.length
    doc = np.repeat(np.arange(len(sizes)), whole)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * pack.length
    out = [list(x) for x in (doc, start, np.full(len(doc), pack.length), np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64))]
    tail = int(rest.sum() % pack.length)
    room = np.array([pack.length] * int(rest.sum() // pack.length) + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1], dtype=np.int64)
    full, cost = room.copy(), np.zeros(len(room))
    for d in np.lexsort((np.arange(len(rest)), -rest)).tolist():
        left, at = int(rest[d]), int(whole[d]) * pack.length
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[s]))
            for own, x in zip(out, (d, at, n, len(doc) + s, int(full[s] - room[s])), strict=True):
                own.append(x)
            room[s] -= n
            cost[s] += n + n * n / pack.scale
            left, at = left - n, at + n
    return tuple(np.array(x, dtype=np.int64) for x in out)


def pack_documents(docs: DataFrame, tokenizer: str, pack: Pack = Pack()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row for each piece.

    sequence_id holds the task's number in its upper and a running number in its lower 32 bits, so a
    task that runs again gives the same pieces.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, owners, count = TaskContext.get().partitionId() << 32, [], [], 0
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            size, ids, own = np.concatenate(sizes), np.concatenate(held), pa.concat_arrays(owners)
            doc, start, length, sequence, offset = place(size, pack)
            first = np.cumsum(size) - size
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((first[doc] + start).tolist(), (first[doc] + start + length).tolist(), strict=True)]
            columns = [own.take(pa.array(doc)), start, length, pa.array(crc, pa.int64()), size[doc].astype(np.int64), base + sequence, offset]
            base += int(sequence.max()) + 1
            held.clear(), owners.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

        for b in batches:
            for first, ids, at in tokens.encoded(b.column(1), tokenizer, pack.end):
                held.append(ids)
                sizes.append(np.diff(at))
                owners.append(b.column(0).slice(first, len(at) - 1))
                count += len(ids)
                if count >= pack.group:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, tokens.CACHE)
