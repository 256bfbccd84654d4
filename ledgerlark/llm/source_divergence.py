"""Divergence of sources: for each language, how far apart its sources' words are, pair by pair.

Terms are runs of ASCII letters and characters from U+0080 on, with A to Z in lower case. A language keeps the
terms of at least `least_docs` of its documents. A group is a (lang, source). With V kept terms, N of
their occurrences in a group and c of one term there, p = 1 + floor(10**9 * (c + 2) / (N + 2 V)), and
f(p, q) = floor((p - q)**2 / (p + q)). All of it is whole numbers.

Kept terms are dealt by hash into vocabulary chunks of about CHUNK terms, and a group's counts in a
chunk are packed into bytes. Groups are dealt into blocks of about BLOCK, and each vector goes to the tiles
(pairs of blocks) of its block. A tile's rows reach one task sorted by chunk, and it adds up the matrix of its
pairs one chunk at a time, so neither the vocabulary nor the number of groups bounds what a task holds.

Nulls: text, lang and source are '' where null. Empty texts have no terms; groups without terms count 0 for
every kept term. Repeated rows count each, null doc_ids too (doc_id is not read). Ties are ordered by
the item's bytes. Texts are read whole. Extra columns are ignored, whatever their names. Empty tables give
empty tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm import textscan as S
from ledgerlark.llm.common import map_arrow, staged, text_of

#: Terms of a vocabulary chunk and groups of a block, on average.
CHUNK = 4096
BLOCK = 64
#: Bytes of text counted at once; a longer document is counted alone.
SCAN = 4 << 20
UNIT = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:65] = _LOWER[91:97] = _LOWER[123:128] = 0  # what stands between terms


def term_counts(column: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of a column of texts, a part of it at a time."""
    column = S.string_array(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = min(max(int(np.searchsorted(at, at[first] + SCAN, side="right")) - 1, first + 1), len(column))
        edges = at[first : last + 1] - at[first]
        low = _LOWER[raw[at[first] : at[last]]]
        inside = low > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at_edge = edges[(edges > 0) & (edges < len(low))]
        begins[at_edge] = inside[at_edge]
        start = np.flatnonzero(begins)
        if len(start):
            place = np.zeros(len(low) + 1, dtype=np.int64)
            np.cumsum(inside, out=place[1:])
            bounds = np.append(place[start], place[-1])
            words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])]).dictionary_encode()
            codes, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            doc = np.searchsorted(edges, start, side="right") - 1
            both, n = np.unique(doc * size + codes, return_counts=True)
            merged, back = np.unique(group[first + both // size] * size + both % size, return_inverse=True)
            total = np.bincount(back, n, len(merged)).astype(np.int64)
            yield merged // size, words.dictionary.take(pa.array(merged % size)), total, np.bincount(back, minlength=len(merged)).astype(np.int64)
        first = last


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents), summed over all documents."""
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source = (b.column(i).cast(pa.string()).dictionary_encode() for i in (0, 1))
            each = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * each + source.indices.to_numpy() if b.num_rows else np.zeros(0, dtype=np.int64)
            for g, term, n, d in term_counts(b.column(2), group):
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g // each)), source.dictionary.take(pa.array(g % each)), term.cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(d)], names)

    rows = map_arrow(docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text")), run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), three digits at a time so nothing overflows."""
    if np.max(total, initial=0) >= 1 << 53:
        count, total = count.astype(object), total.astype(object)
    q, r = (count + 2) // total, (count + 2) % total
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // total, r * 1000 % total
    return (q + 1).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pack(index: np.ndarray, count: np.ndarray) -> bytes:
    """Places and counts, each in the least number of bytes that holds them all."""
    i, c = (np.min_scalar_type(int(x.max(initial=0))) for x in (index, count))
    return struct.pack("<BBI", i.itemsize, c.itemsize, len(index)) + index.astype(i).tobytes() + count.astype(c).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    i, c, n = struct.unpack_from("<BBI", packed)
    return np.frombuffer(packed, f"u{i}", n, 6).astype(np.int64), np.frombuffer(packed, f"u{c}", n, 6 + i * n).astype(np.int64)


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """entries (place and count) as bytes; the other columns stay."""
    names = [*(c for c in vectors.columns if c != "entries"), "packed"]
    where = vectors.columns.index("entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(where)
            at = lists.offsets.to_numpy()
            index, count = (x.to_numpy() for x in lists.values.flatten())
            rows = [pack(index[i:j], count[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if k != where), pa.array(rows, pa.binary())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "entries")
    return map_arrow(vectors, run, schema + ", packed binary")


@dataclass
class Tile:
    """The pairs of two blocks of groups (or of one): members by side, and the sums so far."""

    lang: str
    one: bool
    vocabulary: int = 0
    names: tuple[list[str], list[str]] = field(default_factory=lambda: ([], []))
    totals: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    seen: int = 0

    def begin(self) -> None:
        self.place = [{s: i for i, s in enumerate(side)} for side in self.names]
        self.total = [np.array(t, dtype=np.int64) for t in self.totals]
        self.sums = np.zeros([len(self.names[0]), len(self.names[-1 + self.one])], dtype=np.int64)

    def _add(self, p: np.ndarray, q: np.ndarray, times: int = 1) -> None:
        for a in range(len(p)):
            after = a + 1 if self.one else 0
            self.sums[a, after:] += times * distance(p[a], q[after:]).sum(axis=1)

    def chunk(self, width: int, rows: list[tuple[int, str, bytes]]) -> None:
        """rows: side, source and packed counts of the groups that have terms of the chunk."""
        shares = []
        for side in range(2 - self.one):
            dense = np.zeros((len(self.names[side]), width), dtype=np.int64)
            for s, source, packed in rows:
                if s == side:
                    index, count = unpack(packed)
                    dense[self.place[side][source], index] = count
            shares.append(share(dense, self.total[side][:, None]))
        self._add(shares[0], shares[-1])
        self.seen += width

    def finish(self) -> Iterator[tuple[str, str, str, int]]:
        """(lang, source, other, value), both ways round; chunks that no group has terms of count here."""
        if self.vocabulary > self.seen:
            p, q = (share(np.zeros((len(t), 1), dtype=np.int64), t[:, None]) for t in (self.total[0], self.total[-1 + self.one]))
            self._add(p, q, self.vocabulary - self.seen)
        others = self.names[-1 + self.one]
        for a, name in enumerate(self.names[0]):
            for b in range(a + 1 if self.one else 0, len(others)):
                yield self.lang, name, others[b], int(self.sums[a, b])
                yield self.lang, others[b], name, int(self.sums[a, b])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles, sorted by tile and chunk, to sums of pairs. Chunk -1 names the groups."""
    tile: Tile | None = None
    key: tuple | None = None
    chunk, width, rows = -1, 0, []

    def flush() -> None:
        if chunk == -1:
            tile.begin()
        else:
            tile.chunk(width, rows)

    def output() -> Iterator[pa.RecordBatch]:
        flush()
        got = list(tile.finish())
        for i in range(0, len(got), 10_000):
            columns = list(zip(*got[i : i + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])

    for b in batches:
        for r in b.to_pylist():
            own = (r["lang"], r["low"], r["high"])
            if own != key:
                if tile is not None:
                    yield from output()
                tile, key, chunk, rows = Tile(r["lang"], r["low"] == r["high"]), own, -1, []
            side = int(r["block"] != r["low"])
            if r["chunk"] == -1:
                tile.vocabulary = r["width"]
                tile.names[side].append(r["source"])
                tile.totals[side].append(r["total"])
                continue
            if r["chunk"] != chunk:
                flush()
                chunk, width, rows = r["chunk"], r["width"], []
            rows.append((side, r["source"], r["packed"]))
    if tile is not None:
        yield from output()


def _share(count: Column, total: Column) -> Column:
    """share() as a column."""
    big = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", big, total.cast("decimal(20,0)")) + 1


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    part pair: the other sources of the language by their distance, f summed over the kept terms. part
    term: the group's terms that are more usual there than in the language, by f, only the `top` first.
    """
    got = staged(counts(docs), "term-counts")
    kept = got.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = staged(kept.select("lang", "term", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    chunks = -(-(langs.agg(F.max("vocabulary")).first()[0] or 1) // chunk)  # one number, whatever the input
    own = Window.partitionBy("lang", "chunk")
    words = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)))
    words = words.withColumns({"place": F.row_number().over(own.orderBy("term")) - 1, "width": F.count("*").over(own)})
    cells = staged(got.join(words, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "chunk", "place", "width"), "kept-counts")

    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("group_n", zero).alias("group_n"), F.coalesce("vocabulary", zero).alias("vocabulary"), F.coalesce("lang_total", zero).alias("lang_total"))
    groups = groups.withColumn("total", F.greatest(F.col("group_n") + 2 * F.col("vocabulary"), F.lit(1)))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    groups = staged(groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "groups")

    vectors = cells.groupBy("lang", "source", "chunk", F.col("width")).agg(F.collect_list(F.struct("place", "n")).alias("entries"))
    vectors = packed_vectors(vectors).join(groups.select("lang", "source", "block", "blocks", "total"), ["lang", "source"])
    heads = groups.select("lang", "source", F.lit(-1).cast("long").alias("chunk"), F.col("vocabulary").alias("width"), F.lit(None).cast("binary").alias("packed"), "block", "blocks", "total")
    rows = vectors.select(*heads.columns).unionAll(heads).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "chunk", "block", "source", "width", "total", "packed")
    tiles = rows.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk")
    pairs = map_arrow(tiles, _tiles, "lang string, source string, item string, value long")

    terms = cells.join(groups.select("lang", "source", "total", (F.col("lang_total") + 2 * F.col("vocabulary")).alias("all")), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("lang_n"), F.col("all")).alias("q")).where(F.col("p") > F.col("q"))
    gap = F.col("p") - F.col("q")
    terms = terms.select("lang", "source", "item", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    return _ranked(pairs, "pair").unionAll(_ranked(terms, "term").where(F.col("rank") <= top))
