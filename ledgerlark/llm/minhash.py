"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is its set of five-word shingles (all its words where it has fewer than five), each weighing
1 + ln(times it occurs). Every shingle is a Poisson process of that rate: its arrivals hit random
signature components, the earliest arrival wins a component, and a shingle stops as soon as its next arrival
is later than all components' winners. The share of equal components estimates the probability
Jaccard similarity, which is the Jaccard similarity where all weights are equal. A text that repeats a shingle
has a second signature with equal weights (a text that doesn't has the same one twice, and keeps one), so
the chance to share a band never depends on how often shingles repeat.

Texts with equal shingles and weights collapse to one node first. Nodes that share a band are
candidates; a pair is a link if its shingle sets have a Jaccard similarity of `similarity` or more.
Candidates of a bucket are tried against one member. All pairs of a bucket that are then in different components are
compared too: as pairs in buckets of at most FEW members, and block by block in larger ones, where a task counts the common
shingles of two blocks as a matrix product and returns a forest of the links. So no bucket becomes rows for all its pairs, the
blocks of a hot bucket go to many tasks, and every candidate pair is either linked, connected or found apart.

Texts without words are copies of each other. Nulls count as empty texts. Rows that repeat a doc_id are rows of
their own; a null doc_id has the class of its text. The class id is the least doc_id of the class, null only where
all are null. Empty tables give empty tables. Extra columns are ignored by classes() and kept by
keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import textscan as S
from ledgerlark.llm.common import map_arrow, staged, staged_from, tidy


#: Bits of the bitmap that keeps texts which are no candidates out of a shuffle.
FILTER_BITS = 1 << 25
#: Members of a bucket up to which its pairs are rows of a join.
FEW = 8
#: Members and shingles of a block of a larger bucket, about; columns and rows of a matrix of it.
BLOCK, BLOCK_SHINGLES, WIDE, TALL = 1024, 1 << 19, 1024, 512


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4


def shingles(c: S.Chunk, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashes and counts of the distinct shingles of a chunk, by document."""
    at, key = c.grams(words)
    doc = c.doc[at]
    for k in range(1, words):
        if len(own := np.flatnonzero(c.n_words == k)):
            first = c.word_at[own]
            _, h = c.grams(k, first)
            doc, key = np.concatenate([doc, own]), np.concatenate([key, h])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """ProbMinHash components (n_docs, size): the winning shingle's hash, 0 for documents without any."""
    best = np.full(n_docs * size, np.inf)
    time = np.zeros(len(key))
    alive = np.arange(len(key))
    log: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    turn = 0
    while len(alive):
        turn += 1
        x = S.mix(key[alive] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        gap = -np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight[alive]
        now = time[alive] + gap
        time[alive] = now
        slot = doc[alive] * size + ((S.mix(x) >> np.uint64(33)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, slot, now)
        log.append((slot, now, alive))
        latest = best.reshape(n_docs, size).max(axis=1)
        alive = alive[now < latest[doc[alive]]]
    out = np.zeros(n_docs * size, dtype=np.uint64)
    for slot, now, own in log:
        won = now == best[slot]
        out[slot[won]] = key[own[won]]
    return out.reshape(n_docs, size)


def _bands(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, near: Near) -> np.ndarray:
    sig = signatures(doc, key, weight, n_docs, near.bands * near.rows)
    band = np.zeros((n_docs, near.bands), dtype=np.uint64)
    for k in range(near.rows):
        band = S.mix(band + sig[:, k :: near.rows] + np.arange(near.bands, dtype=np.uint64))
    return band


def band_keys(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles and their distinct band keys, by document: of the weighted signature and, where shingles repeat, of the plain one."""
    some, repeat = np.unique(doc), np.unique(doc[count > 1])
    weighted = _bands(doc, key, 1 + np.log(count), n_docs, near)[some]
    own = np.isin(doc, repeat)
    plain = _bands(np.searchsorted(repeat, doc[own]), key[own], np.ones(int(own.sum())), len(repeat), near)
    owner = np.repeat(np.concatenate([some, repeat]), near.bands)
    band = np.concatenate([weighted.reshape(-1), plain.reshape(-1)])
    order = np.lexsort((band, owner))
    owner, band = owner[order], band[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])
    return owner[new], band[new]


def _digests(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each document's shingles and counts."""
    x = S.mix(key + count.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    out = []
    for seed in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D):
        total = np.zeros(len(key) + 1, dtype=np.uint64)
        np.cumsum(S.mix(x ^ np.uint64(seed)), out=total[1:])
        at = np.searchsorted(doc, np.arange(n_docs + 1))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _described(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, d1, d2 (digest), n (distinct shingles), bands of each row."""
    names = ["doc_id", "d1", "d2", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in S.chunks(b.column(1)):
                doc, key, count = shingles(c, near.words)
                some = np.diff(np.searchsorted(doc, np.arange(c.n_docs + 1)))
                own, band = band_keys(doc, key, count, c.n_docs, near)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(c.n_docs + 1)), pa.int32()), pa.array(band.view(np.int64)))
                d1, d2 = _digests(doc, key, count, c.n_docs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n_docs), pa.array(d1), pa.array(d2), pa.array(some.astype(np.int64)), lists], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, d1 long, d2 long, n long, bands array<long>")


def _sets(docs: DataFrame, near: Near) -> DataFrame:
    """d1, d2 and the 64-bit hashes of the distinct shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in S.chunks(b.column(0)):
                doc, key, count = shingles(c, near.words)
                d1, d2 = _digests(doc, key, count, c.n_docs)
                ends = pa.array(np.searchsorted(doc, np.arange(c.n_docs + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), lists], ["d1", "d2", "shingles"])

    return map_arrow(docs.select("text"), run, "d1 long, d2 long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of edges (u, v), by large and small stars.

    A star's centre may hold a large part of all edges. The least neighbours are staged, so both sides of each join
    have an exchange of their own and Spark splits such a centre.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m"), "least")
        small = large.join(least, F.col("u") == F.col("of")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        seen = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38)))")).first()
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)


def _met(key: np.ndarray, at: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some of xs, ys and how many of the numbers key[at[k]:at[k + 1]] each two of them have in common."""

    def laid(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = at[own + 1] - at[own]
        first = np.repeat(at[own] - np.append(0, np.cumsum(size)[:-1]), size)
        return np.repeat(np.arange(len(own)), size), key[first + np.arange(len(first))]

    def matrix(row: np.ndarray, column: np.ndarray, n: int, low: int) -> np.ndarray:
        own = (column >= low) & (column < low + WIDE)
        out = np.zeros((n, WIDE), dtype=np.float32)
        out[row[own], column[own] - low] = 1
        return out

    y_row, y_key = laid(ys)
    for k in range(0, len(xs), TALL):
        some = xs[k : k + TALL]
        x_row, x_key = laid(some)
        both = np.intersect1d(x_key, y_key)
        (xr, xc), (yr, yc) = ((r[m], np.searchsorted(both, v[m])) for r, v in ((x_row, x_key), (y_row, y_key)) for m in [np.isin(v, both)])
        common = np.zeros((len(some), len(ys)), dtype=np.float32)
        for low in range(0, len(both), WIDE):
            common += matrix(xr, xc, len(some), low) @ matrix(yr, yc, len(ys), low).T
        yield some, ys, common


def _forest(pairs: np.ndarray) -> list[int]:
    """Numbers of the pairs (two rows) that join what the pairs before them don't."""
    above = list(range(int(pairs.max(initial=-1)) + 1))
    out = []
    for k, (x, y) in enumerate(pairs.T.tolist()):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append(k)
    return out


def links_of_blocks(node: np.ndarray, component: np.ndarray, second: np.ndarray, key: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between members of two blocks (second: whether in the second one) in different components, as many as join the same components.

    Without a second block, of those within the first. A forest of links joins what all of them join, and is no larger than the blocks.
    """
    names, place = np.unique(component, return_inverse=True)
    most = place == np.bincount(place).argmax()  # no pair within the largest component
    if second.any():
        sides = [(~second & ~most, second), (~second & most, second & ~most)]
    else:
        sides = [(~most, np.ones(len(node), dtype=bool))]
    size = at[1:] - at[:-1]
    joined, ends = np.zeros((2, 0), dtype=np.int64), np.zeros((2, 0), dtype=np.int64)
    for x, y in sides:
        for xs, ys, common in _met(key, at, np.flatnonzero(x), np.flatnonzero(y)) if x.any() and y.any() else ():
            total = size[xs][:, None] + size[ys][None, :]
            i, j = np.nonzero((common >= similarity * (total - common)) & (place[xs][:, None] != place[ys][None, :]))
            new = np.concatenate([joined, np.stack([place[xs[i]], place[ys[j]]])], axis=1)
            ends = np.concatenate([ends, np.stack([node[xs[i]], node[ys[j]]])], axis=1)
            _, once = np.unique(np.minimum(new[0], new[1]) * len(names) + np.maximum(new[0], new[1]), return_index=True)
            kept = once[_forest(new[:, once])]
            joined, ends = new[:, kept], ends[:, kept]
    return ends.min(axis=0), ends.max(axis=0)


def _apart(multi: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that still have several components, with their component and their bucket's size."""
    named = multi.join(label.select(F.col("node").alias("ln"), "component"), F.col("node") == F.col("ln"), "left")
    named = staged(named.select("key", "node", "n", "lead", F.coalesce("component", "node").alias("component")), "named")
    sizes = named.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.min("component").alias("c"), F.max("component").alias("d"))
    sizes = staged(sizes.where("c <> d and members > 2").drop("c", "d"), "open")  # a hot bucket is then split in the join
    return named.join(sizes, F.col("key") == F.col("of")).drop("of")


def _few(apart: DataFrame) -> DataFrame:
    """Untried pairs between components of small buckets: all that are not with the lead."""
    few = apart.where((F.col("members") <= FEW) & (F.col("node") != F.col("lead")))
    a, b = (few.select(F.col("key").alias(f"{x}k"), F.col("node").alias(x), F.col("n").alias(m), F.col("component").alias(f"{x}c")) for x, m in (("u", "p"), ("v", "q")))
    return a.join(b, F.col("uk") == F.col("vk")).where("u < v and uc <> vc").select("u", "v", "p", "q")


def _between_blocks(apart: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links that join the components of larger buckets; each two blocks of a bucket are a group."""
    n = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    many = apart.where(F.col("members") > FEW).withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", "node", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))
    whole = sets.select(F.col("node").alias("of"), "shingles")
    rows = many.join(whole, F.col("node") == F.col("of")).drop("of")
    similarity = near.similarity

    def run(t: pa.Table) -> pa.Table:
        tidy()
        t = t.combine_chunks()
        lists = pa.concat_arrays(t["shingles"].chunks)
        at = lists.offsets.to_numpy().astype(np.int64)
        node, component = (t[c].to_numpy() for c in ("node", "component"))
        u, v = links_of_blocks(node, component, t["second"].to_numpy(), lists.values.to_numpy(), at, similarity)
        return pa.table({"u": u, "v": v})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def _linked(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs that are links. Both joins read the same exchange of the sets."""
    left, right = sets.alias("l"), sets.alias("r")
    both = pairs.select("u", "v").join(left, F.col("u") == F.col("l.node")).join(right, F.col("v") == F.col("r.node"))
    common = F.size(F.array_intersect("l.shingles", "r.shingles"))
    total = F.size("l.shingles") + F.size("r.shingles")
    return both.where(common >= F.lit(near.similarity) * (total - common)).select("u", "v")


def _size_fits(near: Near) -> Column:
    return F.least("p", "q") >= F.lit(near.similarity) * F.greatest("p", "q")


def _maybe(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows whose column may be one of ids (id), by a bitmap of hashes: keeps most others out of the next shuffle.

    The bitmap has FILTER_BITS bits in rows of 64, at most 2**19 rows, so it is small enough to
    broadcast at any size of input; where it fills up, it only lets more rows through to the exact join.
    """

    def place(c: str) -> tuple[Column, Column]:
        spot = F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
        return F.floor(spot / 64), (spot % 64).cast("int")

    word, bit = place("id")
    words = ids.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    word, bit = place(column)
    hit = rows.join(F.broadcast(words), word == F.col("_word"))
    return hit.where(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def _labelled(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, d1, d2, component of each row; a component is the least row number of its rows."""
    rows = staged(_described(docs, near).withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes = rows.groupBy("d1", "d2").agg(F.min("row").alias("node"))
    first = staged(rows.join(nodes.select(F.col("node").alias("own")), F.col("row") == F.col("own"), "left_semi").select("row", "n", "bands"), "nodes")
    bands = first.select(F.explode("bands").alias("key"), F.col("row").alias("node"), "n")
    shared = staged(bands.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b"), "shared")
    multi = staged(bands.join(shared, F.col("key") == F.col("of")).select("key", "node", "n", F.col("a").alias("lead")), "buckets")
    names = multi.select("node").distinct()
    wanted = staged(rows.join(names, F.col("row") == F.col("node"), "left_semi").select("doc_id", "row", "d1", "d2"), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    # ids are distinct, so this is a semi join; Spark would push one that is written so below the bitmap.
    held = _sets(_maybe(texts, "doc_id", ids).join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("text"), near)
    keyed = wanted.select(F.col("row").alias("node"), F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    sets = held.join(keyed, (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).dropDuplicates(["w1", "w2"])
    sets = staged(sets.select("node", "shingles"), "shingles")

    sized = multi.select(F.col("node").alias("u0"), F.col("n").alias("q0")).distinct()
    lead = multi.where("node <> lead").select("node", "n", "lead").distinct().join(sized, F.col("lead") == F.col("u0"))
    pairs = lead.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"), F.col("n").alias("p"), F.col("q0").alias("q"))
    tried = staged(pairs.where(_size_fits(near)).select("u", "v").distinct(), "tried")
    edges = staged(_linked(tried, sets, near), "links")
    label = staged(components(edges), "labels")
    apart = staged(_apart(multi, label), "apart")
    few = staged(_few(apart).where(_size_fits(near)).select("u", "v").distinct(), "tried")
    more = staged(_linked(few, sets, near).union(_between_blocks(apart, sets, near)), "links")
    if not more.isEmpty():
        label = components(edges.union(more))
    own = nodes.join(label.select(F.col("node").alias("ln"), "component"), F.col("node") == F.col("ln"), "left")
    own = own.select(F.col("d1").alias("w1"), F.col("d2").alias("w2"), F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "d1", "d2").join(own, (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).drop("w1", "w2")


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, a row for each row of docs."""
    rows = staged_from(lambda: _labelled(docs, near).select("doc_id", "component"), docs.sparkSession, "classes")
    each = rows.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    each = staged(each, "class-ids")  # both sides of the join then have an exchange of their own, and a hot class is split
    return rows.join(each, F.col("component") == F.col("of")).select("doc_id", "class_id", "class_size")


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """docs with one row of each class, that of the least doc_id, with all its columns."""
    rows = staged_from(lambda: _labelled(docs, near), docs.sparkSession, "classes")
    order = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "d1", "d2")
    first = rows.groupBy("component").agg(F.min(order).alias("k")).select(*(F.col(f"k.{c}").alias(f"k_{c}") for c in ("none", "id", "d1", "d2")))
    names = docs.columns

    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            for c in S.chunks(rows.field(at)):
                d1, d2 = _digests(*shingles(c, near.words), c.n_docs)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), rows.slice(c.first, c.n_docs)], ["d1", "d2", "row"])

    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    marked = map_arrow(docs.select(F.struct("*").alias("row")), run, f"d1 long, d2 long, row {kind}").withColumn("id", F.col("row.doc_id").cast("long"))
    marked = marked.select(F.col("id").isNull().cast("int").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "d1", "d2", "row")
    # Plain equalities on the columns that dropDuplicates takes too: the texts are shuffled once.
    keys = ["none", "id", "d1", "d2"]
    on = [F.col(k) == F.col(f"k_{k}") for k in keys]
    out = marked.join(first, on, "left_semi").dropDuplicates(keys)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names))
