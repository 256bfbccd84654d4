"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. A source's target is its share of
all words, at most `epochs` times its own words; what is above goes to the others by weight. Targets
become whole blocks by highest quotients (blocks small enough for the least target to have PARTS of them), each source's blocks are apportioned to its shards in
the same way, down a tree of at most FAN branches a node, and a shard takes whole passes over its documents plus the first blocks of its
documents in seeded order.

Only sources are rows on the driver, a name and a number each. Documents go to shards by a seeded hash of doc_id and text,
so null or repeated ids spread. Rows equal in doc_id, source and text are one entry with a count and take the same number of
words each, give or take one. An entry goes to shards in pieces of COPIES rows, so a row that is repeated often is no hot key. Null texts have size 0 and null sources form one source. Sources without words have target 0. Empty tables
give empty tables. Columns other than doc_id, text and source don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD, staged, text_of


#: Branches of a node of the tree of a source's shards.
FAN = 256
#: Blocks that the least target has at least (if it has the words), and rows of an entry that go to a shard together.
PARTS, COPIES = 512, 1024
#: Entries of more than one row that may be broadcast, four short columns each.
BROADCAST = 1 << 18


@dataclass(frozen=True)
class Plan:
    """block: words of a block at most; shard: words of a shard, about."""

    block: int = 32
    shard: int = 100_000
    epochs: int = 3
    seed: int = 17
    weights: tuple[int, ...] = (1, 2, 3)


def capped_targets(sizes: Sequence[int], weights: Sequence[float], epochs: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above epochs * size; the excess is shared again until none is."""
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(epochs * sizes[i])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if target[i] == 0.0]
    return target


def apportion(votes: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 * held + 1); ties go to the earlier; nobody above its limit.

    A start close below the answer comes from the common divisor, so the heap hands out only a few
    seats for each party, not all of them.
    """
    n = len(votes)
    limits = [seats] * n if limits is None else list(limits)
    seats = min(seats, sum(m for v, m in zip(votes, limits, strict=True) if v > 0))
    held = [0] * n

    def given(divisor: float) -> list[int]:
        return [min(m, int(v / divisor + 0.5)) if v > 0 else 0 for v, m in zip(votes, limits, strict=True)]

    if seats > n and (total := sum(votes)) > 0:
        low, high = min(v for v in votes if v > 0) / (2 * seats + 2), 2 * total
        for _ in range(200):  # high: gives at most the seats
            mid = (low + high) / 2
            low, high = (low, mid) if sum(given(mid)) <= seats else (mid, high)
        held = [max(0, h - 1) for h in given(high)]
    heap = [(-v / (2 * h + 1), i) for i, (v, h, m) in enumerate(zip(votes, held, limits, strict=True)) if v > 0 and h < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < limits[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def _keyed(docs: DataFrame) -> list[Column]:
    """The keys of an entry: doc_id, source, digest of the text, and its size."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_of()).alias("digest"), size.alias("size")]


def _code_points(source: str | None) -> tuple[bool, list[int]]:
    return source is None, [ord(c) for c in source or ""]


def _quotas(shards: DataFrame, sources: DataFrame, levels: int, block: int, plan: Plan) -> DataFrame:
    """of, of_shard, passes and part (words) of each shard (source, shard, n): seats go down the tree, a group of at most FAN branches at a time."""

    def seat(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        blocks = [-(-n // block) for n in rows["n"].tolist()]
        seats = apportion([float(n) for n in rows["n"].tolist()], int(rows["seats"].iloc[0]), [plan.epochs * b for b in blocks])
        return pd.DataFrame({"source": rows["source"], "node": rows["node"], "n": rows["n"], "quota": seats})

    above = sources.select(F.col("of").alias("s"), F.lit(0).cast("long").alias("up"), F.col("quota").alias("seats"))
    for level in range(1, levels + 1):
        nodes = shards.select("source", F.expr(f"shard div {FAN ** (levels - level)}").alias("node"), "n")
        nodes = nodes.groupBy("source", "node").agg(F.sum("n").alias("n")).withColumn("parent", F.expr(f"node div {FAN}"))
        both = nodes.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("parent") == F.col("up")))
        got = staged(both.groupBy("source", "parent").applyInPandas(seat, "source string, node long, n long, quota long"), "quotas")
        above = got.select(F.col("source").alias("s"), F.col("node").alias("up"), F.col("quota").alias("seats"))
    n = F.greatest(F.col("n"), F.lit(1))
    words = F.least(F.col("quota") * block, plan.epochs * F.col("n"))
    return got.select(F.col("source").alias("of"), F.col("node").alias("of_shard"), F.floor(words / n).alias("passes"), (words % n).alias("part"))


def _entries(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, source, digest, size, piece, rows, source_size, target, quota, taken (of each of its rows) and extra (rows that take one word more) of each piece of an entry."""
    spark = docs.sparkSession
    entries = docs.select(*_keyed(docs)).groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n"))
    entries = entries.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    entries = staged(entries.withColumn("rows", F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("piece"))), "mix-entries")
    words = F.sum(F.col("size") * F.col("rows"))
    totals = sorted(((r.source, r.n) for r in entries.groupBy("source").agg(words.alias("n")).collect()), key=lambda r: _code_points(r[0]))
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(totals))]
    target = capped_targets([n for _, n in totals], weights, plan.epochs)
    block = max(1, min(plan.block, int(min((t for t in target if t > 0), default=0) / PARTS)))
    blocks = [-(-n // block) for _, n in totals]
    quota = apportion(target, round(sum(target) / block), [plan.epochs * b for b in blocks])
    counts = [max(1, -(-n // plan.shard)) for _, n in totals]
    sources = spark.createDataFrame(
        [(s, n, t, q, k) for (s, n), t, q, k in zip(totals, target, quota, counts, strict=True)],
        "of string, source_size long, target double, quota long, shards long",
    )
    levels = 1
    while FAN**levels < max(counts, default=1):
        levels += 1
    # A hot source has as many shards as its words ask for, so no shard grows with it.
    placed = entries.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("place", F.xxhash64(F.lit(plan.seed), "doc_id", "digest", "piece"))
    placed = placed.withColumn("shard", F.pmod(F.col("place"), F.col("shards")))
    shares = _quotas(staged(placed.groupBy("source", "shard").agg(words.alias("n")), "mix-shards"), sources, levels, block, plan)
    joined = placed.join(shares, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard")))
    whole = F.col("size") * F.col("rows")
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "digest", "size", "piece").rowsBetween(Window.unboundedPreceding, 0)
    partly = F.greatest(F.lit(0).cast("long"), F.least(whole, F.col("part") - (F.sum(whole).over(order) - whole)))
    joined = joined.withColumn("partly", partly)
    taken = F.col("size") * F.col("passes") + F.floor(F.col("partly") / F.col("rows"))
    return joined.select("doc_id", "source", "digest", "size", "n", "piece", "rows", "source_size", "target", "quota", taken.cast("long").alias("taken"), (F.col("partly") % F.col("rows")).alias("extra"))


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, source, size, source_size, target, quota (blocks of its source), taken, a row for each row of docs."""
    each = _entries(docs, plan).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", "quota", (F.col("taken") + (F.col("place") < F.col("extra")).cast("long")).alias("taken"))


def _numbered(rows: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """rows with piece and place, the number of a row among those of its entry; of an entry of one row both are 0.

    Rows of one entry are counted in each part of the input, and the parts one after the other, so no task sees all
    of them.
    """
    zero = F.lit(0).cast("long")
    many = entries.where("n > 1 AND piece = 0").select(*(F.col(k).alias(f"m_{k}") for k in keys))
    found = many.count()
    if not found:
        return rows.select("*", zero.alias("piece"), zero.alias("place"))
    if found <= BROADCAST:  # else the rows go to their keys
        many = F.broadcast(many)
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    once = rows.join(many, on, "left_anti").select("*", zero.alias("piece"), zero.alias("place"))
    same = staged(rows.withColumn("part_of_input", F.spark_partition_id()).join(many, on, "left_semi"), "mix-repeated")
    parts = same.groupBy(*keys, "part_of_input").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy(*keys).orderBy("part_of_input").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("part_of_input").alias("p_part"), F.coalesce(before, zero).alias("before"))
    own = Window.partitionBy(*keys, "part_of_input").orderBy(F.lit(0))
    same = same.withColumn("number", F.row_number().over(own))
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys] + [F.col("part_of_input") == F.col("p_part")]
    number = F.col("before") + F.col("number") - 1
    same = same.join(parts, on).select(*rows.columns, F.floor(number / COPIES).alias("piece"), (number % COPIES).alias("place"))
    return once.unionAll(same)


def mixed(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs with every document as often as the mix takes it: a row for each pass, the last cut to whole words.

    A cut document keeps its first words, with the text up to the end of the last of them. All
    columns stay; n_chars, where there is one, is that of the new text. The rows hold exactly the words taken.
    """
    keys = ["doc_id", "source", "digest", "size"]
    entries = staged(_entries(docs, plan), "mix-taken")
    take = entries.where("taken > 0 OR extra > 0").select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("piece").alias("of_piece"), "taken", "extra")
    rows = _numbered(docs.select(F.struct("*").alias("row"), *_keyed(docs)), keys, entries)
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) if k in ("doc_id", "source") else F.col(k) == F.col(f"of_{k}") for k in [*keys, "piece"]]
    hit = rows.join(take, on).withColumn("taken", F.col("taken") + (F.col("place") < F.col("extra")).cast("long")).where("taken > 0")
    rest = F.col("taken") % F.col("size")
    pieces = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(rest > 0, F.array(F.array_join(F.slice(pieces, 1, rest.cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("row.text"), F.expr("cast(taken div size as int)")), cut)
    out = hit.select("row", F.explode(texts).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
