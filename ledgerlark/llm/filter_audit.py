"""Filter interaction audit: what each filter removes at each place of every order of the filters.

A document becomes a mask of the filters it fails, and masks are counted in cells, so the orders need
no further pass over documents. All orders are visited by swaps of neighbours (the plain changes of
bell ringers): a swap at steps k and k + 1 changes these two steps only, by the documents that fail
both filters and none before them, and the sum of a filter's removals along the walk is its Shapley
value times the number of orders.

Nulls: a null text is empty, a null lang is the part '', a null doc_id has no labels and is no copy.
Empty texts have no words. Repeated rows count each; rows of one doc_id and text are no copies of each
other. A doc_id with several labels has a label if any row says so. Texts are judged whole. Extra
columns are ignored, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import staged, text_of

#: Filters on a text, by letter: true where the document fails. The last letter is for copies.
Filters = dict[str, Column]
COPY = "E"
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> Filters:
    """Short, repetitive, shouting and symbol texts."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Filters] = text_filters, part: str = "lang") -> tuple[DataFrame, str]:
    """(part, mask, good, toxic, n) and the letters of the mask's bits.

    Rows become (doc_id, digest, part, mask) with a count before anything meets: copies of one text are
    then spread by their doc_id, and only the least doc_id of each text is joined back, so a text with
    many copies is no hot key.
    """
    text = text_of()
    own = filters(text)
    letters = "".join(own)
    bits = F.lit(0)
    for i, failed in enumerate(own.values()):
        bits = bits + F.coalesce(failed, F.lit(False)).cast("int") * (1 << i)
    rows = docs.select(F.col("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"))
    rows = staged(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "filter-rows")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int") * (1 << len(letters))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask"), *flags).agg(F.sum("n").alias("n")), letters + COPY


def plain_changes(n: int) -> Iterator[int]:
    """The places k at which swapping k and k + 1, one after the other, visits all orders of n things."""
    places, way = list(range(n)), [-1] * n
    at = list(range(n))
    while True:
        able = [x for x in range(n) if 0 <= (to := at[x] + way[x]) < n and places[to] < x]
        if not able:
            return
        x = max(able)
        here, to = at[x], at[x] + way[x]
        y = places[to]
        places[here], places[to], at[x], at[y] = y, x, to, here
        for z in range(x + 1, n):
            way[z] = -way[z]
        yield min(here, to)


def walk(cells: np.ndarray, letters: str) -> pd.DataFrame:
    """The audit's rows for counts by mask; a column each for documents, good and toxic ones."""
    n, masks = len(letters), np.arange(len(cells))
    bit = [1 << i for i in range(n)]
    failing = np.array([cells[(masks & b) > 0, 0].sum() for b in bit])
    alone = np.array([cells[b, 0] for b in bit])
    order = list(range(n))
    removed = np.zeros((n, cells.shape[1]), dtype=np.int64)  # by step
    before = 0
    for k, x in enumerate(order):
        removed[k] = cells[((masks & bit[x]) > 0) & ((masks & before) == 0)].sum(axis=0)
        before |= bit[x]
    left = np.concatenate([[cells[:, 0].sum()], cells[:, 0].sum() - np.cumsum(removed[:, 0])])
    shapley = np.zeros(n, dtype=np.int64)
    rows = []

    def visit() -> None:
        name = "".join(letters[x] for x in order)
        for k, x in enumerate(order):
            shapley[x] += removed[k, 0]
            rows.append((name, k + 1, letters[x], left[k + 1], removed[k, 0], failing[x] - removed[k, 0], alone[x], removed[k, 1], removed[k, 2]))

    visit()
    for k in plain_changes(n):
        x, y = order[k], order[k + 1]
        before = sum(bit[z] for z in order[:k])
        both = bit[x] | bit[y]
        shared = cells[((masks & both) == both) & ((masks & before) == 0)].sum(axis=0)  # whichever comes first removes them
        removed[[k, k + 1]] = removed[k + 1] + shared, removed[k] - shared
        left[k + 1] = left[k] - removed[k, 0]
        order[k], order[k + 1] = y, x
        visit()
    out = pd.DataFrame(rows, columns=["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    return out.assign(shapley=out["filter"].map(dict(zip(letters, shapley.tolist(), strict=True))))


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Filters] = text_filters, part: str = "lang") -> DataFrame:
    """A row for each part, order and step. A part's cells, 4 for each mask at most, are one small group."""
    cells, letters = failures(docs, labels, filters, part)
    assert set(letters) <= set(string.ascii_uppercase)

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(letters), 3), dtype=np.int64)
        for column, rows in enumerate((got, got[got["good"]], got[got["toxic"]])):
            np.add.at(counts[:, column], rows["mask"].to_numpy(), rows["n"].to_numpy())
        out = walk(counts, letters)
        out.insert(0, "part", key[0])
        return out

    longs = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return cells.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in longs))
