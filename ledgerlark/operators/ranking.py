"""Sorting, pages, top-k and rankings; every order is total, NULLs are placed on purpose."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.strings import like_escaped


def sort_key(column: str, descending: bool, sparse: bool = False) -> Column:
    """A sort column. Sparse ones have NULL last both ways, others last rising and first falling."""
    c = F.col(column)
    return (c.desc_nulls_last() if sparse else c.desc_nulls_first()) if descending else c.asc_nulls_last()


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    pages: int


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> Page:
    """A page and how many there are. The rows come from a top-k, not from a sort of all."""
    total = df.count()
    return Page(page_rows(df, order, number, size), total, math.ceil(total / size))


def page_rows(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def capped(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows with truncated: whether there are more."""
    first = df.orderBy(*order).limit(most + 1)
    more = first.agg(F.count("*").alias("n")).scalar() > most
    return first.withColumn("truncated", more).orderBy(*order).limit(most)


def best_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. A key's rows are cut to n on each task before the shuffle (window group limit)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def latest_per(df: DataFrame, key: str, stamp: str, *values: str) -> DataFrame:
    """Values of each key's latest row by a partial aggregate; ties by the values, falling."""
    x = F.max(F.struct(stamp, *values)).alias("x")
    return df.groupBy(key).agg(x).select(key, "x.*")


def search_rank(term: str, c: Column) -> Column:
    """2 where the name starts with the term, else 1."""
    return F.when(c.ilike(like_escaped(term) + "%"), 2).otherwise(1)


def readiness_order(ready: Column) -> Column:
    order = F.array(*(F.lit(x) for x in ("OUTREACH_READY", "PARTIALLY_ENRICHED", "NEEDS_ENRICHMENT", "INSUFFICIENT_DATA")))
    return F.array_position(order, ready)


def timeline(*parts: DataFrame, by: Sequence[Column]) -> DataFrame:
    """Rows of unlike tables in one order, missing columns NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*by)
