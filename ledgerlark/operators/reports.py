"""Digests, gauges and export summaries: small aggregates laid out as lines or rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.filters import RowFilter


def gauges(df: DataFrame, name: str, labels: Sequence[str], value: Column | None = None) -> DataFrame:
    """One line of metric text for each group of labels."""
    got = df.groupBy(*labels).agg((F.count("*") if value is None else value).alias("_v"))
    pairs = [F.concat(F.lit(f'{c}="'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit("")), F.lit('"')) for c in labels]
    return got.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col("_v").cast("string")).alias("line"))


def all_gauges(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def digest_line(df: DataFrame, title: str, key: str, none: str = "none") -> DataFrame:
    """'title: a=3, b=1' by falling counts, or the word for none."""
    got = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k")))).alias("x"))
    said = F.array_join(F.transform("x", lambda e: F.concat(e["k"], F.lit("="), (-e["o"]).cast("string"))), ", ")
    return got.select(F.concat(F.lit(f"{title}: "), F.when(F.size("x") == 0, none).otherwise(said)).alias("line"))


def summary(df: DataFrame, tallies: Mapping[str, Column], groups: Sequence[str], distinct: Mapping[str, str]) -> DataFrame:
    """Rows (section, label, count) of an export: conditional counts, distinct counts, counts by group."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in tallies.items()), *(F.count_distinct(c).alias(n) for n, c in distinct.items()))
    names = [*tallies, *distinct]
    rows = one.select(F.explode(F.array(*(F.struct(F.lit("summary").alias("section"), F.lit(n).alias("label"), F.col(n).cast("long").alias("count")) for n in names))).alias("r")).select("r.*")
    for g in groups:
        label = F.coalesce(F.nullif(F.col(g).cast("string"), F.lit("")), F.lit("(blank)"))
        rows = rows.unionByName(df.groupBy(label.alias("label")).agg(F.count("*").alias("count")).select(F.lit(g).alias("section"), "label", "count"))
    return rows


def saved_filter(text: str) -> RowFilter:
    """A filter stored as JSON: {"equal": {...}, "one_of": {...}, "at_least": {...}, "search": "..."}; unknown keys don't count."""
    known = json.loads(text)
    own = {k: known[k] for k in ("equal", "one_of", "at_least", "at_most", "flags", "search") if k in known}
    return RowFilter(**own, search_in=tuple(known.get("search_in", ())))


def hiring_signals(items: DataFrame, key: str, title: str, published: str, words: Sequence[str], as_of: Column, days: int = 90, most: int = 5) -> DataFrame:
    """The first items of each key whose title has a hiring word and that aren't older than the days."""
    from ledgerlark.operators.ranking import best_per

    hit = F.lower(F.col(title)).rlike("|".join(words))
    fresh = F.coalesce(F.col(published) >= as_of - F.make_dt_interval(days=F.lit(days)), F.lit(True))
    return best_per(items.where(hit & fresh), key, [F.col(published).desc_nulls_last(), F.col(title)], most, "rank")
