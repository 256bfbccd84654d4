"""Lists: projections, orders, claims of many ids at once, and small computed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def projected(df: DataFrame, names: Mapping[str, str], **computed: Column) -> DataFrame:
    """The columns of names under their new names, and the computed ones; Spark reads no others."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()), *(c.alias(n) for n, c in computed.items()))


def composed_location(*parts: Column) -> Column:
    """The parts that are there, with commas between them; NULL where none is."""
    some = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return F.when(F.coalesce(*some).isNotNull(), F.concat_ws(", ", *some))


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from start to end."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")


def true_first(c: Column) -> Column:
    """Sort key: true, false, NULL."""
    return c.desc_nulls_last()


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Sort key: the place in an order; anything else comes behind, NULL too."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def placed(df: DataFrame, keys: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in an order with their place from 1: a top-n of each task, then one of n rows each."""
    return df.orderBy(*keys).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def run_totals(df: DataFrame, source: str, content: Column) -> DataFrame:
    """What each source gave: rows, distinct contents, repeats and empty ones. Sources and digests are grouped first, so a hot source is spread."""
    each = df.groupBy(source, F.md5(content.cast("binary")).alias("_digest")).agg(F.count("*").alias("n"), F.count_if(content == "").alias("e"))
    out = each.groupBy(source).agg(F.sum("n").alias("discovered"), F.count("*").alias("stored"), F.sum("e").alias("errors"))
    return out.select(source, "discovered", "stored", (F.col("discovered") - F.col("stored")).alias("duplicates"), "errors")


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """One spelling of a record: keys in order, NULLs kept, no spaces."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def filled(*columns: Column) -> Column:
    """How many of the columns hold something."""
    return sum((F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)).cast("int") for c in columns), F.lit(0))


def claim_outcomes(asked: DataFrame, known: DataFrame, key: str, owner: str, closed: str, user: str) -> DataFrame:
    """What becomes of each id that a user asks for: claimed, already_mine, taken, closed or not_found."""
    rows = asked.select(key).distinct().join(known.select(F.col(key).alias("_id"), owner, closed), F.col(key) == F.col("_id"), "left")
    outcome = F.when(F.col("_id").isNull(), "not_found").when(F.col(closed), "closed").when(F.col(owner) == user, "already_mine").when(F.col(owner).isNotNull(), "taken")
    return rows.select(key, outcome.otherwise("claimed").alias("outcome"))


def skipped(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The ids asked for that nothing was done to, once each."""
    return asked.select(key).distinct().join(done.select(key), key, "left_anti")
