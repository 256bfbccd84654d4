"""Candidates of scheduled work: retention, enrichment, verification, stuck rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def older_than(stamp: Column, as_of: Column, days: int = 0, hours: int = 0) -> Column:
    return stamp < as_of - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def retention(people: DataFrame, contacted: DataFrame, barred: DataFrame, key: str, stamp: str, as_of: Column, days: int) -> DataFrame:
    """Rows never contacted, not barred and older than the days; NULL keys among the barred bar nobody."""
    old = people.where(older_than(F.col(stamp), as_of, days))
    return old.join(contacted.select(key).distinct(), key, "left_anti").join(barred.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def retention_as_written(people: DataFrame, barred: DataFrame, key: str) -> DataFrame:
    """NOT IN over a nullable list: one NULL among the barred, and no row is left."""
    spark = people.sparkSession
    return spark.sql("SELECT * FROM {people} p WHERE p." + key + " NOT IN (SELECT " + key + " FROM {barred})", people=people, barred=barred)


def candidates(rows: DataFrame, done: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows without a done row of their key."""
    return rows.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)


def stuck(rows: DataFrame, stage: str, transient: Sequence[str], stamp: str, as_of: Column, hours: int = 6) -> DataFrame:
    """Rows that have stood in a passing stage for longer than the hours, longest first."""
    return rows.where(F.col(stage).isin(*transient) & older_than(F.col(stamp), as_of, hours=hours)).orderBy(F.col(stamp).asc_nulls_last())


def fallback_wave(runs: DataFrame, siblings: DataFrame, source: str, most: int = 4) -> DataFrame:
    """Siblings to run after failed or barren sources, at most `most` for each, none that ran already."""
    barren = runs.where((F.col("status") == "failed") | (F.coalesce(F.col("found"), F.lit(0)) == 0)).select(F.col(source).alias("of"))
    offered = siblings.join(barren, "of").join(runs.select(F.col(source).alias("sibling")).distinct(), "sibling", "left_anti")
    from ledgerlark.operators.ranking import best_per

    return best_per(offered, "of", [F.col("tier"), F.col("sibling")], most)
