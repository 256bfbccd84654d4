"""Grouped and conditional aggregates. Partial aggregates run before every shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str | Column] = (), **more: Column) -> DataFrame:
    """Rows that meet each condition (NULL doesn't), with more aggregates, in one pass."""
    return df.groupBy(*by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()), *(c.alias(n) for n, c in more.items()))


def top_groups(df: DataFrame, key: Column, n: int | None = None, value: str = "value", at_least: int = 1) -> DataFrame:
    """Groups with their counts; with n the n largest in order, ties by value with NULL last (without n nothing is sorted)."""
    out = df.groupBy(key.alias(value)).agg(F.count("*").alias("count"))
    out = out.where(F.col("count") >= at_least) if at_least > 1 else out
    return out.orderBy(F.desc("count"), F.col(value).asc_nulls_last()).limit(n) if n else out


def or_unknown(*columns: Column) -> Column:
    """The first value that isn't blank, or 'unknown'."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns), F.lit("unknown"))


def exact_sum(c: Column, scale: int = 2) -> Column:
    """Sum in decimals, so that it doesn't depend on the order of rows."""
    return F.sum(c.cast(f"decimal(18,{scale})"))


def by_day(df: DataFrame, stamp: str, as_of: Column | None = None, days: int = 30) -> DataFrame:
    """Rows of each day as yyyy-MM-dd, of the last days before as_of where it is given."""
    kept = df if as_of is None else df.where(F.col(stamp) > as_of - F.make_dt_interval(days=F.lit(days)))
    return kept.groupBy(F.date_format(stamp, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def funnel(df: DataFrame, stage: str, path: Sequence[str]) -> DataFrame:
    """Rows of each stage of a path in its order and the share of the stage before, NULL where that is empty.

    All counts are in one row before the path is laid out, so no window runs over the data.
    """
    one = df.agg(*(F.count_if(F.col(stage) == s).alias(f"c{k}") for k, s in enumerate(path)))
    steps = []
    for k, s in enumerate(path):
        before = F.col(f"c{k - 1}") if k else F.lit(None).cast("long")
        share = F.round(F.try_divide(F.col(f"c{k}").cast("double"), F.nullif(before, F.lit(0)).cast("double")) * 100, 1)
        steps.append(F.struct(F.lit(k).alias("step"), F.lit(s).alias("stage"), F.col(f"c{k}").alias("count"), share.alias("conversion")))
    return one.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def usage_budget(df: DataFrame, provider: str, amount: str, limits: Mapping[str, float]) -> DataFrame:
    """Use against a limit by provider: used, remaining (not below 0) and percent (not above 100)."""
    limit = F.lit(None).cast("double")
    for name, most in limits.items():
        limit = F.when(F.col("provider") == name, F.lit(float(most))).otherwise(limit)
    out = df.groupBy(F.col(provider).alias("provider")).agg(F.count("*").alias("calls"), exact_sum(F.col(amount)).cast("double").alias("used")).withColumn("limit", limit)
    left, share = F.greatest(F.lit(0.0), F.col("limit") - F.col("used")), F.try_divide(F.col("used"), F.col("limit")) * 100
    return out.withColumns({"remaining": F.round(left, 2), "percent": F.round(F.least(F.lit(100.0), share), 1)})


def success_rate(df: DataFrame, by: str, good: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(good).alias("good")).withColumn("rate", F.round(F.try_divide(F.col("good").cast("double"), F.col("total").cast("double")) * 100, 1))


def sorted_distinct(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def coverage(df: DataFrame, key: str, role: str, email: Column, priority: Column) -> DataFrame:
    """Contacts and e-mails by entity, a count map by role and the best priority."""
    roles = df.where(F.col(role).isNotNull()).groupBy(key, role).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(role, "n")))).alias("by_role"))
    return df.groupBy(key).agg(F.count("*").alias("contacts"), F.count(email).alias("emails"), F.min(priority).alias("best_priority")).join(roles, key, "left")


def unpivot_counts(df: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """Counts by column and value in one pass, the top n of each column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    out = df.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL AND p.value <> ''").groupBy("p.dimension", "p.value").agg(F.count("*").alias("count"))
    if n is None:
        return out
    w = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def metrics_json(df: DataFrame, domain: str) -> DataFrame:
    """One row of aggregates as a snapshot row: the domain and its metrics as JSON."""
    return df.select(F.lit(domain).alias("domain"), F.to_json(F.struct("*")).alias("metrics"))
