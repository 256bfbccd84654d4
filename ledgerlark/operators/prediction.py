"""Recurrence of yearly events from their history, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_share(values: Column) -> Column:
    """Share of an array's values that equal its most frequent one, 0 for an empty array."""
    counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)))
    return F.when(F.size(values) == 0, 0.0).otherwise(F.array_max(counts) / F.size(values))


def middle(values: Column) -> Column:
    """Median of an array of whole numbers, cut to a whole number; NULL for an empty one."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, F.floor((low + high) / 2).cast("int"))


def recurrence(df: DataFrame, key: str, year: Column, start: Column) -> DataFrame:
    """One row for each key with at least two years: interval, month, day, confidence, status and the predicted date.

    The date is only there for PREDICTED rows; raw_date has it for all that have a month. A key's
    history is one small array, collected after a partial aggregation.
    """
    rows = df.select(F.col(key), year.cast("int").alias("y"), start.alias("s")).where("y IS NOT NULL")
    got = rows.groupBy(key).agg(
        F.count("*").cast("int").alias("observations"),
        F.array_sort(F.collect_set("y")).alias("years"),
        F.array_sort(F.collect_list(F.month("s"))).alias("months"),
        F.array_sort(F.collect_list(F.dayofmonth("s"))).alias("days"),
    )
    got = got.where((F.col("observations") >= 2) & (F.size("years") >= 2))
    gaps = F.transform(F.sequence(F.lit(2), F.size("years")), lambda i: F.element_at("years", i) - F.element_at("years", i - 1))
    got = got.withColumn("gaps", gaps)
    got = got.withColumns({"interval": middle(F.col("gaps")), "month": middle(F.col("months")), "day": F.coalesce(middle(F.col("days")), F.lit(15)), "month_share": mode_share(F.col("months")), "gap_share": mode_share(F.col("gaps"))})
    recurring = (F.col("interval") >= 1) & (F.col("gap_share") >= 0.5)
    points = (
        F.lit(35)
        + 15 * (F.col("observations") - 2)
        + F.when(F.col("month_share") >= 0.8, 15).when(F.col("month_share") >= 0.5, 7).otherwise(0)
        + F.when(F.forall("gaps", lambda g: g == 1), 10).otherwise(0)
        - F.when(recurring, 0).otherwise(20)
    )
    got = got.withColumn("confidence", F.greatest(F.lit(10), F.least(F.lit(90), points)).cast("int"))
    status = F.when(~recurring, "LOW_CONFIDENCE_PREDICTION").when((F.col("observations") >= 3) & (F.col("confidence") >= 60), "PREDICTED").otherwise("RECURRING_PATTERN")
    following = F.element_at("years", -1) + F.greatest(F.col("interval"), F.lit(1))
    date = F.when(F.col("month").isNotNull(), F.make_date(following, "month", F.least(F.col("day"), F.lit(28))))
    got = got.withColumns({"status": status, "next_year": following, "raw_date": date})
    return got.withColumn("predicted_date", F.when(F.col("status") == "PREDICTED", F.col("raw_date"))).drop("days", "month_share", "gap_share")


def cycle(df: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Next yearly window of a key with at least two dated observations."""
    got = df.where(stamp.isNotNull()).groupBy(key).agg(F.count("*").cast("int").alias("observations"), F.max(F.year(stamp)).alias("last_year"), F.collect_list(F.month(stamp)).alias("months"))
    got = got.where(F.col("observations") >= 2)
    sure = F.least(F.lit(85), F.lit(30) + 15 * (F.col("observations") - 2) + F.floor(mode_share(F.col("months")) * 20)).cast("int")
    got = got.select(key, "observations", (F.col("last_year") + 1).alias("next_year"), middle(F.col("months")).alias("month"), sure.alias("confidence"))
    return got.withColumn("status", F.when(F.col("confidence") >= 55, "PREDICTED").otherwise("LOW_CONFIDENCE_PREDICTION"))
