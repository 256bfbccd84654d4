"""Dates from messy text, and ages against an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date patterns in the order they are tried; month-only ones give the first of the month.
FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "MMMM yyyy", "MMM yyyy",
)
#: Days of a relative unit, seconds below a day.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}
#: Ages in days up to which a record is fresh, recent, aging.
WINDOWS = {"jobs": (1, 7, 30), "hackathons": (14, 45, 120), "colleges": (90, 180, 365)}


def parse_datetime(c: Column) -> Column:
    """A timestamp from an epoch in seconds or milliseconds or one of FORMATS; NULL otherwise."""
    text = F.trim(c)
    number = text.try_cast("double")
    epoch = F.when(text.rlike(r"^[0-9]{9,14}$"), F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number)))
    undated = F.regexp_replace(text, r"^[A-Za-z]{3},\s+", "")  # a weekday says nothing new
    worded = F.coalesce(*(F.try_to_timestamp(undated, F.lit(f)) for f in FORMATS))
    return F.coalesce(epoch, worded)


def posted_at(c: Column, as_of: Column) -> Column:
    """parse_datetime(), or as_of less what '3 days ago' says (a month is 30 days, a year 365)."""
    n = F.regexp_extract(F.lower(c), r"([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s*ago", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(c), r"([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s*ago", 2)
    seconds = F.lit(None).cast("long")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, n * size).otherwise(seconds)
    ago = F.timestamp_seconds(F.unix_timestamp(as_of) - seconds)
    return F.coalesce(F.when(n.isNotNull(), ago), parse_datetime(c))


def date_range(c: Column) -> dict[str, Column]:
    """start and end of a written period; a left side without a year takes the right side's; swapped if in the wrong order."""
    text = F.trim(c)
    open_end = F.lower(text).rlike(r"\b(ongoing|rolling|tba|to be announced|n/?a)\b")
    parts = F.split(F.regexp_replace(text, r"\s*(→|–|—|\s+to\s+|\s+until\s+|\s+-\s+)\s*", "\u0001"), "\u0001")
    left, right = F.trim(F.try_element_at(parts, F.lit(1))), F.trim(F.try_element_at(parts, F.lit(2)))
    year = F.regexp_extract(F.coalesce(right, F.lit("")), "([0-9]{4})", 1)
    bare = left.rlike(r"^[A-Za-z]{3,9}\s+[0-9]{1,2}$") & (year != "")
    monthly = right.rlike(r"^[A-Za-z]{3,9}\s+[0-9]{4}$")
    none = F.lit(None).cast("timestamp")
    # One-element lists bind what is used more than once: written out, the formats would repeat a hundred times.
    sides = F.transform(F.array(F.when(bare, F.concat(left, F.lit(", "), year)), left, right), parse_datetime)
    pair = F.transform(F.array(sides), lambda p: F.struct(F.coalesce(p[0], p[1]).alias("a"), F.when(monthly, F.last_day(p[2]).cast("timestamp")).otherwise(p[2]).alias("b")))
    got = F.get(F.transform(pair, lambda p: F.struct(F.when(p["b"] < p["a"], p["b"]).otherwise(p["a"]).alias("start"), F.when(p["b"] < p["a"], p["a"]).otherwise(p["b"]).alias("end"))), F.lit(0))
    return {"start": F.when(open_end, none).otherwise(got["start"]), "end": F.when(open_end, none).otherwise(got["end"])}


def posting_freshness(posted: Column, as_of: Column) -> Column:
    """fresh within a day (or in the future), recent within a week, else older; unknown without a date."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(posted)
    return F.when(age < 86_400, "fresh").when(age < 7 * 86_400, "recent").when(age.isNull(), "unknown").otherwise("older")


def record_freshness(domain: str, as_of: Column, *stamps: Column) -> Column:
    """fresh, recent, aging or stale by the latest stamp and the domain's windows, bounds included."""
    latest = F.greatest(*stamps) if len(stamps) > 1 else stamps[0]
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(latest)) / 86_400.0
    fresh, recent, aging = WINDOWS[domain]
    return F.when(age.isNull(), "unknown").when(age <= fresh, "fresh").when(age <= recent, "recent").when(age <= aging, "aging").otherwise("stale")


def relative_age(stamp: Column, as_of: Column) -> Column:
    """'5m ago', '30h ago' below two days, '3d ago'."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(stamp)
    return (
        F.when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 48 * 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86_400).cast("string"), F.lit("d ago")))
    )


def is_stale(checked: Column, as_of: Column, days: int = 30) -> Column:
    return F.coalesce(checked < as_of - F.make_interval(days=F.lit(days)), F.lit(True))
