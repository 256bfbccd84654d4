"""Amounts of money from messy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What units multiply by.
UNITS = {"lakh": 1e5, "lakhs": 1e5, "lpa": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "cr": 1e7, "million": 1e6, "mn": 1e6, "k": 1e3, "thousand": 1e3}
_UNIT = "lakhs|lakh|lpa|lacs|lac|crore|cr|thousand|k|million|mn"


def parse_money(c: Column) -> Column:
    """The first number with its unit; a bare number as it is; NULL without one above 0."""
    text = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    amount = F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})?", 1)
    unit = F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})?", 2)
    times = F.lit(1.0)
    for factor in sorted(set(UNITS.values())):
        times = F.when(unit.isin(*(u for u, f in UNITS.items() if f == factor)), F.lit(factor)).otherwise(times)
    value = amount.try_cast("double") * times
    return F.when(value > 0, value)


def salary_bounds(c: Column) -> dict[str, Column]:
    """low, high, currency and period of a written salary.

    Lakhs and crores scale both ends; rupees up to 500 without a unit are lakhs. A pair with an end
    below 1000 is no salary. Ends in the wrong order are swapped.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k\b)?"), F.lit(0)), lambda x: F.regexp_replace(x, r"[,\s]", ""))
    values = F.transform(found, lambda x: F.when(x.endswith("k"), F.regexp_replace(x, "k$", "").try_cast("double") * 1000).otherwise(x.try_cast("double")))
    rupees = text.contains("₹") | text.rlike(r"\brs\b|\brs\.|\binr\b")
    scale = (
        F.when(text.rlike("lakh|lpa| lac"), 1e5)
        .when(text.rlike("crore|cpa"), 1e7)
        .when(rupees & (F.array_max(values) <= 500), 1e5)
        .otherwise(1.0)
    )
    a, b = F.try_element_at(values, F.lit(1)) * scale, F.try_element_at(values, F.lit(-1)) * scale
    fine = (a >= 1000) & (b >= 1000)
    currency = F.when(rupees, "INR").when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP").otherwise("")
    period = F.when(text.rlike("month|/mo"), "month").when(text.rlike(r"year|annum|lpa|p\.a"), "year").otherwise("")
    return {"low": F.when(fine, F.least(a, b)), "high": F.when(fine, F.greatest(a, b)), "currency": currency, "period": period}


def prize_bucket(amount: Column) -> Column:
    """Half-open buckets of prize money."""
    return (
        F.when(amount.isNull(), "unknown")
        .when(amount <= 50_000, "under_50k")
        .when(amount <= 200_000, "50k_to_2L")
        .when(amount <= 500_000, "2L_to_5L")
        .otherwise("above_5L")
    )


#: Words and signs that tell that a number near them is pay.
PAY_ANCHOR = r"(?:salary|salaries|ctc|stipend|package|pay|comp|compensation|lpa|per\s+annum|p\.a\.|₹|rs\.?|\$|€|£|inr|usd)"
_PAY_UNIT = r"(lpa|lakhs?|lacs?|crore|cr|k)?"


def inline_pay(c: Column) -> dict[str, Column]:
    """low and high of pay written in running text, within a few words of a sign or word for pay.

    A unit behind the last number holds for both; amounts below 1000 are durations, not pay.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    money = r"(?:₹|rs\.?\s*|\$|€|£|inr\s*)?\s*"
    span = rf"([0-9]+(?:[.,][0-9]+)*)\s*{_PAY_UNIT}\s*(?:-|–|—|\bto\b)\s*{money}([0-9]+(?:[.,][0-9]+)*)\s*{_PAY_UNIT}"
    before, behind = rf"{PAY_ANCHOR}.{{0,60}}?{span}", rf"{span}.{{0,30}}?{PAY_ANCHOR}"

    def part(k: int) -> Column:
        a, b = F.regexp_extract(text, before, k), F.regexp_extract(text, behind, k)
        return F.when(text.rlike(before), a).otherwise(b)

    unit_of = F.when(part(4) != "", part(4)).otherwise(part(2))

    def value(number: Column, unit: Column) -> Column:
        own = F.when(unit != "", unit).otherwise(unit_of)
        times = F.when(own.rlike("^(lpa|lakh|lac)"), 1e5).when(own.rlike("^cr"), 1e7).when(own == "k", 1e3).otherwise(1.0)
        return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * times

    a, b = value(part(1), part(2)), value(part(3), part(4))
    fine = F.least(a, b) >= 1000
    return {"low": F.when(fine, F.least(a, b)), "high": F.when(fine, F.greatest(a, b))}
