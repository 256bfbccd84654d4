"""Predicates built from optional parameters; they are plain columns, so they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.strings import like_escaped


def tristate(param: object) -> bool | None:
    """A flag parameter; None means that the filter isn't wanted."""
    word = str(param).strip().lower() if param is not None else ""
    return True if word in ("true", "1", "yes") else False if word in ("false", "0", "no") else None


def is_true(c: Column, wanted: bool | None) -> Column:
    """IS TRUE or IS NOT TRUE: NULL counts as not true."""
    return F.lit(True) if wanted is None else c.eqNullSafe(True) if wanted else ~c.eqNullSafe(True)


def contains_any(term: str, *columns: Column) -> Column:
    """Case-insensitive search of a term, in which % and _ mean themselves."""
    pattern = f"%{like_escaped(term)}%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.ilike(pattern), F.lit(False))
    return out


def starts_with(term: str, c: Column) -> Column:
    return F.coalesce(F.lower(c).startswith(term.lower()), F.lit(False))


def row_scope(user: str | None, assigned: Column, claimed: Column, pool: bool = False) -> Column:
    """Rows of a user; with pool also those nobody has."""
    if user is None:
        return F.lit(True)
    own = F.coalesce(assigned == user, F.lit(False)) | F.coalesce(claimed == user, F.lit(False))
    return own | (assigned.isNull() & claimed.isNull()) if pool else own


def ownership(kind: str, user: str | None, assigned: Column, claimed: Column) -> Column:
    return {
        "mine": F.coalesce(assigned == user, F.lit(False)) | F.coalesce(claimed == user, F.lit(False)),
        "unclaimed": claimed.isNull(),
        "claimed": claimed.isNotNull(),
        "assigned": assigned.isNotNull(),
    }[kind]


def contact_depth(kind: str, name: Column, email: Column, status: Column) -> Column:
    """none, partial (a name or an address), enriched (both) or verified."""
    has_name, has_mail = (F.coalesce(c, F.lit("")) != "" for c in (name, email))
    return {"none": ~has_name & ~has_mail, "partial": has_name != has_mail, "enriched": has_name & has_mail, "verified": F.coalesce(status == "valid", F.lit(False))}[kind]


def experience(bucket: str, c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    if bucket == "fresher":
        return text.rlike(r"^\s*0(\s*-|\s*to)") | text.contains("fresher") | text.contains("entry") | text.contains("intern")
    return text == bucket.lower()


def registration(state: str, start: Column, deadline: Column, as_of: Column, soon_days: int = 14) -> Column:
    soon = as_of + F.make_dt_interval(days=F.lit(soon_days))
    return {
        "open": (deadline >= as_of) & F.coalesce(start <= as_of, F.lit(True)),
        "closing_soon": deadline.between(as_of, soon),
        "closed": deadline < as_of,
        "upcoming": start > as_of,
    }[state]


#: States of an event that nobody has announced.
PREDICTED = ("PREDICTED", "LOW_CONFIDENCE_PREDICTION", "RECURRING_PATTERN")


def in_month(month: int | None, *dates: Column) -> Column:
    """The month of the first date that is there."""
    return F.lit(True) if month is None else F.month(F.coalesce(*dates)) == month


def has_pay(wanted: bool | None, least: Column, text: Column) -> Column:
    some = least.isNotNull() | (F.coalesce(text, F.lit("")) != "")
    return F.lit(True) if wanted is None else some if wanted else ~some


def predicted(wanted: bool | None, status: Column) -> Column:
    """IN or NOT IN the predicted states: a NULL status is in neither list."""
    return F.lit(True) if wanted is None else status.isin(*PREDICTED) if wanted else ~status.isin(*PREDICTED)


def not_deleted(active: Column) -> Column:
    """IS NOT FALSE: NULL counts as active."""
    return ~active.eqNullSafe(False)


def has_json_key(c: Column, key: str) -> Column:
    """Whether a JSON object has a key, its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def contains_as_written(term: str, *columns: Column) -> Column:
    """Case-insensitive search in which % and _ of the term are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.ilike(f"%{term}%"), F.lit(False))
    return out


@dataclass
class RowFilter:
    """Equality, range, date and search parameters over named columns; those left out don't filter."""

    equal: dict[str, object] = field(default_factory=dict)
    one_of: dict[str, list] = field(default_factory=dict)
    at_least: dict[str, object] = field(default_factory=dict)
    at_most: dict[str, object] = field(default_factory=dict)
    flags: dict[str, object] = field(default_factory=dict)
    search: str | None = None
    search_in: tuple[str, ...] = ()

    def column(self) -> Column:
        out = F.lit(True)
        for n, v in self.equal.items():
            out = out if v is None else out & (F.col(n) == v)
        for n, v in self.one_of.items():
            out = out if not v else out & F.col(n).isin(v)
        for n, v in self.at_least.items():
            out = out if v is None else out & (F.col(n) >= v)
        for n, v in self.at_most.items():
            out = out if v is None else out & (F.col(n) <= v)
        for n, v in self.flags.items():
            out = out & is_true(F.col(n), tristate(v))
        if self.search:
            out = out & contains_any(self.search, *(F.col(c) for c in self.search_in))
        return out
