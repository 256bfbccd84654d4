"""Whom to write to: one assessment for each record from its contacts, role and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import scoring as Z
from ledgerlark.functions.strings import present
from ledgerlark.operators.ranking import readiness_order


def assess(records: DataFrame, contacts: DataFrame, key: str, domain: str, freshness: Column, data_points: Column, completeness: Column) -> DataFrame:
    """key, name, score, priority, readiness, blocker, best_contact, reasons, ordered as a queue.

    contacts have key, contact_id, email, phone, linkedin, role, status and grade. They are reduced
    to one row a record by a partial aggregate before the join.
    """
    c = contacts.select(
        F.col(key),
        "contact_id",
        Z.locator_score(F.col("email"), F.col("phone"), F.col("linkedin"), F.col("status"), F.col("grade")).alias("points"),
        Z.role_weight(domain, F.lower(F.trim(F.col("role")))).alias("role_points"),
        F.lower(F.trim(F.col("role"))).alias("role"),
        F.coalesce(F.lower(F.col("status")).isin(*Z.VERIFIED) & (present(F.col("email")) | present(F.col("phone"))), F.lit(False)).alias("sure"),
    )
    top = F.max(F.when(F.col("points") > 0, F.struct("points", (-F.col("contact_id")).alias("o"), "contact_id"))).alias("top")
    best = c.groupBy(F.col(key).alias("_k")).agg(top, F.max(F.struct("role_points", "role")).alias("r"), F.count_if(F.col("points") > 0).alias("locators"), F.max("sure").alias("sure"))
    got = records.join(best, F.col(key) == F.col("_k"), "left")
    zero, none = F.lit(0), F.lit(False)
    points, role_points = F.coalesce(F.col("top.points"), zero), F.coalesce(F.col("r.role_points"), zero)
    score = F.greatest(zero, F.least(F.lit(100), points + role_points + freshness))
    inputs = (F.coalesce("sure", none), F.coalesce("locators", zero), completeness, data_points)
    got = got.withColumns({"score": score, "readiness": Z.readiness(*inputs), "blocker": Z.blocker(*inputs)})
    reasons = F.array_compact(F.array(F.when(points > 0, F.concat(F.lit("locator "), points.cast("string"))), F.when(role_points > 0, F.concat(F.lit("reaches "), F.replace(F.col("r.role"), F.lit("_"), F.lit(" ")))), F.when(freshness > 0, F.concat(F.lit("fresh "), freshness.cast("string")))))
    out = got.select(key, "name", "score", Z.priority(F.col("score"), F.col("readiness")).alias("priority"), "readiness", "blocker", F.col("top.contact_id").alias("best_contact"), F.slice(reasons, 1, 8).alias("reasons"))
    return out.orderBy(F.desc("score"), readiness_order(F.col("readiness")), F.lower("name"), key)


def reenrichment(records: DataFrame, runs: DataFrame, key: str, url: str, missing: Column, ready: str, seen: str, as_of: Column, stale_days: int, n: int, hours: int = 6) -> DataFrame:
    """Records with a URL that lack a contact, aren't ready or are stale, without a run in the last hours; the first n."""
    needs = missing | F.col(ready).isin("NEEDS_ENRICHMENT", "INSUFFICIENT_DATA") | (F.col(seen) < as_of - F.make_dt_interval(days=F.lit(stale_days)))
    late = runs.where(F.col("started_at") > as_of - F.make_dt_interval(hours=F.lit(hours))).select(key).distinct()
    return records.where(present(F.col(url)) & F.coalesce(needs, F.lit(False))).join(late, key, "left_anti").orderBy(F.col(seen).asc_nulls_first(), key).limit(n)


def window_dedup(known: DataFrame, new: DataFrame, key: str, seen: str, as_of: Column, days: int = 30) -> DataFrame:
    """new with outcome: refreshed within the days since a key was seen, reset beyond, inserted if it is new; repeated where it came before among the new."""
    last = known.groupBy(F.col(key).alias("_k")).agg(F.max(seen).alias("_seen"))
    first = new.groupBy(F.col(key).alias("_f")).agg(F.min("row").alias("_row"))
    got = new.join(last, F.col(key) == F.col("_k"), "left").join(first, F.col(key) == F.col("_f"))
    outcome = (
        F.when(F.col("row") > F.col("_row"), "repeated")
        .when(F.col("_seen").isNull(), "inserted")
        .when(F.col("_seen") > as_of - F.make_dt_interval(days=F.lit(days)), "refreshed")
        .otherwise("reset")
    )
    return got.select(*new.columns, outcome.alias("outcome"))


def chosen_sources(registry: DataFrame, name: str, job: list[str] | None, override: str | None, default: str) -> DataFrame:
    """Sources of a run: the job's, else the override's, else the default ones; unknown names don't count."""
    for names in (job, [x.strip() for x in (override or "").split(",") if x.strip()]):
        if names:
            picked = registry.where(F.col(name).isin(names))
            if not picked.isEmpty():
                return picked
    return registry.where(F.col(default))
