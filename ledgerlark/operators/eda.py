"""Figures of a whole domain in one pass: every row becomes (metric, value, amount) entries, which are summed map-side.

The answer is long: metric, value, n (a count, or the figure of a metric without values) and rank (place in its metric, by
count and then by value). Facets have their `top` values only, the short lists have all of theirs. A metric that nothing was
counted for is 0, so an empty table gives zeros, and averages are NULL there. Blank values are counted under '', NULL
and empty ones not at all. No clock is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prize buckets by their lowest and highest amount, and roles that mean placement.
PRIZE_BUCKETS = (("no_prize", 0, 0), ("under_50k", 1, 50_000), ("50k_to_2L", 50_001, 200_000), ("2L_to_5L", 200_001, 500_000), ("above_5L", 500_001, None))
PLACEMENT_ROLES = ("tpo", "placement_head", "placement_cell")
GUESSED = ("PREDICTED", "LOW_CONFIDENCE_PREDICTION", "RECURRING_PATTERN")
EVENT_FACETS = {"by_state": "state", "by_city": "city", "by_organizer": "organizer_name", "by_technology": "technology", "by_domain": "domain", "by_source": "source_platform"}
EVENT_LISTS = {"by_mode": "mode", "by_status": "status"}
COLLEGE_FACETS = {"by_state": "state", "by_district": "district", "by_city": "city"}
COLLEGE_LISTS = {"by_type": "institution_type", "by_ownership": "ownership", "by_accreditation": "accreditation", "by_naac_grade": "naac_grade", "by_enrichment_status": "enrichment_status", "by_outreach_readiness": "outreach_readiness"}


def _entry(metric: str, when: Column, value: Column | None = None, amount: Column | None = None) -> Column:
    shape = "struct<metric: string, value: string, amount: decimal(18,2)>"
    told = F.struct(F.lit(metric), F.lit("") if value is None else value, F.lit(None) if amount is None else amount)
    return F.when(F.coalesce(when, F.lit(False)), told.cast(shape))


def _facets(names: Mapping[str, str]) -> list[Column]:
    return [_entry(metric, F.col(c).cast("string") != "", F.trim(F.col(c).cast("string"))) for metric, c in names.items()]


def _counted(rows: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """metric, value, n, amount (summed) and amounts (how many) of the entries."""
    each = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return each.groupBy("metric", "value").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.count("amount").alias("amounts"))


def _answer(counted: DataFrame, single: Sequence[tuple[str, str]], averages: Mapping[str, int], top: Mapping[str, int]) -> DataFrame:
    """The long answer: single metrics even if they are 0, averages with so many digits, at most `top` values of a facet."""
    spark = counted.sparkSession
    asked = spark.createDataFrame([(m, v) for m, v in single], "metric string, value string")
    zero = F.lit(0).cast("long")
    got = asked.join(counted, ["metric", "value"], "full").withColumns({"n": F.coalesce("n", zero), "amounts": F.coalesce("amounts", zero)})
    figure = F.col("n").cast("double")
    for metric, digits in averages.items():
        mean = F.when(F.col("amounts") > 0, F.round((F.col("amount") / F.col("amounts")).cast("decimal(28,6)"), digits).cast("double"))
        figure = F.when(F.col("metric") == metric, mean).otherwise(figure)
    ranked = got.select("metric", "value", figure.alias("n"), F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "value")).alias("rank"))
    kept = F.lit(True)
    for metric, most in top.items():
        kept = kept & ((F.col("metric") != metric) | (F.col("rank") <= most))
    return ranked.where(kept)


def event_figures(events: DataFrame, as_of: Column, top: int = 15) -> DataFrame:
    """Figures of events.

    Columns: name, organizer_name, event_start, registration_start, registration_deadline, state, city, mode, technology, domain, prize_pool,
    student_only, college_only, open_to_public, hiring_opportunities, internship_opportunities, source_platform, status, occurrence_type.
    """
    start, prize = F.coalesce("event_start", "registration_start"), F.col("prize_pool")
    status = F.upper(F.coalesce("status", F.lit("")))
    past, guessed = status == "HISTORICAL", status.isin(*GUESSED)
    plain, deadline = ~past & ~guessed, F.col("registration_deadline")
    bucket = F.lit(None).cast("string")
    for name, low, high in reversed(PRIZE_BUCKETS):
        bucket = F.when((prize >= low) & (F.lit(True) if high is None else prize <= high), name).otherwise(bucket)
    flags = {"student_only": "student_only", "college_only": "college_only", "open_to_public": "open_to_public", "hiring_linked": "hiring_opportunities", "internship_linked": "internship_opportunities"}
    single = {
        "total": F.lit(True), "upcoming": plain & (F.col("event_start") >= as_of), "registration_open": plain & (deadline >= as_of), "registration_closing_soon": plain & (deadline >= as_of) & (deadline <= as_of + F.make_dt_interval(days=F.lit(14))),
        "historical": past, "predicted": guessed, "recurring_hackathons": F.col("occurrence_type") == "recurring",
    }
    single |= {metric: F.col(c) for metric, c in flags.items()}
    entries = [_entry(metric, when) for metric, when in single.items()]
    entries += [_entry("average_prize_pool", F.lit(True), None, prize), _entry("prize_buckets", F.lit(True), F.when(prize.isNull(), "unknown").otherwise(F.coalesce(bucket, F.lit("between"))))]
    entries += [_entry("by_month", start.isNotNull(), F.month(start).cast("string")), _entry("by_year", start.isNotNull(), F.year(start).cast("string"))]
    counted = _counted(events, [*entries, *_facets(EVENT_FACETS), *_facets(EVENT_LISTS)])
    again = counted.where((F.col("metric") == "by_organizer") & (F.col("n") >= 2)).agg(F.count("*").alias("n"))
    nothing = F.lit(None).cast("decimal(28,2)")
    counted = counted.where(~((F.col("metric") == "prize_buckets") & (F.col("value") == "between"))).unionByName(again.select(F.lit("recurring_organizers").alias("metric"), F.lit("").alias("value"), "n", nothing.alias("amount"), F.lit(0).cast("long").alias("amounts")))
    asked = [(m, "") for m in [*single, "average_prize_pool", "recurring_organizers"]] + [("prize_buckets", b) for b, *_ in PRIZE_BUCKETS] + [("prize_buckets", "unknown")]
    return _answer(counted, asked, {"average_prize_pool": 2}, dict.fromkeys(EVENT_FACETS, top))


def college_figures(colleges: DataFrame, contacts: DataFrame, key: str = "id", of: str = "college_id", top: int = 20, top_states: int = 40) -> DataFrame:
    """Figures of institutions and their contacts (of, role_category, email, phone).

    Columns: key, state, district, city, institution_type, ownership, accreditation, naac_grade, enrichment_status, outreach_readiness, website_url,
    official_email, phone, tpo_name, tpo_email, principal_name, director_name, dean_name, nirf_rank, completeness_score, source_urls (an array).
    Contacts of no institution, or of a NULL one, aren't counted.
    """

    def said(c: str) -> Column:
        return F.col(c).cast("string") != ""

    single = {
        "total": F.lit(True), "with_website": said("website_url"), "with_official_email": said("official_email"), "with_phone": said("phone"),
        "tpo_coverage": F.coalesce(said("tpo_name"), F.lit(False)) | F.coalesce(said("tpo_email"), F.lit(False)), "principal_coverage": said("principal_name"), "director_coverage": said("director_name"),
        "dean_coverage": said("dean_name"), "nirf_ranked": F.col("nirf_rank") != 0,
    }
    entries = [_entry(m, when) for m, when in single.items()] + [_entry("average_completeness", F.lit(True), None, F.col("completeness_score"))]
    counted = _counted(colleges, [*entries, *_facets(COLLEGE_FACETS), *_facets(COLLEGE_LISTS)])
    host = F.substring_index(F.substring_index("url", "//", -1), "/", 1)
    hosts = colleges.select(F.explode("source_urls").alias("url")).where("url <> ''").groupBy(host.alias("value")).agg(F.count("*").alias("n"))
    each = contacts.groupBy(F.col(of).alias(key)).agg(F.count("*").alias("k"), F.count_if(F.col("role_category").isin(*PLACEMENT_ROLES)).alias("p"), F.count("email").alias("e"), F.count("phone").alias("t"))
    own = colleges.select(key).join(each, key)
    sums = own.agg(F.sum("k").alias("contacts_total"), F.count("*").alias("colleges_with_contacts"), F.count_if(F.col("p") > 0).alias("colleges_with_tpo_role"), F.sum("e").alias("contact_emails"), F.sum("t").alias("contact_phones"))
    nothing, none = F.lit(None).cast("decimal(28,2)"), F.lit(0).cast("long")

    def rows(df: DataFrame, metric: Column, value: Column, n: Column, amount: Column = nothing, amounts: Column = none) -> DataFrame:
        return df.select(metric.alias("metric"), value.alias("value"), F.coalesce(n, none).alias("n"), amount.cast("decimal(28,2)").alias("amount"), amounts.alias("amounts"))

    names = sums.columns
    by_contact = sums.unpivot([], names, "metric", "n")
    covered = counted.where(F.col("metric").isin("by_state", "by_district")).groupBy("metric").agg(F.count("*").alias("n"))
    covered = rows(covered, F.when(F.col("metric") == "by_state", "states_covered").otherwise("districts_covered"), F.lit(""), F.col("n"))
    total = colleges.agg(F.count("*").alias("all"))
    percent = sums.crossJoin(total)  # a row each
    share = rows(percent, F.lit("placement_role_coverage_pct"), F.lit(""), none, F.col("colleges_with_tpo_role") * 100, F.col("all"))
    mean = rows(percent, F.lit("average_contacts_per_college"), F.lit(""), none, F.coalesce("contacts_total", none), F.col("all"))
    counted = counted.unionByName(rows(hosts, F.lit("by_source"), F.col("value"), F.col("n"))).unionByName(rows(by_contact, F.col("metric"), F.lit(""), F.col("n"))).unionByName(covered).unionByName(share).unionByName(mean)
    asked = [(m, "") for m in [*single, "average_completeness", "states_covered", "districts_covered", *names, "placement_role_coverage_pct", "average_contacts_per_college"]]
    return _answer(counted, asked, {"average_completeness": 1, "placement_role_coverage_pct": 1, "average_contacts_per_college": 2}, dict.fromkeys([*COLLEGE_FACETS, "by_source"], top) | {"by_state": top_states})


def as_snapshot(figures: DataFrame, domain: str) -> DataFrame:
    """One row: the domain and its figures as JSON, a number or a list of (value, count) for each metric."""
    lists = figures.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("of"))
    return lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.transform("of", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("of")))))).alias("metrics")).select(F.lit(domain).alias("domain"), "metrics")
