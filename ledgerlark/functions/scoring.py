"""Rule scores of leads, contacts and records as column expressions.

Every weight stands in one table; scores are sums of `when`s, so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.strings import is_role_address, present, sendable_phone

#: Points of a lead's parts, the aliases a settings form uses, and the bands.
LEAD_WEIGHTS = {"hr_name": 20, "hr_contact": 25, "hr_linkedin": 15, "company_contact": 10, "job_quality": 10, "email_verified": 10, "whatsapp_verified": 10}
WEIGHT_ALIASES = {"hr_name_found": "hr_name", "hr_personal_contact": "hr_contact", "hr_linkedin_found": "hr_linkedin", "company_official_contact": "company_contact", "job_description_quality": "job_quality"}
#: Points of a contact's locators and roles, by domain.
LOCATORS = {"verified_person_email": 40, "verified_role_email": 30, "verified_phone": 30, "unverified_email": 12, "unverified_phone": 10, "linkedin": 15}
ROLES = {
    "colleges": {"tpo": 30, "placement_head": 28, "placement_cell": 22, "director": 18, "principal": 16, "dean": 12, "hod": 10, "official": 8, "faculty": 6, "other": 4},
    "hackathons": {"organizer": 30, "outreach": 26, "sponsor": 18, "judge": 8},
    "jobs": {"hr": 30, "recruiter": 26, "hiring_manager": 22, "other": 6},
}
#: Words of a job title that tell a role, in the order they are looked for.
TITLE_ROLES = (
    ("recruiter", ("recruit", "talent acquisition", "sourcer", "staffing")),
    ("hr", ("hr ", "hr/", "human resource", "people ops", "people partner", "hr business", "chro")),
    ("hiring_manager", ("hiring manager", "engineering manager", "head of", "director", "vp ", "vice president", "founder", "cto", "ceo", "team lead", "manager")),
)
VERIFIED = ("verified", "cross_verified")
DEAD = ("failed", "undeliverable", "invalid", "bounced")
#: Weights of the fields that make a record complete, by domain.
FIELDS = {
    "hackathons": {"name": 5, "hackathon_url": 5, "organizer_name": 4, "event_start": 3, "registration_deadline": 3, "mode": 2, "city": 1, "state": 2, "prize_pool": 2, "technology": 2, "domain": 1, "eligibility": 2, "contact_email": 5, "contact_name": 5, "contact_linkedin": 4, "organizer_email": 4, "contact_phone": 3},
    "colleges": {"name": 5, "state": 4, "city": 3, "district": 3, "website_url": 4, "official_email": 4, "phone": 3, "university_affiliation": 2, "institution_type": 2, "ownership": 2, "aishe_code": 3, "accreditation": 2, "placement_contact": 3, "tpo_name": 5, "tpo_email": 5, "tpo_phone": 4, "principal_name": 4, "director_name": 3, "dean_name": 3},
}
#: Priorities of roles, best first.
ROLE_PRIORITY = {
    "colleges": {"tpo": "P0", "placement_head": "P0", "placement_cell": "P0", "director": "P1", "principal": "P1", "dean": "P2", "hod": "P2", "faculty": "P3", "official": "P3"},
    "hackathons": {"outreach": "P0", "organizer": "P1", "sponsor": "P2", "judge": "P3"},
}


def _sum(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _points(condition: Column, points: int | Column) -> Column:
    return F.when(condition, points).otherwise(0)


def lead_weights(given: Mapping[str, float] | None = None) -> dict[str, int]:
    """The weights with those given (or by alias) in their place, whole and within 0 to 100."""
    out = dict(LEAD_WEIGHTS)
    for name, value in (given or {}).items():
        name = WEIGHT_ALIASES.get(name, name)
        if name in out and isinstance(value, (int, float)) and value == value:
            out[name] = max(0, min(100, int(value + 0.5)))
    return out


def lead_parts(columns: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Points of each part of a lead; columns by the names of a lead's fields."""
    w, c = lead_weights(weights), columns
    unit = w["job_quality"] / 10
    quality = _sum(
        _points(present(c["salary_range"]), int(3 * unit + 0.5)),
        _points(F.length(F.coalesce(c["job_description"], F.lit(""))) > 100, int(4 * unit + 0.5)),
        _points(present(c["job_url"]), int(3 * unit + 0.5)),
    )
    return {
        "hr_name": _points(present(c["hr_name"]), w["hr_name"]),
        "hr_contact": _points(present(c["hr_personal_email"]) | present(c["hr_personal_mobile"]), w["hr_contact"]),
        "hr_linkedin": _points(present(c["hr_linkedin_url"]), w["hr_linkedin"]),
        "company_contact": _points(present(c["company_default_email"]) | present(c["company_default_phone"]), w["company_contact"]),
        "job_quality": F.least(quality, F.lit(w["job_quality"])),
        "email_verified": _points(F.coalesce(c["email_status"] == "valid", F.lit(False)), w["email_verified"]),
        "whatsapp_verified": _points(F.coalesce(c["whatsapp_status"] == "registered", F.lit(False)), w["whatsapp_verified"]),
    }


def lead_score(columns: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    return _sum(*lead_parts(columns, weights).values())


def breakdown(parts: Mapping[str, Column]) -> Column:
    """Map of the parts that have points."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "hot").when(score >= 40, "warm").otherwise("cold")


def score_10(score: Column) -> Column:
    """1 to 10, halves up."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.round(score / 10))).cast("int")


def title_role(title: Column) -> Column:
    text = F.lower(F.trim(title))
    out = F.when(F.coalesce(text, F.lit("")) == "", "")
    for role, needles in TITLE_ROLES:
        hit = text.contains(needles[0])
        for n in needles[1:]:
            hit = hit | text.contains(n)
        out = out.when(hit, role)
    return out.otherwise("other")


def role_weight(domain: str, role: Column) -> Column:
    out = F.lit(0)
    for name, points in ROLES[domain].items():
        out = F.when(role == name, points).otherwise(out)
    return out


def role_priority(domain: str, role: Column) -> Column:
    out = F.lit("P4")
    for name, p in ROLE_PRIORITY[domain].items():
        out = F.when(F.lower(F.trim(role)) == name, p).otherwise(out)
    return out


def locator_score(email: Column, phone: Column, linkedin: Column, status: Column, grade: Column) -> Column:
    """What a contact can be reached by and how far it is trusted; 0 for locators that failed."""
    state = F.lower(F.coalesce(status, F.lit("unverified")))
    sure, mark = state.isin(*VERIFIED), F.left(F.upper(F.coalesce(grade, F.lit(""))), F.lit(1))
    by_mail = F.when(~present(email), 0).when(sure & is_role_address(email), LOCATORS["verified_role_email"]).when(sure, LOCATORS["verified_person_email"]).otherwise(LOCATORS["unverified_email"])
    by_phone = F.when(present(phone) & sendable_phone(phone), F.when(sure, LOCATORS["verified_phone"]).otherwise(LOCATORS["unverified_phone"])).otherwise(0)
    total = by_mail + by_phone + _points(present(linkedin), LOCATORS["linkedin"]) + F.when(mark == "A", 6).when(mark == "B", 3).otherwise(0)
    return F.when(state.isin(*DEAD), 0).otherwise(total)


def job_freshness_points(age_days: Column) -> Column:
    return F.when(age_days <= 3, 20).when(age_days <= 14, 14).when(age_days <= 45, 8).otherwise(0)


def event_freshness_points(days_to_deadline: Column, days_to_start: Column, occurrence: Column) -> Column:
    return (
        F.when((days_to_deadline >= 0) & (days_to_deadline <= 14), 22)
        .when((days_to_deadline >= 0) & (days_to_deadline <= 45), 14)
        .when(days_to_deadline >= 0, 8)
        .when(days_to_start >= 0, 6)
        .when(F.upper(occurrence).rlike("PREDICTED|RECURRING"), 2)
        .otherwise(0)
    )


def season_points(month: Column) -> Column:
    return F.when(month.between(7, 12), 12).when(month.between(4, 6), 8).otherwise(4)


def readiness(verified: Column, locators: Column, completeness: Column, data_points: Column) -> Column:
    return (
        F.when(verified & (locators >= 1) & (data_points >= 1), "OUTREACH_READY")
        .when(locators >= 1, "PARTIALLY_ENRICHED")
        .when(completeness >= 30, "NEEDS_ENRICHMENT")
        .otherwise("INSUFFICIENT_DATA")
    )


def blocker(verified: Column, locators: Column, completeness: Column, data_points: Column) -> Column:
    """What keeps a lead from being ready, NULL if nothing does."""
    return (
        F.when(verified & (locators >= 1) & (data_points >= 1), F.lit(None).cast("string"))
        .when(verified & (locators >= 1), "thin record")
        .when(locators >= 1, "locator not verified")
        .when(completeness >= 30, "no reachable contact")
        .otherwise("almost nothing known")
    )


def priority(score: Column, ready: Column) -> Column:
    reachable = ready.isin("OUTREACH_READY", "PARTIALLY_ENRICHED")
    return F.when(~reachable, F.when(score < 25, "P4").otherwise("P3")).when(score >= 75, "P0").when(score >= 58, "P1").when(score >= 40, "P2").otherwise("P3")


def completeness(fields: Mapping[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """Score in hundredths, halves to even, and the array of missing fields, from (presence, weight) by name."""
    total = sum(w for _, w in fields.values())
    earned = _sum(*(_points(c, w) for c, w in fields.values()))
    missing = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, (c, _) in fields.items())), lambda x: x.isNotNull())
    return F.bround(earned / total * 100).cast("int"), missing


def verification_score(status: Column, grade: Column, sources: Column) -> Column:
    state, mark = F.lower(status), F.left(F.upper(F.coalesce(grade, F.lit(""))), F.lit(1))
    base = F.when(state.isin(*VERIFIED), 100).when(state == "partially_verified", 70).when(state.isin("unverified", "not_verified"), 20).when(state == "failed", 0).otherwise(10)
    graded = F.least(F.lit(100), base + F.when(mark == "A", 5).when(mark == "C", -10).otherwise(0))
    more = F.when(sources >= 3, 10).when(sources >= 2, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), graded + more))


def confidence_score(verification: Column, sources: Column, complete: Column, contact_verified: Column) -> Column:
    """Weighted mean in tenths, ten more for a verified contact, halves to even."""
    raw = (verification * 4 + F.least(F.lit(100), F.coalesce(sources, F.lit(0)) * 40) * 3 + complete * 3) / 10
    return F.bround(F.when(contact_verified, F.least(F.lit(100.0), raw + 10)).otherwise(raw)).cast("int")


def quality_state(enrichment: Column, status: Column, fresh: Column, has_locator: Column, complete: Column) -> Column:
    step = F.upper(F.coalesce(enrichment, F.lit("")))
    return (
        F.when(step == "FAILED", "FAILED")
        .when(F.lower(status).isin(*VERIFIED), "VERIFIED")
        .when(fresh == "stale", "STALE")
        .when(step.isin("ENRICHING", "ENRICHED"), step)
        .when(has_locator, "ENRICHED")
        .when(complete < 20, "NEEDS_REVIEW")
        .otherwise("NORMALIZED")
    )


def source_quality(sources: Column) -> Column:
    return F.when(sources >= 3, "high").when(sources == 2, "medium").when(sources == 1, "single_source")
