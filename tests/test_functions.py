"""Table-driven cases of the column library, with NULLs and blanks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import classify, dates, money, scoring, similarity, strings
from ledgerlark.sources import markup, tabular


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "key"),
    [("Acme Industries Pvt Ltd", "acmeindustries"), ("ACME, Inc.", "acme"), ("Co", "co"), (None, ""), ("  ", ""), ("Zoho Corporation Private Limited", "zoho")],
)
def test_company_key(spark, text, key):
    assert one(spark, strings.company_key(F.col("a")), a=text) == key


@pytest.mark.parametrize(("url", "host"), [("https://WWW.Acme.com:443/x", "acme.com"), ("acme.co.in/x", "acme.co.in"), ("nope", None), (None, None), ("https://user@h.org/", "h.org")])
def test_host(spark, url, host):
    assert one(spark, strings.host(F.col("a")), a=url) == host


def test_registrable(spark):
    assert one(spark, strings.registrable(F.col("a")), a="https://careers.acme.co.in/1") == "acme.co.in"
    assert one(spark, strings.registrable(F.col("a")), a="https://careers.acme.com/1") == "acme.com"
    assert one(spark, strings.registrable(F.col("a")), a="https://a.b.acme.co.uk") == "acme.co.uk"
    assert one(spark, strings.registrable(F.col("a")), a="https://acme.co.in") == "acme.co.in"
    assert one(spark, strings.registrable(F.col("a")), a=None) is None


@pytest.mark.parametrize(
    ("name", "want"),
    [("Asha Rao", True), ("Mary-Jane O. Watson", True), ("Mary-Jane Watson", True), ("San Francisco", False), ("N I", False), ("Asha", False), ("Asha RAO", False), ("asha Rao", False), ("Asha Rao2", False), ("Éva Nagy", True), ("A B Contact", False), ("Li Wu Na Xi Yu Mo", True), ("", False), (None, False)],
)
def test_person_name(spark, name, want):
    assert one(spark, strings.person_name(F.col("a")), a=name) is want


def test_fingerprint_ignores_the_path(spark):
    def of(url):
        return one(spark, strings.fingerprint(F.lit("Tech Corp"), F.lit("Engineer"), F.col("a")), a=url)

    assert of("https://careers.tech.com/job/1") == of("https://careers.tech.com/job/2") != of("https://other.com/job/1")
    assert len(of(None)) == 64


def test_name_key_folds_accents(spark):
    assert one(spark, strings.name_key(F.col("a")), a="  IIT (BHU) Váranasi ") == "iitbhuvaranasi"
    assert one(spark, strings.name_key(F.col("a")), a=None) == ""
    assert one(spark, strings.slug(F.col("a")), a="Café — du  Monde!") == "cafe-du-monde"


def test_lead_score_example(spark):
    full = {"hr_name": "John Smith", "hr_personal_email": "john@company.com", "hr_personal_mobile": None, "hr_linkedin_url": "in/x", "company_default_email": None, "company_default_phone": None, "salary_range": "10-15 LPA", "job_description": "x" * 101, "job_url": "u", "email_status": "valid", "whatsapp_status": "registered"}
    columns = {k: F.lit(v).cast("string") for k, v in full.items()}
    assert one(spark, scoring.lead_score(columns)) == 90
    few = {k: F.lit(v if k in ("hr_name", "hr_personal_email") else None).cast("string") for k, v in full.items()}
    assert one(spark, scoring.lead_score(few)) == 45
    assert one(spark, scoring.score_band(scoring.lead_score(few))) == "warm"
    assert scoring.lead_weights({"hr_name_found": 300, "other": 1})["hr_name"] == 100


@pytest.mark.parametrize(("score", "ready", "want"), [(90, "OUTREACH_READY", "P0"), (60, "PARTIALLY_ENRICHED", "P1"), (90, "NEEDS_ENRICHMENT", "P3"), (10, "INSUFFICIENT_DATA", "P4")])
def test_priority(spark, score, ready, want):
    assert one(spark, scoring.priority(F.col("a"), F.lit(ready)), a=score) == want


def test_confidence_rounds_halves_to_even(spark):
    assert one(spark, scoring.confidence_score(F.lit(20), F.lit(0), F.lit(15), F.lit(False))) == 12  # 12.5
    assert one(spark, scoring.confidence_score(F.lit(20), F.lit(None).cast("int"), F.lit(15), F.lit(True))) == 22


def test_role_addresses_and_phones(spark):
    assert one(spark, strings.is_role_address(F.col("a")), a="Placement.Cell@x.edu") is True
    assert one(spark, strings.is_role_address(F.col("a")), a="asha.rao@x.edu") is False
    assert one(spark, strings.is_role_address(F.col("a")), a=None) is False
    assert one(spark, strings.sendable_phone(F.col("a")), a="9999999999") is False
    assert one(spark, strings.email_pattern(F.lit("a.rao@x.com"), F.lit("Asha Rao"))) is None
    assert one(spark, strings.email_pattern(F.lit("arao@x.com"), F.lit("Asha Rao"))) == "flast"


def test_similarity(spark):
    assert one(spark, similarity.levenshtein_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, similarity.trigram_similarity(F.lit("foo"), F.lit("foo bar"))) == 0.5
    assert one(spark, similarity.trigram_similarity(F.lit(""), F.lit(None).cast("string"))) == 0.0
    assert one(spark, similarity.ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_money_and_dates_of_nulls(spark):
    assert one(spark, money.parse_money(F.col("a")), a=None) is None
    assert one(spark, dates.parse_datetime(F.col("a")), a=None) is None
    assert one(spark, dates.posting_freshness(F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))) == "unknown"
    assert one(spark, dates.record_freshness("colleges", F.lit("2026-06-01").cast("timestamp"), F.lit("2026-05-30").cast("timestamp"))) == "fresh"
    assert one(spark, dates.is_stale(F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))) is True


def test_nested_list_and_names(spark):
    assert one(spark, markup.nested_list(F.col("a"), "items"), a='{"x": {"items": [{"b": 1}]}}') == '[{"b": 1}]'
    assert one(spark, markup.nested_list(F.col("a"), "items"), a="no json") is None
    assert one(spark, markup.name_from_url(F.col("a")), a="https://x.org/events/smart-india-hack.html?x=1") == "Smart India Hack"


def test_headers_and_csv(spark, tmp_path):
    assert tabular.match_header(" Work-Mode: ") == "location_type"
    assert tabular.match_header("Recruiter e-mail address email") == "hr_name" or tabular.match_header("contact email") == "hr_email"
    assert tabular.match_header("zzz") is None
    p = tmp_path / "a.csv"
    p.write_text('Company,Job Title,Job URL,Company\n"Initech, Ltd",Dev,https://i.com/d,x\n,,,\nCompany,Job Title,Job URL,Company\n')
    df = tabular.mapped(tabular.read_delimited(spark, f"file://{p}"))
    assert df.columns == ["company_name", "job_title", "job_url"]
    echo = tabular.is_header_echo({c: F.col(c) for c in df.columns})
    assert [r.company_name for r in df.where(~echo).collect()] == ["Initech, Ltd"]
    out = tmp_path / "b.tsv"
    out.write_text("a\tb\n1\t2\n")
    assert tabular.read_delimited(spark, f"file://{out}").columns == ["a", "b"]
    assert one(spark, tabular.csv_line(F.lit('a"b'), F.lit("=1"), F.lit(None).cast("string"))) == '"a""b","\'=1",""'
    assert one(spark, tabular.csv_line_plain(F.lit('a"b'), F.lit("x"))) == '"a""b",x'


@pytest.mark.parametrize(
    ("text", "amount"),
    [("₹5 Lakh", 500000.0), ("INR 1,00,000", 100000.0), ("1.5 crore", 15000000.0), ("$10,000", 10000.0), ("no prize mentioned", None), ("50k", 50000.0), ("2 million", 2000000.0), ("0", None), ("3,500", 3500.0)],
)
def test_written_money(spark, text, amount):
    assert one(spark, money.parse_money(F.col("a")), a=text) == amount


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("₹25-45 LPA", (2500000.0, 4500000.0, "INR", "year")),
        ("3.5 - 6 lakh per annum", (350000.0, 600000.0, "", "year")),
        ("1 - 2 crore package", (10000000.0, 20000000.0, "", "")),
        ("Salary 50k - 80k", (50000.0, 80000.0, "", "")),
        ("$80,000 - $120,000 per year", (80000.0, 120000.0, "USD", "year")),
        ("₹12 - ₹15", (1200000.0, 1500000.0, "INR", "")),
        ("£900 per month", (None, None, "GBP", "month")),
        ("negotiable", (None, None, "", "")),
        ("€60,000 - 40,000", (40000.0, 60000.0, "EUR", "")),
    ],
)
def test_written_salaries(spark, text, want):
    parts = money.salary_bounds(F.col("a"))
    assert tuple(one(spark, F.struct(*(c.alias(n) for n, c in parts.items())), a=text)) == want


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2026-03-05", "2026-03-05 00:00:00"), ("March 2026", "2026-03-01 00:00:00"), ("05/03/2026", "2026-03-05 00:00:00"), ("5 Mar 2026", "2026-03-05 00:00:00"), ("not a date", None), ("1767225600", "2026-01-01 00:00:00"),
        ("1767225600000", "2026-01-01 00:00:00"), ("March 5, 2026", "2026-03-05 00:00:00"), ("2026-01-01T10:30:00Z", "2026-01-01 10:30:00"), ("Mon, 05 Jan 2026 10:00:00 GMT", "2026-01-05 10:00:00"),
    ],
)
def test_written_dates(spark, text, day):
    assert one(spark, F.date_format(dates.parse_datetime(F.col("a")), "yyyy-MM-dd HH:mm:ss"), a=text) == day


@pytest.mark.parametrize(
    ("text", "first", "last"),
    [
        ("Jan 01 - Jan 05, 2026", "2026-01-01", "2026-01-05"), ("2026-03-05 to 2026-03-07", "2026-03-05", "2026-03-07"), ("ongoing", None, None), ("2026-03-09 until 2026-03-07", "2026-03-07", "2026-03-09"),
        ("March 2026", "2026-03-01", None), (None, None, None),
    ],
)
def test_written_periods(spark, text, first, last):
    got = dates.date_range(F.col("a"))
    assert tuple(one(spark, F.struct(*(F.date_format(got[k], "yyyy-MM-dd").alias(k) for k in ("start", "end"))), a=text)) == (first, last)


@pytest.mark.parametrize(("text", "e164"), [("98765 43210", "+919876543210"), ("+91-98765-43210", "+919876543210"), ("098765 43210", "+919876543210"), ("12345", None), ("+1 (415) 555-0100", "+14155550100")])
def test_written_numbers(spark, text, e164):
    assert one(spark, strings.mobile_e164(F.col("a")), a=text) == e164


@pytest.mark.parametrize(
    ("raw", "place"),
    [
        ('{"city": "Bengaluru", "region": "KA", "country": "India"}', "Bengaluru, KA, India"), ('["Pune", {"name": "Goa"}, "Pune"]', "Pune, Goa"), (" Mumbai ", "Mumbai"), ('{"fullLocation": "X, Y", "city": "X"}', "X, Y"), ("{odd", "{odd"), ("", ""),
    ],
)
def test_written_places(spark, raw, place):
    assert one(spark, classify.flat_location(F.col("a")), a=raw) == place
