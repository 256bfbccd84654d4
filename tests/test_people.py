"""People, pay in running text, and sheets, with NULLs and blanks."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from ledgerlark.functions import classify, people
from ledgerlark.functions.money import inline_pay
from ledgerlark.operators import imports, outreach, reports
from ledgerlark.sources import markup


def test_person_similarity_against_difflib(spark):
    rows = [("Priya Sharma", "sharma  PRIYA"), ("A B", None), ("Asha Rao", "Asha Roy"), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(people.person_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        x, y = (" ".join(sorted((t or "").lower().split())) for t in (a, b))
        assert abs(r.s - (difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0)) < 1e-9


def test_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "a string")
    a = F.col("a")
    pay = inline_pay(a)
    got = df.select(
        people.profile_name(a).alias("p"), F.size(people.address_candidates(a, F.lit("x.com"))).alias("c"), people.mailbox_verdict(a).alias("v"), people.company_in_text(a, a).alias("t"), pay["low"].alias("low"),
        classify.employment_type(a).alias("e"), classify.location_type(a, a).alias("l"), classify.is_fresher(a).alias("f"), classify.india_relevant(a, a, a).alias("i"), classify.ownership(a).alias("o"),
        classify.event_mode(a, a, a).alias("m"), classify.email_class(a).alias("k"), classify.flat_location(a).alias("w"), F.size(F.coalesce(markup.spreadsheet_rows(a), F.array())).alias("s"),
    ).collect()
    for r in got:
        assert (r.v, r.t, r.low, r.e, r.l, r.f, r.i, r.o, r.m, r.k, r.w, r.s) == ("unknown", False, None, None, None, False, False, None, None, None, "", 0)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "row int, lead_id string, company string, title string, url string")
    leads = spark.createDataFrame([], "lead_id string, company string, title string, url string, seen int")
    assert imports.resolve(rows, leads).count() == 0
    assert imports.tally(imports.resolve(rows, leads)).first().total_rows == 0
    one = spark.createDataFrame([(1, None, "A", "T", "https://a.com/1"), (2, None, "A", "T", "https://a.com/1")], rows.schema)
    assert [r.outcome for r in imports.resolve(one, leads).orderBy("row").collect()] == ["created", "in_file"]
    assert reports.digest_line(leads, "x", "company").first().line == "x: none"


def test_assessment_of_records_without_contacts(spark):
    records = spark.createDataFrame([(1, "b"), (2, "a")], "id int, name string")
    contacts = spark.createDataFrame(
        [(1, 7, "asha@x.edu", None, None, "TPO", "verified", "A"), (1, 8, "tpo@x.edu", None, None, "tpo", "verified", "A"), (1, 9, "x@x.edu", None, None, None, "bounced", "A")],
        "id int, contact_id int, email string, phone string, linkedin string, role string, status string, grade string",
    )
    got = outreach.assess(records, contacts, "id", "colleges", F.lit(12), F.lit(1), F.lit(70)).collect()
    assert [(r.id, r.score, r.priority, r.readiness, r.best_contact, r.blocker) for r in got] == [(1, 88, "P0", "OUTREACH_READY", 7, None), (2, 12, "P4", "NEEDS_ENRICHMENT", None, "no reachable contact")]
    assert got[0].reasons == ["locator 46", "reaches tpo", "fresh 12"]


def test_saved_filters_ignore_unknown_keys(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "100x")], "id int, t string")
    assert [r.id for r in df.where(reports.saved_filter('{"search": "0%", "search_in": ["t"], "odd": 1}').column()).collect()] == [1]
    assert df.where(reports.saved_filter("{}").column()).count() == 2
