"""Classes of postings, institutions, profiles, mailboxes and pay on written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import classify, money, people
from ledgerlark.operators import lifecycle

POSTS = [
    ("Software Intern", "0 to 2 year(s)", "Pune", "", "remoteok", True, True),
    ("Internal Auditor", "5 years", "Berlin", "work with teams in India", "remoteok", False, False),
    ("Engineer", "class of 2026", "", "office in Bengaluru", "x", True, True),
    ("Engineer", "3 years", "Remote", "", "naukri.com", False, True),
    ("Senior Engineer", "8 years", None, None, None, False, False),
    ("Graduate Engineer", None, "Austin or Hyderabad", "", "x", True, True),
]
KINDS = [
    ("Full-time", "full_time", "Work from home", "", "remote"), ("Permanent", "full_time", None, "Bengaluru, Hybrid", "hybrid"), ("odd", "unspecified", "client office", "", "onsite"),
    (None, None, None, "Remote - anywhere", "remote"), ("  ", None, None, None, None), ("Contractual", "contract", "moon", "", "unspecified"), ("intern", "internship", None, "Remote / onsite", None),
]
COLLEGES = [
    ("Government Engineering College", "government", "college"), ("Private Unaided Institute", "private", "institute"), ("St. X Aided College", "aided", "college"), ("Deemed to be University", "deemed", "deemed_university"),
    ("ABC Autonomous Institution", "autonomous", "institute"), ("State University", None, "university"), (None, None, None),
]
SLUGS = {"priya-sharma-2a9b1c14": "Priya Sharma", "/john_q-public/": "John Q Public", "a-b-c-d-e?x=1": "A B C D", "jane-12345": "Jane", "dabba-face": "Dabba Face"}
VERDICTS = {
    '{"is_reachable": "safe"}': "valid", '{"is_reachable": "risky"}': "catch_all", '{"is_reachable": "invalid", "misc": {"is_disposable": true}}': "disposable", "[]": "unknown", "no json": "unknown",
    '{"is_reachable": "safe", "smtp": {"error": {"message": "550 5.1.1 user unknown"}}}': "invalid", '{"is_reachable": "safe", "smtp": {"error": {"message": "connection timed out, user unknown"}}}': "valid",
    '{"misc": {"is_role_account": true}}': "catch_all",
}
PAY = {
    "Join us (₹25-45 LPA), Pune": (2500000.0, 4500000.0), "CTC: 3.5 - 6 lakh per annum": (350000.0, 600000.0), "1 - 2 crore package": (10000000.0, 20000000.0), "Salary 50k - 80k": (50000.0, 80000.0),
    "Duration: 1-2 Months, B.Tech 2026 batch": (None, None), "0-2 years experience": (None, None), "stipend within 1-2 months": (None, None),
}


def test_postings(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(POSTS)], "i int, title string, experience string, location string, text string, source string")
    got = df.select("i", classify.is_fresher(F.col("title"), F.col("experience")), classify.india_relevant(F.col("location"), F.col("text"), F.col("source"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: r[5:] for i, r in enumerate(POSTS)}


def test_employment_and_mode(spark):
    df = spark.createDataFrame([(i, r[0], r[2], r[3]) for i, r in enumerate(KINDS)], "i int, e string, w string, l string")
    got = df.select("i", classify.employment_type(F.col("e")), classify.location_type(F.col("w"), F.col("l"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (r[1], r[4]) for i, r in enumerate(KINDS)}


def test_institutions(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(COLLEGES)], "i int, name string")
    got = df.select("i", classify.ownership(F.col("name")), classify.institution_type(F.col("name"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: r[1:] for i, r in enumerate(COLLEGES)}


@pytest.mark.parametrize(("cases", "does"), [(SLUGS, people.profile_name), (VERDICTS, people.mailbox_verdict)])
def test_profiles_and_mailboxes(spark, cases, does):
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", does(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_inline_pay(spark):
    pay = money.inline_pay(F.col("x"))
    got = spark.createDataFrame([(k,) for k in PAY], "x string").select("x", pay["low"], pay["high"]).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == PAY


def test_every_move_of_the_stage_machine(spark):
    pairs = [(a, b) for a in lifecycle.STAGES for b in lifecycle.STAGES]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lifecycle.transition_ok(F.col("a"), F.col("b")), lifecycle.advance(F.col("a"), F.col("b"))).collect()
    assert all(r[2] == lifecycle.legal(r.a, r.b) and r[3] == (r.b if r[2] else r.a) for r in got) and len(got) == len(pairs)
