"""Figures of domains, listing pages and workbooks against plain answers."""

from __future__ import annotations

import datetime as dt
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import eda
from ledgerlark.sources import listing, sheets
from ledgerlark.workspace import scratch

NOW = dt.datetime(2026, 3, 1)
EVENT = (
    "name string, organizer_name string, event_start timestamp, registration_start timestamp, registration_deadline timestamp, state string, city string, mode string, technology string, domain string, prize_pool decimal(14,2), "
    "student_only boolean, college_only boolean, open_to_public boolean, hiring_opportunities boolean, internship_opportunities boolean, source_platform string, status string, occurrence_type string"
)
COLLEGE = (
    "id string, state string, district string, city string, institution_type string, ownership string, accreditation string, naac_grade string, enrichment_status string, outreach_readiness string, website_url string, official_email string, "
    "phone string, tpo_name string, tpo_email string, principal_name string, director_name string, dean_name string, nirf_rank int, completeness_score int, source_urls array<string>"
)


def figures(df) -> dict:
    return {(r.metric, r.value): r.n for r in df.collect()}


def test_figures_of_events(spark):
    from decimal import Decimal

    rows = [
        ("A Hack", "Acme", dt.datetime(2026, 3, 5), None, dt.datetime(2026, 3, 3), "Karnataka", "Pune", "online", "ai", " ", Decimal(600000), True, None, True, True, None, "x", "REGISTRATION_OPEN", "recurring"),
        ("B Hack", " Acme", None, dt.datetime(2025, 7, 1), None, "Karnataka", "", None, None, None, Decimal(30000), False, None, None, None, None, "x", "historical", None),
        ("C Hack", None, dt.datetime(2027, 1, 1), None, dt.datetime(2026, 9, 1), None, None, None, None, None, None, None, None, None, None, None, None, "RECURRING_PATTERN", None),
    ]
    got = figures(eda.event_figures(spark.createDataFrame(rows, EVENT), F.lit(NOW)))
    assert got["average_prize_pool", ""] == 315000 and got["prize_buckets", "above_5L"] == got["prize_buckets", "under_50k"] == got["prize_buckets", "unknown"] == 1 and got["prize_buckets", "2L_to_5L"] == 0
    assert got["recurring_organizers", ""] == 1 and got["by_organizer", "Acme"] == 2 and got["by_domain", ""] == 1 and got["by_year", "2025"] == 1 and got["by_month", "7"] == 1
    assert [got[m, ""] for m in ("total", "upcoming", "registration_open", "registration_closing_soon", "historical", "predicted", "recurring_hackathons", "student_only", "hiring_linked", "college_only")] == [3, 1, 1, 1, 1, 1, 1, 1, 1, 0]
    none = figures(eda.event_figures(spark.createDataFrame([], EVENT), F.lit(NOW)))
    assert none["average_prize_pool", ""] is None and none["total", ""] == none["prize_buckets", "unknown"] == 0 and len(none) == 20
    at_limit = spark.createDataFrame([(*rows[0][:10], Decimal(500000), *rows[0][11:])], EVENT)
    assert figures(eda.event_figures(at_limit, F.lit(NOW)))["prize_buckets", "above_5L"] == 0


def test_figures_of_colleges(spark):
    full = ("c1", "Karnataka", "D", "Pune", "college", "private", "NAAC", "A", "done", "READY", "https://a.org", "a@b.c", "1", "T", None, "P", "D", "E", 50, 80, ["https://aishe.gov.in/dump", "", None])
    bare = ("c2", "Karnataka", *[None] * 19)
    contacts = spark.createDataFrame([("c1", "tpo", "e", None), ("c1", "dean", None, "p"), ("c9", "tpo", "e", "p"), (None, "tpo", "e", "p")], "college_id string, role_category string, email string, phone string")
    colleges = spark.createDataFrame([full, bare], COLLEGE)
    got = figures(eda.college_figures(colleges, contacts))
    assert [got[m, ""] for m in ("total", "tpo_coverage", "states_covered", "contacts_total", "colleges_with_contacts", "colleges_with_tpo_role", "contact_emails", "contact_phones", "average_completeness", "placement_role_coverage_pct", "average_contacts_per_college", "nirf_ranked")] == [2, 1, 1, 2, 1, 1, 1, 1, 80, 50, 1, 1]
    assert got["by_source", "aishe.gov.in"] == 1 and got["by_state", "Karnataka"] == 2 and ("by_type", "") not in got
    none = figures(eda.college_figures(colleges.limit(0), contacts))
    assert none["total", ""] == none["contacts_total", ""] == 0 and none["average_completeness", ""] is None
    shot = eda.as_snapshot(eda.college_figures(colleges, contacts), "colleges").first()
    assert json.loads(shot.metrics)["by_state"] == [{"value": "Karnataka", "count": 2.0}] and shot.domain == "colleges"


PAGE = """<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": {"@type": "HackathonEvent", "name": " Big  Hack ", "startDate": "2026-03-05", "endDate": "2026-03-07",
"location": {"name": "Hall", "address": {"addressLocality": "Pune", "addressRegion": "MH", "addressCountry": "IN"}}, "organizer": [{"name": "Acme", "url": "https://acme.org"}], "offers": {"price": "10000"}, "description": "<p>Do it</p>"}}, {"@type": "Person"}]}</script>
<script type="application/ld+json">[{"@type": "Event", "headline": "Online One", "url": "https://x.org/one", "eventAttendanceMode": "OnlineEventAttendanceMode"}, {"@type": "Event"}, 5]</script><script type="application/ld+json">{broken</script>
<a href="/hackathon/ai-for-good-2026.html?x=1#top">View</a> <a class=q href='hackathon/two'>Great <b>Hack</b> Day</a><a href="/hackathon/ai-for-good-2026.html?x=1">again</a>
<a href="https://other.org/hackathon/z">No no</a><a href="mailto:a@b.c">x y</a><a href="https://www.host.org/hackathon/NASA_space-apps-12">go</a><a href="//host.org/hackathon/solo">here</a><a href="/about">About us</a>"""


def test_listing_page(spark):
    pages = spark.createDataFrame([(1, "https://host.org/list/", PAGE), (2, None, None), (3, "https://host.org", "")], "id long, url string, html string")
    got = listing.listing_records(pages, "id", "url", "html", "/hackathon").orderBy("place").collect()
    assert [(r.id, r.method, r.name, r.url) for r in got] == [
        (1, "json_ld", "Big Hack", "https://host.org/list/"),
        (1, "json_ld", "Online One", "https://x.org/one"),
        (1, "link_discovery", "Ai For Good 2026", "https://host.org/hackathon/ai-for-good-2026.html?x=1"),
        (1, "link_discovery", "Great Hack Day", "https://host.org/list/hackathon/two"),
        (1, "link_discovery", "NASA Space Apps", "https://www.host.org/hackathon/NASA_space-apps-12"),
        (1, "link_discovery", None, "https://host.org/hackathon/solo"),
    ]
    first = got[0]
    assert (first.organizer, first.organizer_url, first.city, first.state, first.country, first.venue, first.mode, first.description, first.year, float(first.prize_pool), first.status) == ("Acme", "https://acme.org", "Pune", "MH", "IN", "Hall", "offline", "Do it", 2026, 10000.0, "ANNOUNCED")
    assert got[1].mode == "online" and got[2].status == "DISCOVERED"


@pytest.mark.parametrize("rows", [3, 65_000])
def test_workbooks_come_back(spark, rows):
    data = [(1, "a & <b>\n\tc \"d\"", 1.5, True, dt.datetime(2026, 3, 5, 1, 2, 3)), (2, "", None, None, None), (3, None, -2.0, False, None), (4, "&amp;#10; é😀", 0.0, None, None), (5, "name", 1e20, True, None), (None, "\x01x", None, None, None)]
    schema = "id long, name string, v double, ok boolean, at timestamp"
    df = spark.createDataFrame(data * 3, schema).repartition(2)
    path = scratch(spark, "book")
    sheets.write_workbooks(df, path, rows=rows)
    want = sorted(repr((*d[:1], "x" if d[1] == "\x01x" else d[1], *d[2:])) for d in data * 3)
    assert sorted(repr(tuple(r)) for r in sheets.read_workbooks(spark, path, schema).collect()) == want
    texts = [r[0] for r in spark.read.text(f"{path}/part-*", wholetext=True).collect() if r[0]]
    tables = [t for x in texts for t in ET.fromstring(x.strip()).iter("{urn:schemas-microsoft-com:office:spreadsheet}Table")]
    assert len(texts) == 2 and all(len(t) <= rows + 1 for t in tables) and sum(len(t) - 1 for t in tables) == 18
    sheets.write_summary(spark.createDataFrame([("total", 18)], "label string, count long"), scratch(spark, "summary"))
    nothing = scratch(spark, "none")
    sheets.write_workbooks(df.limit(0), nothing)
    assert sheets.read_workbooks(spark, nothing, schema).count() == 0
