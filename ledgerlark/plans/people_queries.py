"""People, assessments, re-enrichment, windows of dedup, sources and spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import money, people
from ledgerlark.operators import outreach
from ledgerlark.plans.registry import query
from ledgerlark.sources import markup
from ledgerlark.tables import table

@query(r"""
WITH p AS (SELECT page_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/.]', '-', 'g'), '\?.*$', '')), '[-_]+'), lambda x: x <> '') AS parts FROM pages),
k AS (SELECT page_id, parts, list_position(list_transform(parts, lambda x: regexp_full_match(x, '\d{2,}') OR (regexp_full_match(x, '[0-9a-f]{6,}') AND regexp_matches(x, '\d')) OR regexp_matches(x, '[^\x00-\x7f]')), true) AS stop FROM p)
SELECT page_id, coalesce(list_aggregate(list_transform(list_slice(parts, 1, least(4, coalesce(nullif(stop, 0) - 1, 4))), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' '), '') AS name FROM k
""")
def profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[/.]", "-")
    return table(spark, sf_dir, "pages").select("page_id", people.profile_name(slug).alias("name"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'asha.rao@x.com' WHEN 1 THEN 'bo.li@x.com' ELSE 'cher@x.com' END AS first_form, CAST(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 8 END AS INT) AS forms FROM customer")
def address_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    name = F.when(key == 0, "Asha K. Rao").when(key == 1, " Bo Li").otherwise("Cher")
    got = people.address_candidates(name, F.lit("@X.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(got, 0).alias("first_form"), F.size(got).alias("forms"))


@query(rf"""
WITH d AS (SELECT doc_id, ['safe', 'risky', 'invalid', 'unknown', 'unknown', 'true'][doc_id % 6 + 1] AS reach, n_chars % 2 = 0 AS disposable, n_chars % 3 = 0 AS desk,
 coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' 550 5.1.1 User unknown' WHEN 1 THEN ' connection timed out, user unknown' ELSE '' END AS said FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(said, '{people.HARD_BOUNCE}') AND NOT regexp_matches(said, '{people.TRANSIENT}') THEN 'invalid' WHEN reach IN ('true', 'safe') THEN 'valid' WHEN reach = 'risky' THEN 'catch_all'
 WHEN reach = 'invalid' THEN CASE WHEN disposable THEN 'disposable' ELSE 'invalid' END WHEN disposable THEN 'disposable' WHEN desk THEN 'catch_all' ELSE 'unknown' END AS verdict FROM d
""")
def mailbox_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("doc_id"), F.col("n_chars")
    reach = F.when(key % 6 == 0, "safe").when(key % 6 == 1, "risky").when(key % 6 == 2, "invalid").when(key % 6 == 3, "unknown").when(key % 6 == 5, "true")
    said = F.concat(F.coalesce("text", F.lit("")), F.when(key % 5 == 0, " 550 5.1.1 User unknown").when(key % 5 == 1, " connection timed out, user unknown").otherwise(""))
    result = F.struct(reach.alias("is_reachable"), F.struct((n % 2 == 0).alias("is_disposable"), (n % 3 == 0).alias("is_role_account")).alias("misc"), F.struct(F.struct(said.alias("message")).alias("error")).alias("smtp"))
    return table(spark, sf_dir, "documents").select("doc_id", people.mailbox_verdict(F.to_json(result)).alias("verdict"))


def _pay_sql() -> str:
    money_sign, number = r"(?:₹|rs\.?\s*|\$|€|£|inr\s*)?\s*", r"([0-9]+(?:[.,][0-9]+)*)"
    span = rf"{number}\s*(lpa|lakhs?|lacs?|crore|cr|k)?\s*(?:-|–|—|\bto\b)\s*{money_sign}{number}\s*(lpa|lakhs?|lacs?|crore|cr|k)?"
    before, behind = rf"{money.PAY_ANCHOR}.{{0,60}}?{span}", rf"{span}.{{0,30}}?{money.PAY_ANCHOR}"
    parts = ", ".join(f"regexp_extract(t, CASE WHEN regexp_matches(t, '{before}') THEN '{before}' ELSE '{behind}' END, {k}) AS p{k}" for k in (1, 2, 3, 4))

    def value(n: str, unit: str) -> str:
        own = f"CASE WHEN {unit} <> '' THEN {unit} WHEN p4 <> '' THEN p4 ELSE p2 END"
        return f"TRY_CAST(replace({n}, ',', '') AS DOUBLE) * CASE WHEN regexp_matches({own}, '^(lpa|lakh|lac)') THEN 1e5 WHEN regexp_matches({own}, '^cr') THEN 1e7 WHEN {own} = 'k' THEN 1e3 ELSE 1.0 END"

    told = "text || CASE doc_id % 5 WHEN 0 THEN ' CTC: ' || (n_chars % 9 + 1) || ' - ' || (n_chars % 9 + 4) || ' lakh per annum' WHEN 1 THEN ' Salary ' || (n_chars % 80 + 20) || 'k - ' || (n_chars % 80 + 60) || 'k' WHEN 2 THEN ' 1 - 2 crore package' WHEN 3 THEN ' 0-2 years' ELSE '' END"
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce({told}, '')) AS t FROM documents), p AS (SELECT doc_id, {parts} FROM d), v AS (SELECT doc_id, {value("p1", "p2")} AS a, {value("p3", "p4")} AS b FROM p)
SELECT doc_id, CASE WHEN least(a, b) >= 1000 THEN least(a, b) END AS low, CASE WHEN least(a, b) >= 1000 THEN greatest(a, b) END AS high FROM v
"""


@query(_pay_sql())
def inline_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("doc_id"), F.col("n_chars")

    def text(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    pay = F.when(key % 5 == 0, text(" CTC: ", n % 9 + 1, " - ", n % 9 + 4, " lakh per annum")).when(key % 5 == 1, text(" Salary ", n % 80 + 20, "k - ", n % 80 + 60, "k"))
    got = money.inline_pay(F.concat("text", pay.when(key % 5 == 2, " 1 - 2 crore package").when(key % 5 == 3, " 0-2 years").otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", got["low"].alias("low"), got["high"].alias("high"))


@query("SELECT p_partkey, p_name LIKE '%bolt%' OR p_name LIKE '%gear%' AS found FROM part")
def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (people.company_in_text(F.lit("Bolt Technologies Pvt. Ltd."), F.col("p_name")) | people.company_in_text(F.lit("The Gear Co"), F.col("p_name"))).alias("found"))


@query()
def person_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's name against its segment and nation."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    other = F.concat_ws(" ", "c_mktsegment", "n_name")
    return rows.select("c_custkey", F.round(people.person_similarity(F.col("c_name"), other), 6).alias("similarity"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'full_name:old,personal_email:web' ELSE 'full_name:web,personal_email:web' END AS said FROM supplier
""")
def provenance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "map<string,struct<source:string,verified:boolean,at:string>>"
    old = F.when(F.col("s_suppkey") % 2 == 0, F.from_json(F.lit('{"full_name": {"source": "old", "verified": true, "at": "x"}}'), kind))
    got = people.provenance(old, {"full_name": F.col("s_name"), "personal_email": F.lit("a@b.c"), "job_title": F.lit(" ")}, F.lit("web"), F.lit(True), F.lit("now"))
    said = F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat_ws(":", e["key"], e["value"]["source"])))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(said, ",").alias("said"))


@query("""
WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'F' THEN 40 + 6 ELSE 12 + 3 END AS points, CASE WHEN o_orderpriority = '1-URGENT' THEN 30 WHEN o_orderpriority = '2-HIGH' THEN 26 ELSE 0 END AS rp, o_orderstatus = 'F' AS sure FROM orders WHERE o_totalprice > 350000),
b AS (SELECT o_custkey, max(points) AS points, max(rp) AS rp, count(*) FILTER (WHERE points > 0) AS locators, bool_or(sure) AS sure, arg_min(o_orderkey, CASE WHEN points > 0 THEN -points::BIGINT * 100000000 + o_orderkey END) AS best FROM k GROUP BY 1),
s AS (SELECT c_custkey, least(100, coalesce(points, 0) + coalesce(rp, 0) + 14) AS score, coalesce(locators, 0) AS locators, coalesce(sure, false) AS sure, best, c_custkey % 2 AS dp, c_custkey % 60 AS comp FROM customer LEFT JOIN b ON o_custkey = c_custkey),
r AS (SELECT *, CASE WHEN sure AND locators >= 1 AND dp >= 1 THEN 'OUTREACH_READY' WHEN locators >= 1 THEN 'PARTIALLY_ENRICHED' WHEN comp >= 30 THEN 'NEEDS_ENRICHMENT' ELSE 'INSUFFICIENT_DATA' END AS readiness FROM s)
SELECT c_custkey, CAST(score AS INT) AS score, readiness, best AS best_contact, CASE WHEN locators < 1 THEN CASE WHEN score < 25 THEN 'P4' ELSE 'P3' END WHEN score >= 75 THEN 'P0' WHEN score >= 58 THEN 'P1' WHEN score >= 40 THEN 'P2' ELSE 'P3' END AS priority FROM r
""")
def outreach_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 350000")
    status = F.when(F.col("o_orderstatus") == "P", "bounced").when(F.col("o_orderstatus") == "F", "verified").otherwise("unverified")
    contacts = o.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("contact_id"), F.lit("asha@x.com").alias("email"), F.lit(None).cast("string").alias("phone"), F.lit("").alias("linkedin"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "HR").when(F.col("o_orderpriority") == "2-HIGH", "recruiter").alias("role"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("grade"),
    )
    records = table(spark, sf_dir, "customer").withColumn("name", F.col("c_name"))
    got = outreach.assess(records, contacts, "c_custkey", "jobs", F.lit(14), F.col("c_custkey") % 2, F.col("c_custkey") % 60)
    return got.select("c_custkey", "score", "readiness", "best_contact", "priority")


@query("""
SELECT page_id FROM pages p WHERE page_id % 3 <> 0 AND (page_id % 2 = 0 OR page_id < 50) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.page_id AND e.ts > TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR) ORDER BY page_id LIMIT 40
""")
def reenrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise(" ").alias("url"), F.when(F.col("page_id") % 2 == 0, "NEEDS_ENRICHMENT").otherwise("OUTREACH_READY").alias("ready"),
        F.when(F.col("page_id") < 50, F.lit("2023-01-01")).otherwise(F.lit("2024-01-30")).cast("timestamp").alias("seen"),
    )
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("started_at"))
    early = rows.withColumn("seen", F.timestamp_seconds(F.unix_timestamp("seen") + F.col("page_id")))
    return outreach.reenrichment(early, runs, "page_id", "url", F.lit(False), "ready", "seen", F.lit("2024-01-31").cast("timestamp"), 30, 40).select("page_id")


@query("""
WITH l AS (SELECT user_id, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'view' GROUP BY 1), n AS (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS f FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT event_id, CASE WHEN event_id > f THEN 'repeated' WHEN seen IS NULL THEN 'inserted' WHEN seen > TIMESTAMP '2024-01-30' - INTERVAL 21 DAY THEN 'refreshed' ELSE 'reset' END AS outcome FROM n LEFT JOIN l USING (user_id)
""")
def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = e.where("ts < timestamp_ntz '2024-01-10' AND event_type = 'view'").select("user_id", "ts")
    new = e.where("ts >= timestamp_ntz '2024-01-20'").select(F.col("event_id").alias("row"), "user_id")
    got = outreach.window_dedup(known, new, "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00")), 21)
    return got.select(F.col("row").alias("event_id"), "outcome")


@query("SELECT n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_3')")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").withColumn("usual", F.col("n_regionkey") == 0)
    return outreach.chosen_sources(registry, "n_name", ["nobody"], "NATION_1, NATION_3,x", "usual").select("n_name")


@query("SELECT page_id, 'Acme & Co' AS company, '' AS gap, 'Dev ' || page_id AS title FROM pages")
def spreadsheet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.format_string('<Workbook><Row><Cell><Data ss:Type="String">Acme &amp; Co</Data></Cell><Cell ss:Index="3"><Data>Dev %d</Data></Cell></Row><Row><Cell/></Row></Workbook>', "page_id")
    got = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.spreadsheet_rows(xml)).alias("r"))
    return got.select("page_id", F.get("r", 0).alias("company"), F.get("r", 1).alias("gap"), F.get("r", 2).alias("title"))
