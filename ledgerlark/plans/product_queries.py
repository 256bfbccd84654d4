"""Imports, classes, digests, gauges, summaries and saved filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import classify as C
from ledgerlark.operators import imports, reports
from ledgerlark.plans.registry import query
from ledgerlark.tables import table


def words_sql(text: str, words: tuple[str, ...]) -> str:
    """any_word() for an engine whose word boundary knows ASCII only: what stands before and behind is spelt out. Words that aren't there at all are told apart first."""
    letter = r"\pL\pN\pM_"

    def edge(c: str, start: str) -> str:
        return f"(?:{start}|[^{letter}])" if c.isalnum() else f"[{letter}]"

    def found(w: str) -> str:
        pattern = edge(w[0], "^") + "".join(c if c.isalnum() or c == " " or not c.isascii() else "\\" + c for c in w) + edge(w[-1], "$")
        return f"contains({text}, '{w}') AND regexp_matches({text}, '{pattern}')"

    return "(" + " OR ".join(map(found, words)) + ")"


@query(rf"""
WITH d AS (SELECT doc_id, lower(source || ' ' || ['Graduate Engineer', 'Internal Auditor', 'Lead, class of 2026', 'Engineer'][doc_id % 4 + 1] || CASE doc_id % 3 WHEN 0 THEN ' 0 to 2 year(s)' WHEN 2 THEN ' 5 years' ELSE '' END || coalesce(' ' || text, '')) AS post,
 lower(coalesce(n_name, '')) AS place, lower(coalesce(text, '')) AS said, lower(CASE WHEN doc_id % 7 = 0 THEN 'Naukri.com' ELSE source END) AS site FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 26),
p AS (SELECT *, regexp_replace(regexp_replace(post, '\((es|s)\)', '\1', 'g'), '\b(\d+)\s*to\s*(\d+)\b', '\1-\2', 'g') AS read FROM d)
SELECT doc_id, {words_sql("read", C.FRESHER_WORDS)} OR regexp_matches(read, '\b20\d\d\s+graduates?\b') OR regexp_matches(read, '\bclass of 20\d\d\b') AS fresher,
 CASE WHEN {words_sql("place", C.INDIA_PLACES)} THEN true WHEN {words_sql("place", C.FOREIGN_PLACES)} THEN false ELSE {words_sql("said", C.INDIA_PLACES)} OR regexp_matches(site, '{"|".join(C.INDIA_SOURCES)}') END AS india FROM p
""")
def posting_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == key % 26, "left")
    title = F.concat("source", F.lit(" "), F.when(key % 4 == 0, "Graduate Engineer").when(key % 4 == 1, "Internal Auditor").when(key % 4 == 2, "Lead, class of 2026").otherwise("Engineer"))
    experience = F.when(key % 3 == 0, "0 to 2 year(s)").when(key % 3 == 2, "5 years")
    india = C.india_relevant(F.col("n_name"), F.col("text"), F.when(key % 7 == 0, "Naukri.com").otherwise(F.col("source")))
    return rows.select("doc_id", C.is_fresher(title, experience, F.col("text")).alias("fresher"), india.alias("india"))


@query("""
WITH d AS (SELECT doc_id, n_chars % 6 AS e, n_chars % 5 AS w, lower(coalesce(text, '')) || CASE doc_id % 4 WHEN 0 THEN ' remote' WHEN 1 THEN ' bengaluru, hybrid' WHEN 2 THEN ' remote / onsite' ELSE '' END AS place FROM documents)
SELECT doc_id, CASE e WHEN 0 THEN 'full_time' WHEN 1 THEN 'full_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'internship' WHEN 4 THEN 'unspecified' END AS employment,
 CASE WHEN w = 0 THEN 'remote' WHEN w = 1 THEN 'onsite' WHEN w = 2 THEN 'unspecified' WHEN contains(place, 'remote') AND NOT regexp_matches(place, 'onsite|on-site|office') THEN 'remote' WHEN contains(place, 'hybrid') THEN 'hybrid' END AS mode FROM d
""")
def employment_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("n_chars"), F.col("doc_id")
    said = F.when(n % 6 == 0, "Full-time").when(n % 6 == 1, "Permanent").when(n % 6 == 2, "Contractual").when(n % 6 == 3, "intern").when(n % 6 == 4, "odd")
    declared = F.when(n % 5 == 0, "Work from home").when(n % 5 == 1, "client office").when(n % 5 == 2, "moon").when(n % 5 == 3, " ")
    place = F.concat(F.coalesce("text", F.lit("")), F.when(key % 4 == 0, " Remote").when(key % 4 == 1, " Bengaluru, Hybrid").when(key % 4 == 2, " Remote / onsite").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", C.employment_type(said).alias("employment"), C.location_type(declared, place).alias("mode"))


@query(r"""
WITH p AS (SELECT page_id, lower(['Government ', 'Private Unaided ', 'Aided ', 'Deemed to be ', 'Autonomous ', ''][page_id % 6 + 1] || regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) || [' College', ' University', ' Institute', ''][length(html) % 4 + 1]) AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, 'autonomous') THEN 'autonomous' WHEN regexp_matches(t, '\b(government|govt|public)') THEN 'government' WHEN regexp_matches(t, '\bdeemed') THEN 'deemed' WHEN regexp_matches(t, '\b(private|self-financ|unaided)') THEN 'private'
  WHEN regexp_matches(t, '\b(aided|grant-in-aid)') THEN 'aided' END AS ownership,
 CASE WHEN regexp_matches(t, '\bdeemed') THEN 'deemed_university' WHEN contains(t, 'university') THEN 'university' WHEN contains(t, 'institut') THEN 'institute' WHEN contains(t, 'college') THEN 'college' END AS kind FROM p
""")
def institution_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("page_id") % 6, F.length("html") % 4
    first = F.when(kind == 0, "Government ").when(kind == 1, "Private Unaided ").when(kind == 2, "Aided ").when(kind == 3, "Deemed to be ").when(kind == 4, "Autonomous ").otherwise("")
    last = F.when(size == 0, " College").when(size == 1, " University").when(size == 2, " Institute").otherwise("")
    name = F.concat(first, F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1), last)
    return table(spark, sf_dir, "pages").select("page_id", C.ownership(name).alias("ownership"), C.institution_type(name).alias("kind"))


@query("""
SELECT o_orderkey, CASE WHEN e < TIMESTAMP '2000-01-01' THEN 'HISTORICAL' WHEN o_orderstatus = 'P' THEN 'ANNOUNCED' WHEN o_orderstatus = 'F' THEN 'CONFIRMED' WHEN d >= TIMESTAMP '2000-01-01' THEN 'REGISTRATION_OPEN'
  WHEN s >= TIMESTAMP '2000-01-01' THEN 'UPCOMING' ELSE 'ANNOUNCED' END AS status
FROM (SELECT *, o_orderdate AS s, o_orderdate + INTERVAL 3 DAY AS e, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate - INTERVAL 10 DAY END AS d FROM orders)
""")
def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate")
    said = F.when(F.col("o_orderstatus") == "P", "predicted").when(F.col("o_orderstatus") == "F", " confirmed ")
    end, deadline = start + F.make_dt_interval(days=F.lit(3)), F.when(F.col("o_custkey") % 2 == 0, start - F.make_dt_interval(days=F.lit(10)))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.event_status(said, start, end, deadline, F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))).alias("status"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', ' || n_name WHEN 1 THEN c_mktsegment || ', ' || c_name WHEN 2 THEN n_name || ' / ' || c_name ELSE '{' || c_name END AS location FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def flat_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations as JSON objects, lists of texts and objects, plain text and broken JSON."""
    key, name, nation = F.col("c_custkey") % 4, F.col("c_name"), F.col("n_name")
    listed = F.concat(F.lit("["), F.to_json(F.struct("c_mktsegment")), F.lit(","), F.to_json(F.struct(name.alias("name"))), F.lit(',{"name":"'), name, F.lit('"}]'))
    raw = (
        F.when(key == 0, F.to_json(F.struct(name.alias("city"), nation.alias("country"))))
        .when(key == 1, F.regexp_replace(listed, r'\{"c_mktsegment":("[^"]*")\}', "$1"))
        .when(key == 2, F.concat(F.lit("  "), nation, F.lit(" / "), name, F.lit(" ")))
        .otherwise(F.concat(F.lit("{"), name))
    )
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return df.select("c_custkey", C.flat_location(raw).alias("location"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'role' ELSE 'person' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 1 THEN 'B' ELSE 'A' END WHEN s_suppkey % 5 = 0 THEN 'C' END AS grade FROM supplier
""")
def email_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    mail = F.when(key % 3 == 1, "TPO+x@a.edu").when(key % 3 == 2, "asha@a.edu")
    status = F.when(key % 2 == 0, "verified").when(key % 5 == 0, "catch_all").otherwise("undeliverable")
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.email_class(mail).alias("kind"), C.email_grade(status, mail).alias("grade"))


#: Leads and file rows made of part, in SQL that Spark and DuckDB share: known ids, other spellings, other addresses, other orders of words.
_HOST = "'https://c' || CAST(p_size AS STRING) || '.example.com'"
_LEAD = {
    "lead_id": "CAST(p_partkey AS STRING)", "company": "p_brand || ' Ltd'", "title": "p_name", "url": f"{_HOST} || '/j/' || CAST(p_partkey AS STRING)", "seen": "p_retailprice",
}
_KIND = "CASE WHEN p_partkey % 97 = 0 THEN 6 ELSE p_partkey % 6 END"
_ROW = {
    "row": "p_partkey",
    "lead_id": f"CASE {_KIND} WHEN 0 THEN CAST(p_partkey AS STRING) END",
    "company": f"CASE {_KIND} WHEN 0 THEN 'Other' WHEN 1 THEN upper(p_brand) || ' LTD.' WHEN 2 THEN p_brand || ' Limited' WHEN 5 THEN p_type WHEN 6 THEN ' ' ELSE p_brand || ' Ltd' END",
    "title": f"CASE {_KIND} WHEN 0 THEN 'Else ' || CAST(p_partkey AS STRING) WHEN 1 THEN replace(p_name, ' ', '  ') WHEN 2 THEN 'Another role' WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 4 THEN p_name || 's' WHEN 5 THEN 'Tester' ELSE p_name END",
    "url": f"CASE {_KIND} WHEN 0 THEN 'https://o.example.org' WHEN 2 THEN {_HOST} || '/j/' || CAST(p_partkey AS STRING) || '/?utm=1' WHEN 5 THEN 'https://new.example.com/1' WHEN 6 THEN '' ELSE {_HOST} || '/x' END",
}


def _made(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS `{name}`" for name, expression in columns.items()]


_LADDER = f"""
WITH raw_leads AS (SELECT {", ".join(_made(_LEAD))} FROM part), raw_rows AS (SELECT {", ".join(_made(_ROW))} FROM part),
""".replace("`", '"') + r"""
x AS (SELECT true AS known, NULL::BIGINT AS n, lead_id, company, title, url, seen FROM raw_leads UNION ALL SELECT false, "row", lead_id, company, title, url, NULL FROM raw_rows),
k AS (SELECT *, lower(regexp_replace(company, '[^a-zA-Z0-9]', '', 'g')) || '|' || lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) || '|' || regexp_extract(lower(url), '://([^/?#:]*)', 1) AS fp,
  regexp_replace(regexp_replace(lower(trim(company)), ' (ltd|limited)\.?$', ''), '[^a-z0-9]', '', 'g') AS ck, rtrim(regexp_replace(lower(url), '[?#].*$', ''), '/') AS uk, regexp_extract(lower(url), '://([^/?#:]*)', 1) AS hk,
  list_distinct(flatten(list_transform(list_filter(string_split(lower(title), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM x),
l AS (SELECT * FROM k WHERE known), r AS (SELECT *, min(n) OVER (PARTITION BY fp) AS first_n FROM k WHERE NOT known),
p AS (SELECT fp, lead_id AS by_print FROM l QUALIFY row_number() OVER (PARTITION BY fp ORDER BY seen DESC, lead_id) = 1),
u AS (SELECT uk, ck, lead_id AS by_url FROM l QUALIFY row_number() OVER (PARTITION BY uk, ck ORDER BY seen DESC, lead_id) = 1),
f AS (SELECT r.n, l.lead_id AS near FROM r JOIN l ON l.ck = r.ck AND l.hk = r.hk WHERE len(list_intersect(l.g, r.g))::DOUBLE / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))) >= 0.85
  QUALIFY row_number() OVER (PARTITION BY r.n ORDER BY l.seen DESC, l.lead_id) = 1),
j AS (SELECT r.*, i.lead_id AS by_id, by_print, by_url, near FROM r LEFT JOIN raw_leads i ON i.lead_id = r.lead_id LEFT JOIN p ON p.fp = r.fp LEFT JOIN u ON u.uk = r.uk AND u.ck = r.ck LEFT JOIN f ON f.n = r.n),
o AS (SELECT n AS "row", CASE WHEN ck = '' AND uk = '' THEN 'invalid' WHEN first_n < n THEN 'in_file' WHEN by_id IS NOT NULL THEN 'lead_id' WHEN by_print IS NOT NULL THEN 'fingerprint' WHEN by_url IS NOT NULL THEN 'url' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'created' END AS outcome,
  CASE WHEN ck <> '' OR uk <> '' THEN coalesce(by_id, by_print, by_url, near) END AS target FROM j)
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return imports.resolve(part.selectExpr(*_made(_ROW)), part.selectExpr(*_made(_LEAD)))


@query(_LADDER + "SELECT * FROM o")
def import_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("row", "outcome", "target")


@query(_LADDER + """SELECT count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome IN ('lead_id', 'fingerprint', 'url', 'in_file')) AS merged,
count(*) FILTER (WHERE outcome = 'fuzzy') AS merged_fuzzy, count(*) FILTER (WHERE outcome = 'invalid') AS skipped FROM o""")
def import_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.tally(_resolved(spark, sf_dir))


@query("SELECT c_custkey, c_acctbal < 0 OR c_mktsegment = 'BUILDING' AS suppressed FROM customer")
def import_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.concat(F.lit(" C"), "c_custkey", F.lit("@X.com ")).alias("email"), F.concat(F.lit("0"), (F.col("c_custkey") + 9_000_000_000).cast("string")).alias("mobile"))
    mails = c.where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey", F.lit("@x.com")).alias("contact"))
    phones = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("+91"), (F.col("c_custkey") + 9_000_000_000).cast("string")).alias("contact"))
    return imports.suppressed(c, "c_custkey", "email", "mobile", mails.union(phones), "contact").select("c_custkey", "suppressed")


@query("""
SELECT 'leads_total{o_orderstatus="' || o_orderstatus || '"} ' || count(*) AS line FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'events_24h{event_type="' || event_type || '",big="' || (value > 100)::VARCHAR || '"} ' || count(*) FROM events WHERE ts > TIMESTAMP '2024-01-30' GROUP BY event_type, value > 100
""")
def metric_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = table(spark, sf_dir, "events").where("ts > timestamp_ntz '2024-01-30'").select("event_type", (F.col("value") > 100).alias("big"))
    return reports.all_gauges(reports.gauges(table(spark, sf_dir, "orders"), "leads_total", ["o_orderstatus"]), reports.gauges(day, "events_24h", ["event_type", "big"]))


@query("""
SELECT 'Events (24h): ' || string_agg(event_type || '=' || n, ', ' ORDER BY n DESC, event_type) AS line FROM (SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30' GROUP BY 1)
UNION ALL SELECT 'Sent (24h): none'
""")
def ops_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = table(spark, sf_dir, "events").where("ts > timestamp_ntz '2024-01-30'")
    return reports.digest_line(day, "Events (24h)", "event_type").unionByName(reports.digest_line(day.where("event_type = 'sent'"), "Sent (24h)", "event_type"))


@query("""
SELECT 'summary' AS section, 'large' AS label, count(*) FILTER (WHERE o_totalprice > 300000) AS count FROM orders UNION ALL SELECT 'summary', 'finished', count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders
UNION ALL SELECT 'summary', 'customers', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderstatus', CASE WHEN o_orderstatus = '' THEN '(blank)' ELSE o_orderstatus END, count(*) FROM orders GROUP BY 2
""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = {"large": F.col("o_totalprice") > 300000, "finished": F.col("o_orderstatus") == "F"}
    return reports.summary(table(spark, sf_dir, "orders"), tallies, ["o_orderpriority", "o_orderstatus"], {"customers": "o_custkey"})


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 400000")
def saved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = '{"equal": {"o_orderstatus": "O"}, "one_of": {"o_orderpriority": ["1-URGENT", "5-LOW"]}, "at_least": {"o_totalprice": 400000}, "shared": true}'
    return table(spark, sf_dir, "orders").where(reports.saved_filter(kept).column()).select("o_orderkey")


@query("""
SELECT source, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, text) AS rank FROM documents
WHERE regexp_matches(lower(text), 'thth|ández|ausch')) WHERE rank <= 5
""")
def hiring_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("title"), F.timestamp_seconds(F.col("doc_id") * 86_400).alias("published"))
    got = reports.hiring_signals(items, "source", "title", "published", ["thth", "ández", "ausch"], F.timestamp_seconds(F.lit(0)))
    return got.select("source", "doc_id", "rank")
