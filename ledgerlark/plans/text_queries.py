"""Text, URLs, money and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import dates as D
from ledgerlark.functions import money as M
from ledgerlark.functions import strings as S
from ledgerlark.plans.registry import query
from ledgerlark.sources import markup, tabular
from ledgerlark.tables import table


@query("SELECT doc_id, sha256(lower(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g')) || '|' || lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) || '|') AS fingerprint FROM documents")
def fingerprint_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.fingerprint(F.col("source"), F.col("text"), F.lit("")).alias("fingerprint"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return got.where("copies > 1").select("doc_id", "copies")


@query(r"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'initech' WHEN 2 THEN 'globex' ELSE 'umbrella' END || CAST(c_custkey AS VARCHAR) AS key FROM customer
""")
def company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    name = F.when(key == 0, F.concat(F.lit("ACME-"), n, F.lit(" Pvt. Ltd."))).when(key == 1, F.concat(F.lit("Initech "), n, F.lit(", Inc"))).when(key == 2, F.concat(F.lit(" Globex  "), n, F.lit(" Private Limited"))).otherwise(F.concat(F.lit("umbrella "), n))
    return table(spark, sf_dir, "customer").select("c_custkey", S.company_key(name).alias("key"))


@query(r"SELECT page_id, rtrim(lower(regexp_replace(url, '[?#].*$', '')), '/') AS url_key FROM pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.url_key(F.col("url")).alias("url_key"))


@query(r"""
WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT host, list_extract(string_split(host, '.'), -2) || '.' || list_extract(string_split(host, '.'), -1) AS domain, count(*) AS pages FROM h GROUP BY 1, 2
""")
def host_and_domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(S.host(F.col("url")).alias("host"), S.registrable(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"') AS t FROM b)
SELECT page_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS text_md5 FROM c
""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(S.strip_html(F.col("html"), None)).alias("text_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.clean_text(F.col("text"), None)).alias("text_md5"))


_UNIT_SQL = "CASE {0} " + " ".join(f"WHEN '{u}' THEN {f:.1f}" for u, f in M.UNITS.items()) + " ELSE 1.0 END"
_MONEY = r"([0-9]+(?:\.[0-9]+)?)\s*(lakhs|lakh|lpa|lacs|lac|crore|cr|thousand|k|million|mn)?"


@query(f"""
SELECT doc_id, CASE WHEN v > 0 THEN v END AS amount FROM (SELECT doc_id, TRY_CAST(regexp_extract(t, '{_MONEY}', 1) AS DOUBLE) * {_UNIT_SQL.format(f"regexp_extract(t, '{_MONEY}', 2)")} AS v
FROM (SELECT doc_id, replace(lower(coalesce(text, '')), ',', '') AS t FROM documents))
""")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.parse_money(F.col("text")).alias("amount"))


@query(r"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(regexp_replace(t, '([0-9])\s*k([^\pL\pN_]|$)', '\1' || chr(1) || '\2', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?' || chr(1) || '?') AS found, regexp_matches(t, '₹|(^|[^\pL\pN_])(rs|inr)([^\pL\pN_]|$)|(^|[^\pL\pN_])rs\.') AS rupees FROM d),
v AS (SELECT *, list_transform(found, lambda x: TRY_CAST(replace(replace(x, ',', ''), chr(1), '') AS DOUBLE) * CASE WHEN contains(x, chr(1)) THEN 1000.0 ELSE 1.0 END) AS n FROM m),
s AS (SELECT *, CASE WHEN regexp_matches(t, 'lakh|lpa| lac') THEN 1e5 WHEN regexp_matches(t, 'crore|cpa') THEN 1e7 WHEN rupees AND list_max(n) <= 500 THEN 1e5 ELSE 1.0 END AS f FROM v),
e AS (SELECT *, n[1] * f AS a, n[-1] * f AS b FROM s)
SELECT doc_id, CASE WHEN a >= 1000 AND b >= 1000 THEN least(a, b) END AS low, CASE WHEN a >= 1000 AND b >= 1000 THEN greatest(a, b) END AS high,
  CASE WHEN rupees THEN 'INR' WHEN contains(t, '$') THEN 'USD' WHEN contains(t, '€') THEN 'EUR' WHEN contains(t, '£') THEN 'GBP' ELSE '' END AS currency,
  CASE WHEN regexp_matches(t, 'month|/mo') THEN 'month' WHEN regexp_matches(t, 'year|annum|lpa|p\.a') THEN 'year' ELSE '' END AS period FROM e
""")
def salary_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = M.salary_bounds(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in parts.items()))


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') WHEN 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day FROM orders
""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMMM d, yyyy", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM yyyy"]
    said = F.concat(F.lit("on "), F.date_format(day, "yyyy"))
    for k, form in enumerate(forms):
        said = F.when(F.col("o_orderkey") % 8 == k, F.date_format(day, form)).otherwise(said)
    return table(spark, sf_dir, "orders").withColumn("said", said).select("o_orderkey", F.date_format(D.parse_datetime(F.col("said")), "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("""
WITH o AS (SELECT *, o_orderdate + to_days(CAST(o_custkey % 40 AS INT)) AS e, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 4 THEN NULL WHEN k = 2 AND year(o_orderdate) <> year(e) THEN strftime(least(o_orderdate + to_years(CAST(year(e) - year(o_orderdate) AS INT)), e), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS first_day,
  CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN strftime(last_day(e), '%Y-%m-%d') WHEN k = 2 AND year(o_orderdate) <> year(e) THEN strftime(greatest(o_orderdate + to_years(CAST(year(e) - year(o_orderdate) AS INT)), e), '%Y-%m-%d') ELSE strftime(e, '%Y-%m-%d') END AS last_day FROM o
""")
def parse_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    end = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_custkey") % 40).cast("int"))

    def said(first: str, between: str, last: str) -> Column:
        return F.concat(F.date_format(start, first), F.lit(between), F.date_format(end, last))

    text = (
        F.when(k == 0, said("yyyy-MM-dd", " to ", "yyyy-MM-dd"))
        .when(k == 1, F.concat(F.date_format(end, "d MMM yyyy"), F.lit(" until "), F.date_format(start, "d MMM yyyy")))
        .when(k == 2, said("MMM dd", " - ", "MMM dd, yyyy"))
        .when(k == 3, said("dd/MM/yyyy", " – ", "MMM yyyy"))
        .otherwise(F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(" ongoing")))
    )
    got = D.date_range(F.col("said"))
    return table(spark, sf_dir, "orders").withColumn("said", text).select("o_orderkey", F.date_format(got["start"], "yyyy-MM-dd").alias("first_day"), F.date_format(got["end"], "yyyy-MM-dd").alias("last_day"))


@query("""
SELECT event_id, strftime(TIMESTAMP '2024-02-10' - to_days(CAST(json_extract_string(props, '$.k') AS INT)), '%Y-%m-%d') AS posted FROM events
""")
def posted_at_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.get_json_object("props", "$.k"), F.lit(" days ago"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(D.posted_at(said, F.lit("2024-02-10").cast("timestamp")), "yyyy-MM-dd").alias("posted"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '[url]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '[phone]', 'g')) AS redacted_md5 FROM documents
""")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.redact(F.col("text"))).alias("redacted_md5"))


@query(r"SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^[-+=@|\t\r\n]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '=1+' WHEN 1 THEN '@x' ELSE 'ok' END || o_orderstatus AS cell FROM orders)")
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    cell = F.concat(F.when(key == 0, "=1+").when(key == 1, "@x").otherwise("ok"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.formula_guard(cell).alias("cell"))


@query("""
SELECT c_custkey, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '"' AS line FROM customer
""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tabular.csv_line(F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)"))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query("""
SELECT user_id, CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN sha256('email|u' || user_id || '@x.com') WHEN user_id % 3 = 1 THEN sha256('phone|' || right('919876500000' || lpad(CAST(user_id AS VARCHAR), 3, '0'), 10)) END AS identity, count(*) AS n FROM events GROUP BY 1, 2
""")
def contact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    mail = F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0), F.concat(F.lit(" U"), u, F.lit("@X.com ")))
    phone = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("+91 98765-00000"), F.lpad(u, 3, "0")))
    identity = S.contact_identity(mail, phone, F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id", identity.alias("identity")).agg(F.count("*").alias("n"))


@query(r"""
WITH n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{7,}[0-9]'))) AS number FROM documents),
d AS (SELECT *, regexp_replace(regexp_replace(number, '[^0-9]', '', 'g'), '^0+', '') AS d FROM n)
SELECT doc_id, number, CASE WHEN regexp_full_match(d, '[6-9][0-9]{9}') THEN '+91' || d WHEN regexp_full_match(d, '91[6-9][0-9]{9}') OR starts_with(number, '+') AND length(d) BETWEEN 8 AND 15 THEN '+' || d END AS e164 FROM d
""")
def mobile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\+?[0-9][0-9 ()-]{7,}[0-9]"), F.lit(0)))
    numbers = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("number"))
    return numbers.select("doc_id", "number", S.mobile_e164(F.col("number")).alias("e164"))


_LABEL = r"^[a-zA-Z]+://(?:www\.|m\.)?([a-zA-Z0-9-]+)"


@query(rf"SELECT page_id, CASE WHEN page_id % 4 < 3 THEN nullif(lower(regexp_extract(url, '{_LABEL}', 1)), '') END AS slug FROM pages")
def ats_slug_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of the pages' hosts at three trackers, and the pages' own addresses, which are at none."""
    key, label = F.col("page_id") % 4, F.regexp_extract("url", _LABEL, 1)
    url = (
        F.when(key == 0, F.concat(F.lit("https://boards.greenhouse.io/"), label, F.lit("/jobs/"), key))
        .when(key == 1, F.concat(F.lit("https://jobs.lever.co/"), label, F.lit("/2?x=1")))
        .when(key == 2, F.concat(F.lit("https://"), label, F.lit(".recruitee.com/o/dev")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", markup.ats_slug(url).alias("slug"))


@query(r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href\s*=\s*"([^"]+)"[^>]*>')) AS INT) AS n_links, regexp_extract(html, '<a\s[^>]*href\s*=\s*"([^"]+)"', 1) AS first_href FROM pages
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n_links"), F.coalesce(F.get(found, 0)["href"], F.lit("")).alias("first_href"))


@query(r"""
SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS INT) AS emails,
       CAST(len(list_distinct(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{7,}[0-9]'))) AS INT) AS phones FROM documents
""")
def role_contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = markup.contacts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(got["emails"]).alias("emails"), F.size(got["phones"]).alias("phones"))


_LD = '<script type="application/ld+json">{"@type": "Event", "name": "A %d"}</script><script type="application/ld+json">not json</script>'


@query("SELECT page_id, 'A ' || page_id AS name FROM pages WHERE page_id % 2 = 0")
def jsonld_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.col("html"), F.format_string(_LD, "page_id"))).otherwise(F.col("html"))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.json_ld_of_type(html, "event")).alias("x"))
    return found.select("page_id", F.get_json_object("x", "$.name").alias("name"))


@query("""
SELECT page_id, 'College ' || page_id AS name, 'S' || (page_id % 5) AS state FROM pages UNION ALL SELECT page_id, 'Other', 'X' FROM pages
""")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.format_string("<table><tr><th>Name</th><th>State</th></tr><tr><td>College %d<td>S%d</tr><tr><td> Other </td><td>X</td></tr></table>", F.col("page_id"), F.col("page_id") % 5)
    rows = markup.html_tables(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return rows.select("page_id", F.col("cells")["name"].alias("name"), F.col("cells")["state"].alias("state"))


@query("SELECT page_id, 'T' || page_id AS title, 'https://x.org/' || page_id AS link FROM pages")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.format_string("<rss><item><title><![CDATA[T%d]]></title><link>https://x.org/%d</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item></rss>", "page_id", "page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(markup.feed_items(xml)).alias("x")).select("page_id", "x.title", "x.link")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN true WHEN event_type = 'error' THEN false END AS flag FROM events")
def parse_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("event_type") == "view", " Yes ").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "error", "NOT allowed").otherwise("maybe")
    return table(spark, sf_dir, "events").select("event_id", S.parse_bool(word).alias("flag"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, 'x'])), '|') AS parts FROM part")
def list_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" ; ", "p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit("x|x, "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(S.as_list(raw)), "|").alias("parts"))


@query()
def name_key_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.name_key(F.col("text")).alias("key"), S.slug(F.col("source")).alias("slug"))


@query(f"""
SELECT p_partkey, len(w) >= 2 AND len(list_filter(w, lambda x: len(x) < 2 OR NOT regexp_full_match(x, '[a-z]+') OR x IN ({", ".join(f"'{n}'" for n in S.NO_NAMES)}))) = 0 AS is_person
FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
""")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.person_name(F.initcap("p_name")).alias("is_person"))
