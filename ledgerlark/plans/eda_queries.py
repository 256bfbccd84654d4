"""Figures of whole domains: events told by documents and their labels, institutions told by pages with conversations as contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import eda
from ledgerlark.plans.registry import EVENTS_AS_OF, query
from ledgerlark.tables import table


def _list_sql(names: dict[str, str], of: str) -> str:
    return " ".join(f"UNION ALL SELECT '{m}', trim(CAST({c} AS VARCHAR)), count(*)::DOUBLE FROM {of} WHERE CAST({c} AS VARCHAR) <> '' GROUP BY 2" for m, c in names.items())


_EVENTS = """
SELECT doc_id, source AS organizer_name, CASE WHEN doc_id % 9 > 0 THEN TIMESTAMP '2022-06-01' + to_days((doc_id % 1200)::INT) END AS event_start, TIMESTAMP '2023-01-01' AS registration_start,
 CASE WHEN doc_id % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) END AS registration_deadline, lang AS state, lang || '/' || source AS city, CASE WHEN contains(text, chr(10)) THEN 'online' ELSE 'offline' END AS mode,
 upper(lang) AS technology, CASE WHEN quality = 1 THEN 'clean' WHEN quality = 0 THEN ' ' END AS domain, CASE WHEN n_chars % 7 > 0 THEN (n_chars - 200) * 120.5 WHEN n_chars % 2 = 0 THEN 0 END AS prize_pool,
 quality = 1 AS student_only, toxic = 1 AS college_only, quality = 0 AS open_to_public, regexp_matches(text, '[#$%&]') AS hiring_opportunities, length(text) > 3000 AS internship_opportunities, source AS source_platform,
 CASE doc_id % 6 WHEN 0 THEN 'historical' WHEN 1 THEN 'PREDICTED' WHEN 2 THEN 'ANNOUNCED' WHEN 3 THEN 'RECURRING_PATTERN' WHEN 4 THEN '' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'recurring' END AS occurrence_type
FROM documents LEFT JOIN labels USING (doc_id)
"""
_NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
_PLAIN = "upper(coalesce(status, '')) NOT IN ('HISTORICAL', 'PREDICTED', 'LOW_CONFIDENCE_PREDICTION', 'RECURRING_PATTERN')"


@query(f"""
WITH e AS ({_EVENTS}), o AS (SELECT organizer_name FROM e WHERE organizer_name <> '' GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT unnest(['no_prize', 'under_50k', '50k_to_2L', '2L_to_5L', 'above_5L', 'unknown']) AS v),
p AS (SELECT CASE WHEN prize_pool IS NULL THEN 'unknown' WHEN prize_pool = 0 THEN 'no_prize' WHEN prize_pool BETWEEN 1 AND 50000 THEN 'under_50k' WHEN prize_pool BETWEEN 50001 AND 200000 THEN '50k_to_2L' WHEN prize_pool BETWEEN 200001 AND 500000 THEN '2L_to_5L' WHEN prize_pool >= 500001 THEN 'above_5L' END AS v FROM e),
m AS (UNPIVOT (SELECT count(*)::DOUBLE AS total, count(*) FILTER ({_PLAIN} AND event_start >= {_NOW})::DOUBLE AS upcoming, count(*) FILTER ({_PLAIN} AND registration_deadline >= {_NOW})::DOUBLE AS registration_open,
  count(*) FILTER ({_PLAIN} AND registration_deadline BETWEEN {_NOW} AND {_NOW} + INTERVAL 14 DAY)::DOUBLE AS registration_closing_soon, count(*) FILTER (upper(status) = 'HISTORICAL')::DOUBLE AS historical,
  count(*) FILTER (upper(status) IN ('PREDICTED', 'RECURRING_PATTERN'))::DOUBLE AS predicted, count(*) FILTER (occurrence_type = 'recurring')::DOUBLE AS recurring_hackathons, (SELECT count(*) FROM o)::DOUBLE AS recurring_organizers,
  count(*) FILTER (student_only)::DOUBLE AS student_only, count(*) FILTER (college_only)::DOUBLE AS college_only, count(*) FILTER (open_to_public)::DOUBLE AS open_to_public, count(*) FILTER (hiring_opportunities)::DOUBLE AS hiring_linked,
  count(*) FILTER (internship_opportunities)::DOUBLE AS internship_linked, round(sum(prize_pool::DECIMAL(18,2))::DOUBLE / count(prize_pool), 2) AS average_prize_pool FROM e) ON COLUMNS(*) INTO NAME metric VALUE n),
x AS (SELECT metric, '' AS value, n FROM m UNION ALL SELECT 'prize_buckets', b.v, count(p.v)::DOUBLE FROM b LEFT JOIN p ON p.v = b.v GROUP BY 2
 UNION ALL SELECT 'by_month', month(coalesce(event_start, registration_start))::VARCHAR, count(*)::DOUBLE FROM e GROUP BY 2 UNION ALL SELECT 'by_year', year(coalesce(event_start, registration_start))::VARCHAR, count(*)::DOUBLE FROM e GROUP BY 2
 {_list_sql(eda.EVENT_FACETS | eda.EVENT_LISTS, "e")})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, value)::INT AS rank FROM x) WHERE rank <= 15 OR metric NOT IN ({", ".join(f"'{m}'" for m in eda.EVENT_FACETS)})
""")
def event_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, zone, text = F.col("doc_id"), "timestamp_ntz", F.col("text")

    def day(start: str, n: int) -> Column:
        return F.lit(start).cast(zone) + F.make_dt_interval(days=(key % n).cast("int"))

    # What is read from the text comes before the join, so texts aren't shuffled.
    read = {"mode": F.when(F.contains("text", F.lit("\n")), "online").otherwise("offline"), "hiring_opportunities": text.rlike("[#$%&]"), "internship_opportunities": F.length("text") > 3000}
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", *(c.alias(n) for n, c in read.items())).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(key % 6 == 0, "historical").when(key % 6 == 1, "PREDICTED").when(key % 6 == 2, "ANNOUNCED").when(key % 6 == 3, "RECURRING_PATTERN").when(key % 6 == 4, "")
    events = docs.select(
        *read, F.col("source").alias("organizer_name"), F.when(key % 9 > 0, day("2022-06-01", 1200)).alias("event_start"), F.lit("2023-01-01").cast(zone).alias("registration_start"),
        F.when(key % 4 > 0, day("2024-01-01", 60)).alias("registration_deadline"), F.col("lang").alias("state"), F.concat("lang", F.lit("/"), "source").alias("city"),
        F.upper("lang").alias("technology"), F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, " ").alias("domain"),
        F.when(F.col("n_chars") % 7 > 0, ((F.col("n_chars") - 200) * F.lit(120.5)).cast("decimal(18,2)")).when(F.col("n_chars") % 2 == 0, F.lit(0)).alias("prize_pool"), (F.col("quality") == 1).alias("student_only"),
        (F.col("toxic") == 1).alias("college_only"), (F.col("quality") == 0).alias("open_to_public"), F.col("source").alias("source_platform"), status.alias("status"), F.when(key % 5 == 0, "recurring").alias("occurrence_type"),
    )
    return eda.event_figures(events, F.lit(EVENTS_AS_OF).cast(zone))


_COLLEGES = """
SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS state, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS district, page_id % 30 AS city, CASE WHEN html LIKE '%<form%' THEN 'university' ELSE 'college' END AS institution_type,
 CASE WHEN url LIKE 'https%' THEN 'private' ELSE 'government' END AS ownership, CASE WHEN page_id % 3 = 0 THEN 'NAAC' END AS accreditation, CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN '' END AS naac_grade,
 CASE WHEN length(html) > 4000 THEN 'enriched' ELSE 'pending' END AS enrichment_status, NULL AS outreach_readiness, CASE WHEN page_id % 7 > 0 THEN url END AS website_url, CASE WHEN page_id % 5 = 0 THEN 'a@b.c' END AS official_email, '' AS phone,
 CASE WHEN page_id % 6 = 0 THEN 'Asha' END AS tpo_name, CASE WHEN page_id % 10 = 0 THEN 'x@y.z' END AS tpo_email, CASE WHEN page_id % 2 = 0 THEN 'P' END AS principal_name, CASE WHEN page_id % 8 = 0 THEN 'D' END AS director_name, NULL AS dean_name,
 page_id % 11 AS nirf_rank, CASE WHEN page_id % 9 > 0 THEN length(html) % 101 END AS completeness_score, [url, '', NULL, 'x.org/a'] AS source_urls FROM pages
"""
_CONTACTS = "SELECT conv_id AS college_id, CASE turn WHEN 0 THEN 'tpo' WHEN 1 THEN 'dean' WHEN 2 THEN 'placement_cell' ELSE role END AS role_category, CASE WHEN length(text) % 2 = 0 THEN text END AS email, CASE WHEN turn > 2 THEN role END AS phone FROM conversations"


@query(f"""
WITH c AS ({_COLLEGES}), k AS ({_CONTACTS}), r AS (SELECT id, count(*) AS n, count(*) FILTER (role_category IN ('tpo', 'placement_head', 'placement_cell')) AS p, count(k.email) AS e, count(k.phone) AS t FROM c JOIN k ON college_id = id GROUP BY 1),
m AS (UNPIVOT (SELECT count(*)::DOUBLE AS total, count(*) FILTER (website_url <> '')::DOUBLE AS with_website, count(*) FILTER (official_email <> '')::DOUBLE AS with_official_email, count(*) FILTER (phone <> '')::DOUBLE AS with_phone,
  count(*) FILTER (coalesce(tpo_name, '') <> '' OR coalesce(tpo_email, '') <> '')::DOUBLE AS tpo_coverage, count(*) FILTER (principal_name <> '')::DOUBLE AS principal_coverage, count(*) FILTER (director_name <> '')::DOUBLE AS director_coverage,
  count(*) FILTER (dean_name IS NOT NULL)::DOUBLE AS dean_coverage, count(*) FILTER (nirf_rank <> 0)::DOUBLE AS nirf_ranked, round(sum(completeness_score)::DOUBLE / count(completeness_score), 1) AS average_completeness,
  count(DISTINCT nullif(state, ''))::DOUBLE AS states_covered, count(DISTINCT nullif(district, ''))::DOUBLE AS districts_covered, coalesce((SELECT sum(n) FROM r), 0)::DOUBLE AS contacts_total, (SELECT count(*) FROM r)::DOUBLE AS colleges_with_contacts,
  (SELECT count(*) FROM r WHERE p > 0)::DOUBLE AS colleges_with_tpo_role, coalesce((SELECT sum(e) FROM r), 0)::DOUBLE AS contact_emails, coalesce((SELECT sum(t) FROM r), 0)::DOUBLE AS contact_phones,
  round((SELECT count(*) FROM r WHERE p > 0) * 100.0 / count(*), 1)::DOUBLE AS placement_role_coverage_pct, round((SELECT sum(n) FROM r)::DOUBLE / count(*), 2) AS average_contacts_per_college FROM c) ON COLUMNS(*) INTO NAME metric VALUE n),
x AS (SELECT metric, '' AS value, n FROM m UNION ALL SELECT 'by_source', split_part(split_part(u, '//', -1), '/', 1), count(*)::DOUBLE FROM (SELECT unnest(source_urls) AS u FROM c) WHERE u <> '' GROUP BY 2 {_list_sql(eda.COLLEGE_FACETS | eda.COLLEGE_LISTS, "c")})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, value)::INT AS rank FROM x) WHERE rank <= CASE WHEN metric = 'by_state' THEN 40 WHEN metric IN ('by_district', 'by_city', 'by_source') THEN 20 ELSE 10000 END
""")
def college_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, key, html, url = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"), F.col("url")
    none = F.lit(None).cast("string")
    colleges = pages.select(
        key.alias("id"), F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1).alias("state"), F.regexp_extract(html, '<html lang="([a-z]*)"', 1).alias("district"), (key % 30).alias("city"),
        F.when(html.contains("<form"), "university").otherwise("college").alias("institution_type"), F.when(url.startswith("https"), "private").otherwise("government").alias("ownership"), F.when(key % 3 == 0, "NAAC").alias("accreditation"),
        F.when(key % 4 == 0, "A").when(key % 4 == 1, "").alias("naac_grade"), F.when(F.length(html) > 4000, "enriched").otherwise("pending").alias("enrichment_status"), none.alias("outreach_readiness"), F.when(key % 7 > 0, url).alias("website_url"),
        F.when(key % 5 == 0, "a@b.c").alias("official_email"), F.lit("").alias("phone"), F.when(key % 6 == 0, "Asha").alias("tpo_name"), F.when(key % 10 == 0, "x@y.z").alias("tpo_email"), F.when(key % 2 == 0, "P").alias("principal_name"),
        F.when(key % 8 == 0, "D").alias("director_name"), none.alias("dean_name"), (key % 11).alias("nirf_rank"), F.when(key % 9 > 0, F.length(html) % 101).alias("completeness_score"), F.array(url, F.lit(""), none, F.lit("x.org/a")).alias("source_urls"),
    )
    turn, text = F.col("turn"), F.col("text")
    contacts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("college_id"), F.when(turn == 0, "tpo").when(turn == 1, "dean").when(turn == 2, "placement_cell").otherwise(F.col("role")).alias("role_category"),
        F.when(F.length(text) % 2 == 0, text).alias("email"), F.when(turn > 2, F.col("role")).alias("phone"),
    )
    return eda.college_figures(colleges, contacts)
