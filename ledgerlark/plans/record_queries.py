"""Roles, states and identities of records over whole tables, and delimited files written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import dates
from ledgerlark.functions import scoring as P
from ledgerlark.functions import strings as S
from ledgerlark.operators import filters, lifecycle, sweeps
from ledgerlark.plans.registry import EVENTS_AS_OF, query
from ledgerlark.sources import tabular
from ledgerlark.tables import table
from ledgerlark.workspace import scratch


def _title_sql(text: str) -> str:
    hits = " ".join(f"WHEN {' OR '.join(f'contains({text}, {n!r})' for n in needles)} THEN '{role}'" for role, needles in P.TITLE_ROLES)
    return f"CASE WHEN {text} = '' THEN '' {hits} ELSE 'other' END"


def _case_sql(column: str, values: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


@query(f"""
WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS said, [{", ".join(f"'{r}'" for r in P.ROLES["colleges"])}][conv_id % {len(P.ROLES["colleges"])} + 1] AS role FROM conversations)
SELECT conv_id, turn, {_title_sql("said")} AS title_role, {_case_sql("role", P.ROLE_PRIORITY["colleges"], "'P4'")} AS priority, {_case_sql("role", P.ROLES["colleges"], "0")}::BIGINT AS weight,
 regexp_matches(said, '^\\s*0(\\s*-|\\s*to)') OR contains(said, 'fresher') OR contains(said, 'entry') OR contains(said, 'intern') AS beginner FROM t
""")
def contact_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(P.ROLES["colleges"])
    role = F.get(F.array(*(F.lit(f" {n.upper()} ") for n in names)), (F.col("conv_id") % len(names)).cast("int"))
    plain = F.get(F.array(*(F.lit(n) for n in names)), (F.col("conv_id") % len(names)).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", P.title_role(F.coalesce("text", F.lit(""))).alias("title_role"), P.role_priority("colleges", role).alias("priority"),
        P.role_weight("colleges", plain).cast("long").alias("weight"), filters.experience("fresher", F.trim("text")).alias("beginner"),
    )


_STATUS = ", ".join(f"('{k}', {v})" for k, v in lifecycle.STATUS_RANKS.items())


@query(f"""
WITH r(status, rank) AS (VALUES {_STATUS}),
d AS (SELECT doc_id, n_chars, TIMESTAMP '{EVENTS_AS_OF}' - to_days((n_chars % 60)::INT) AS checked, ['FAILED', 'enriching', 'ENRICHED', 'other', NULL][doc_id % 5 + 1] AS step, ['verified', 'Cross_Verified', 'failed', NULL][n_chars % 4 + 1] AS proof,
 regexp_matches(coalesce(text, ''), '[0-9]') AS reach, n_chars % 101 AS complete, [NULL, 'ANNOUNCED', 'REGISTRATION_OPEN', 'COMPLETED', 'HISTORICAL', 'ONGOING'][doc_id % 6 + 1] AS old, ['predicted', 'REGISTRATION_CLOSED', 'odd', 'completed'][n_chars % 4 + 1] AS new FROM documents),
m AS (SELECT d.*, CASE upper(new) WHEN 'PREDICTED' THEN 'ANNOUNCED' ELSE upper(new) END AS said FROM d)
SELECT doc_id, checked < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY AS stale,
 CASE WHEN step = 'FAILED' THEN 'FAILED' WHEN lower(proof) IN ('verified', 'cross_verified') THEN 'VERIFIED' WHEN n_chars % 60 > 30 THEN 'STALE' WHEN upper(step) IN ('ENRICHING', 'ENRICHED') THEN upper(step) WHEN reach THEN 'ENRICHED' WHEN complete < 20 THEN 'NEEDS_REVIEW' ELSE 'NORMALIZED' END AS state,
 CASE WHEN old = 'HISTORICAL' THEN old WHEN coalesce(a.rank, 0) >= coalesce(b.rank, 0) THEN said ELSE old END AS advanced,
 (CASE WHEN n_chars % 60 <= 3 THEN 20 WHEN n_chars % 60 <= 14 THEN 14 WHEN n_chars % 60 <= 45 THEN 8 ELSE 0 END)::BIGINT AS job_points,
 (CASE WHEN n_chars % 90 <= 14 THEN 22 WHEN n_chars % 90 <= 45 THEN 14 ELSE 8 END)::BIGINT AS event_points, (CASE WHEN doc_id % 12 + 1 BETWEEN 7 AND 12 THEN 12 WHEN doc_id % 12 + 1 BETWEEN 4 AND 6 THEN 8 ELSE 4 END)::BIGINT AS season
FROM m LEFT JOIN r a ON a.status = said LEFT JOIN r b ON b.status = old
""")
def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n, now = F.col("doc_id"), F.col("n_chars"), F.lit(EVENTS_AS_OF).cast("timestamp_ntz")

    def pick(of: Column, *values: str | None) -> Column:
        return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (of % len(values)).cast("int"))

    fresh = F.when(n % 60 > 30, "stale").otherwise("fresh")
    state = P.quality_state(pick(key, "FAILED", "enriching", "ENRICHED", "other", None), pick(n, "verified", "Cross_Verified", "failed", None), fresh, F.coalesce(F.col("text"), F.lit("")).rlike("[0-9]"), n % 101)
    moved = lifecycle.advance_status(pick(key, None, "ANNOUNCED", "REGISTRATION_OPEN", "COMPLETED", "HISTORICAL", "ONGOING"), pick(n, "predicted", "REGISTRATION_CLOSED", "odd", "completed"))
    points = {"job_points": P.job_freshness_points(n % 60), "event_points": P.event_freshness_points(n % 90, F.lit(None).cast("int"), F.lit("x")), "season": P.season_points(key % 12 + 1)}
    return table(spark, sf_dir, "documents").select(
        "doc_id", dates.is_stale(now - F.make_dt_interval(days=(n % 60).cast("int")), now).alias("stale"), state.alias("state"), moved.alias("advanced"), *(c.cast("long").alias(m) for m, c in points.items()),
    )


@query(r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS k, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS h FROM pages)
SELECT page_id, sha256(k || '|' || page_id || '|' || h) AS event, sha256(CASE WHEN page_id % 3 = 0 THEN 'aishe|c' || page_id ELSE k || '|' || page_id || '|' || h END) AS college,
 sha256(CASE WHEN page_id % 4 = 0 THEN html ELSE url || '|' || page_id END) AS checksum, lower(regexp_replace(regexp_replace(trim(url), '[.:]+$', ''), '[\s_-]+', '_', 'g')) AS header FROM p
""")
def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, url = F.col("page_id"), F.col("url")
    code, number = F.when(key % 3 == 0, F.concat(F.lit("C-"), key.cast("string"))), key.cast("string")
    part = F.when(key % 4 == 0, "").otherwise(url), F.when(key % 4 == 0, None).otherwise(number)
    return table(spark, sf_dir, "pages").select(
        "page_id", S.event_fingerprint(url, number, url).alias("event"), S.college_fingerprint(url, number, code, url).alias("college"), S.checksum(*part, payload=F.col("html")).alias("checksum"), S.header_key(url).alias("header"),
    )


@query("""
WITH r AS (SELECT source, CASE WHEN count(*) FILTER (WHERE contains(text, '@')) % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (WHERE n_chars > 10000) AS found FROM documents GROUP BY 1),
k AS (SELECT DISTINCT source AS "of", lang || '-' || (doc_id % 7) AS sibling, doc_id % 7 AS tier FROM documents)
SELECT "of", sibling, tier FROM k SEMI JOIN (SELECT source FROM r WHERE status = 'failed' OR found = 0) b ON b.source = k."of" QUALIFY row_number() OVER (PARTITION BY "of" ORDER BY tier, sibling) <= 4
""")
def fallback_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    failed = F.count_if(F.contains("text", F.lit("@"))) % 3 == 0
    runs = docs.groupBy("source").agg(F.when(failed, "failed").otherwise("ok").alias("status"), F.count_if(F.col("n_chars") > 10_000).alias("found"))
    tier = F.col("doc_id") % 7
    kin = docs.select(F.col("source").alias("of"), F.concat("lang", F.lit("-"), tier.cast("string")).alias("sibling"), tier.alias("tier")).distinct()
    return sweeps.fallback_wave(runs, kin, "source").select("of", "sibling", "tier")


@query(r"""
SELECT CASE WHEN regexp_matches(t, '^[-+=@|\t\r\n]') THEN '''' || t ELSE t END AS job_title, role AS company_name, conv_id || '-' || turn AS job_url FROM (SELECT conv_id, turn, role, regexp_replace(text, '\r', '', 'g') AS t FROM conversations)
""")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a delimited file with a sheet's headers and a row that repeats them, read again by what the headers mean."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("Company Name"), F.regexp_replace("text", "\r", "").alias("Designation:"), F.concat_ws("-", "conv_id", "turn").alias("Apply-Link"), F.lit("x").alias("Remark"),
    )
    echo = spark.createDataFrame([("company", "Job Title", "URL", "Remark")], rows.columns)
    path = scratch(spark, "delimited")
    tabular.write_csv(rows.unionAll(echo), path)
    got = tabular.mapped(tabular.read_delimited(spark, path))
    return got.where(~tabular.is_header_echo({c: F.col(c) for c in got.columns})).select("job_title", "company_name", "job_url")
