"""Scores, quality, freshness, readiness and recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import dates as D
from ledgerlark.functions import scoring as Z
from ledgerlark.operators import prediction, ranking, sweeps
from ledgerlark.plans.registry import EVENTS_AS_OF, ORDERS_AS_OF, query
from ledgerlark.tables import table


@query("SELECT c_custkey, CASE WHEN s >= 70 THEN 'hot' WHEN s >= 40 THEN 'warm' ELSE 'cold' END AS band, CAST(greatest(1, least(10, round(s / 10.0))) AS INT) AS score_10 FROM (SELECT c_custkey, c_custkey % 101 AS s FROM customer)")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("c_custkey") % 101
    return table(spark, sf_dir, "customer").select("c_custkey", Z.score_band(score).alias("band"), Z.score_10(score).alias("score_10"))


@query("""
SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 10 ELSE 0 END
  + least(10, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END + 4 + CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END) + CASE WHEN c_custkey % 6 = 0 THEN 10 ELSE 0 END AS INT) AS score,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS parts
FROM customer
""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    x = F.lit("x")
    columns = {
        "hr_name": F.when(key % 2 == 0, x), "hr_personal_email": F.when(key % 6 == 0, x), "hr_personal_mobile": F.when(key % 3 == 0, x), "hr_linkedin_url": F.when(key % 5 == 0, x).otherwise(" "),
        "company_default_email": F.when(F.col("c_acctbal") > 0, x), "company_default_phone": F.lit(None).cast("string"), "salary_range": F.when(F.col("c_mktsegment") == "BUILDING", x),
        "job_description": F.repeat(F.lit("word "), 30), "job_url": F.when(key % 7 == 0, x), "email_status": F.when(key % 6 == 0, "valid").otherwise("risky"), "whatsapp_status": F.lit(None).cast("string"),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", Z.lead_score(columns).alias("score"), F.size(Z.breakdown(Z.lead_parts(columns))).alias("parts"))


@query("""
SELECT doc_id, CAST(round_even(CAST(5 * (lang = 'en')::INT + 3 * (quality IS NOT NULL)::INT + 2 * (toxic = 1 AND toxic IS NOT NULL)::INT + 4 * (n_chars > 1000)::INT AS DOUBLE) / 14.0 * 100, 0) AS INT) AS score,
       array_to_string(list_filter([CASE WHEN lang <> 'en' THEN 'english' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL OR toxic <> 1 THEN 'toxic' END, CASE WHEN n_chars <= 1000 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS missing
FROM documents LEFT JOIN labels USING (doc_id)
""")
def completeness_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = {"english": (F.col("lang") == "en", 5), "quality": (F.col("quality").isNotNull(), 3), "toxic": (F.coalesce(F.col("toxic") == 1, F.lit(False)), 2), "long": (F.col("n_chars") > 1000, 4)}
    score, missing = Z.completeness(fields)
    return rows.select("doc_id", score.alias("score"), F.array_join(missing, ",").alias("missing"))


@query("""
SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN age < 1 THEN 'fresh' WHEN age < 7 THEN 'recent' ELSE 'older' END AS freshness
FROM (SELECT (epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate)) / 86400.0 AS age FROM orders)) GROUP BY 1
""")
def freshness_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(ORDERS_AS_OF).cast("timestamp")
    return table(spark, sf_dir, "orders").groupBy(D.posting_freshness(F.col("o_orderdate").cast("timestamp"), as_of).alias("freshness")).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, freshness, count(*) AS n FROM (SELECT event_type, CASE WHEN age <= 1 THEN 'fresh' WHEN age <= 7 THEN 'recent' WHEN age <= 30 THEN 'aging' ELSE 'stale' END AS freshness
FROM (SELECT event_type, (floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts))) / 86400.0 AS age FROM events)) GROUP BY 1, 2
""")
def freshness_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(EVENTS_AS_OF).cast("timestamp")
    fresh = D.record_freshness("jobs", as_of, F.col("ts").cast("timestamp"), F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type", fresh.alias("freshness")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS locators, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) = 1 AS verified, count(DISTINCT o_orderpriority) AS points, c_custkey % 90 AS score
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN verified AND locators >= 1 AND points >= 1 THEN 'OUTREACH_READY' WHEN locators >= 1 THEN 'PARTIALLY_ENRICHED' WHEN c_acctbal >= 30 THEN 'NEEDS_ENRICHMENT' ELSE 'INSUFFICIENT_DATA' END AS readiness FROM c)
SELECT c_custkey, readiness, CASE WHEN readiness IN ('OUTREACH_READY', 'PARTIALLY_ENRICHED') THEN CASE WHEN score >= 75 THEN 'P0' WHEN score >= 58 THEN 'P1' WHEN score >= 40 THEN 'P2' ELSE 'P3' END WHEN score < 25 THEN 'P4' ELSE 'P3' END AS priority
FROM r ORDER BY score DESC, list_position(['OUTREACH_READY', 'PARTIALLY_ENRICHED', 'NEEDS_ENRICHMENT', 'INSUFFICIENT_DATA'], readiness), c_custkey LIMIT 200
""")
def readiness_priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    got = table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_acctbal")
    got = got.agg(F.count("o_orderkey").alias("locators"), F.max(F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).alias("verified"), F.count_distinct("o_orderpriority").alias("points"))
    got = got.withColumn("score", F.col("c_custkey") % 90).withColumn("readiness", Z.readiness(F.col("verified"), F.col("locators"), F.col("c_acctbal"), F.col("points")))
    got = got.withColumn("priority", Z.priority(F.col("score"), F.col("readiness")))
    return got.orderBy(F.desc("score"), ranking.readiness_order(F.col("readiness")), "c_custkey").limit(200).select("c_custkey", "readiness", "priority")


@query("""
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_suppkey % 8 = 0 THEN 30 ELSE 40 END ELSE 12 END
 + CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 30 ELSE 10 END ELSE 0 END + CASE WHEN s_acctbal > 5000 THEN 15 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 3 END END AS INT) AS points FROM supplier
""")
def locator_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    mail = F.when(key % 8 == 0, "placement.office@x.edu").otherwise("asha.rao@x.edu")
    status = F.when(key % 10 == 9, "bounced").when(key % 4 == 0, "Verified")
    points = Z.locator_score(mail, F.when(key % 3 == 0, "+91 98765 43210").otherwise("999-999-9999"), F.when(F.col("s_acctbal") > 5000, "in/x"), status, F.when(key % 2 == 0, "A+").otherwise("b"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", points.alias("points"))


@query("""
WITH v AS (SELECT p_partkey, p_size, least(100, (CASE WHEN p_type = 'PROMO' THEN 100 WHEN p_type = 'SMALL' THEN 70 WHEN p_type = 'ECONOMY' THEN 20 ELSE 10 END) ) AS base, p_size % 4 AS sources FROM part),
w AS (SELECT *, greatest(0, least(100, least(100, base + CASE WHEN p_size % 3 = 0 THEN 5 WHEN p_size % 3 = 2 THEN -10 ELSE 0 END) + CASE WHEN sources >= 3 THEN 10 WHEN sources >= 2 THEN 5 ELSE 0 END)) AS verification FROM v)
SELECT p_partkey, CAST(verification AS INT) AS verification, CAST(round_even((verification * 4 + least(100, sources * 40) * 3 + p_size * 3) / 10.0, 0) AS INT) AS confidence,
       CASE WHEN sources >= 3 THEN 'high' WHEN sources = 2 THEN 'medium' WHEN sources = 1 THEN 'single_source' END AS source_quality FROM w
""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_type") == "PROMO", "cross_verified").when(F.col("p_type") == "SMALL", "partially_verified").when(F.col("p_type") == "ECONOMY", "unverified")
    grade, sources = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("p_size") % 3 + 1), F.col("p_size") % 4
    verification = Z.verification_score(status, grade, sources)
    return table(spark, sf_dir, "part").select("p_partkey", verification.alias("verification"), Z.confidence_score(verification, sources, F.col("p_size"), F.lit(False)).alias("confidence"), Z.source_quality(sources).alias("source_quality"))


@query("""
WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders WHERE o_orderpriority = '1-URGENT'),
g AS (SELECT o_custkey, count(*) AS n, max(y) AS last_year, list_sort(list(m)) AS ms, count(DISTINCT y) AS k FROM o GROUP BY 1),
i AS (SELECT o_custkey, list_sort(list(gap)) AS gaps FROM (SELECT o_custkey, y - lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS gap FROM (SELECT DISTINCT o_custkey, y FROM o)) WHERE gap IS NOT NULL GROUP BY 1),
s AS (SELECT g.o_custkey, n, last_year, CAST(floor((ms[CAST((n + 1) // 2 AS INT)] + ms[CAST(n // 2 + 1 AS INT)]) / 2.0) AS INT) AS mon, CAST(floor((gaps[CAST(k // 2 AS INT)] + gaps[CAST((k - 1) // 2 + 1 AS INT)]) / 2.0) AS INT) AS step,
        list_max(list_transform(list_distinct(ms), lambda v: len(list_filter(ms, lambda x: x = v)))) / len(ms)::DOUBLE AS mshare, list_max(list_transform(list_distinct(gaps), lambda v: len(list_filter(gaps, lambda x: x = v)))) / len(gaps)::DOUBLE AS gshare,
        list_min(gaps) = 1 AND list_max(gaps) = 1 AS annual FROM g JOIN i USING (o_custkey) WHERE n >= 2 AND k >= 2),
c AS (SELECT *, step >= 1 AND gshare >= 0.5 AS recurring, CAST(greatest(10, least(90, 35 + 15 * (n - 2) + CASE WHEN mshare >= 0.8 THEN 15 WHEN mshare >= 0.5 THEN 7 ELSE 0 END + CASE WHEN annual THEN 10 ELSE 0 END - CASE WHEN step >= 1 AND gshare >= 0.5 THEN 0 ELSE 20 END)) AS INT) AS confidence FROM s)
SELECT o_custkey, step AS "interval", mon AS "month", confidence, CAST(last_year + step AS INT) AS next_year,
       CASE WHEN NOT recurring THEN 'LOW_CONFIDENCE_PREDICTION' WHEN n >= 3 AND confidence >= 60 THEN 'PREDICTED' ELSE 'RECURRING_PATTERN' END AS status FROM c
""")
def recurrence_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return prediction.recurrence(rows, "o_custkey", F.year("o_orderdate"), F.col("o_orderdate")).select("o_custkey", "interval", "month", "confidence", "next_year", "status")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, max(year(o_orderdate)) + 1 AS next_year, list_sort(list(month(o_orderdate))) AS ms FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT o_custkey, CAST(next_year AS INT) AS next_year, CAST(floor((ms[CAST((n + 1) // 2 AS INT)] + ms[CAST(n // 2 + 1 AS INT)]) / 2.0) AS INT) AS "month",
  CAST(least(85, 30 + 15 * (n - 2) + floor(list_max(list_transform(list_distinct(ms), lambda v: len(list_filter(ms, lambda x: x = v)))) / len(ms)::DOUBLE * 20)) AS INT) AS confidence FROM g)
SELECT *, CASE WHEN confidence >= 55 THEN 'PREDICTED' ELSE 'LOW_CONFIDENCE_PREDICTION' END AS status FROM s
""")
def cycle_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'")
    return prediction.cycle(rows, "o_custkey", F.col("o_orderdate")).drop("observations")


@query("""
SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW' AND o_orderstatus = 'P')
""")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    people = table(spark, sf_dir, "customer").withColumn("seen", F.when(F.col("c_acctbal") < 0, F.lit("1990-01-01")).otherwise(F.lit("1999-12-31")).cast("timestamp"))
    barred = orders.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'P'").select("c_custkey").union(spark.createDataFrame([(None,)], "c_custkey long"))
    got = sweeps.retention(people, orders.where("o_totalprice > 450000"), barred, "c_custkey", "seen", F.lit(ORDERS_AS_OF).cast("timestamp"), 365)
    return got.select("c_custkey")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100
""")
def sweep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return sweeps.candidates(table(spark, sf_dir, "orders"), done, "o_orderkey", [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")], 100).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR - INTERVAL 20 DAY")
def stuck_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_timestamp_ntz(F.lit(EVENTS_AS_OF)) - F.make_dt_interval(days=F.lit(20))
    return sweeps.stuck(table(spark, sf_dir, "events"), "event_type", ("view", "click"), "ts", as_of, 6).select("event_id")


@query("SELECT event_id, age FROM (SELECT event_id, CASE WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 172800 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS BIGINT) AS s FROM events))")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.relative_age(F.col("ts").cast("timestamp"), F.lit(EVENTS_AS_OF).cast("timestamp")).alias("age"))
