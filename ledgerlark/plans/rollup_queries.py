"""Rollups, trends, funnels and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import rollups as R
from ledgerlark.plans.registry import EVENTS_AS_OF, query
from ledgerlark.tables import table


@query("""
SELECT count(*) AS total, count(DISTINCT o.o_custkey) AS customers, count(*) FILTER (WHERE c.c_acctbal > 0) AS with_balance,
       count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
       count(*) FILTER (WHERE r.l_orderkey IS NOT NULL) AS with_returns, CAST(round(avg(CAST(o_totalprice AS DECIMAL(18,2))), 1) AS DOUBLE) AS average_price
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON r.l_orderkey = o.o_orderkey
""")
def overview_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    conditions = {
        "with_balance": F.col("c_acctbal") > 0,
        "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "finished": F.col("o_orderstatus") == "F",
        "with_returns": F.col("l_orderkey").isNotNull(),
    }
    mean = F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")), 1).cast("double")
    return R.conditional_counts(rows, conditions, total=F.count("*"), customers=F.count_distinct("o_custkey"), average_price=mean)


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 3")
def group_topk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_groups(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), 3)


@query("""
SELECT coalesce(nullif(trim(o_orderpriority), ''), nullif(trim(c_mktsegment), ''), 'unknown') AS value, count(*) AS count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1
""")
def group_coalesce_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    rows = table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left")
    return R.top_groups(rows, R.or_unknown(F.col("o_orderpriority"), F.col("c_mktsegment")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1")
def trend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_day(table(spark, sf_dir, "events"), "ts", F.to_timestamp_ntz(F.lit(EVENTS_AS_OF)), 14)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS count FROM orders GROUP BY 1, 2")
def by_month_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("count"))


@query("""
SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN p <= 50000 THEN 'under_50k' WHEN p <= 200000 THEN '50k_to_2L' WHEN p <= 500000 THEN '2L_to_5L' ELSE 'above_5L' END AS bucket,
       count(*) AS count FROM (SELECT nullif(o_totalprice, 0) * 1.2 AS p FROM orders) GROUP BY 1
""")
def bucket_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlark.functions.money import prize_bucket

    price = F.nullif(F.col("o_totalprice"), F.lit(0.0)) * 1.2
    return table(spark, sf_dir, "orders").groupBy(prize_bucket(price).alias("bucket")).agg(F.count("*").alias("count"))


@query("SELECT o_custkey AS value, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 15")
def having_repeat_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_groups(table(spark, sf_dir, "orders"), F.col("o_custkey"), at_least=16)


@query("SELECT event_type, CASE WHEN value >= 100 THEN 'large' ELSE 'small' END AS result, count(*) AS count FROM events GROUP BY 1, 2")
def two_key_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("value") >= 100, "large").otherwise("small").alias("result")
    return table(spark, sf_dir, "events").groupBy("event_type", result).agg(F.count("*").alias("count"))


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value >= 50) AS good, round(count(*) FILTER (WHERE value >= 50)::DOUBLE / count(*)::DOUBLE * 100, 1) AS rate FROM events GROUP BY 1
""")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.success_rate(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50)


@query("""
WITH u AS (SELECT event_type AS provider, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS used FROM events GROUP BY 1),
l AS (SELECT *, CASE provider WHEN 'click' THEN 100000.0::DOUBLE WHEN 'view' THEN 50000.0::DOUBLE WHEN 'purchase' THEN 10.0::DOUBLE END AS "limit" FROM u)
SELECT provider, calls, used, "limit", round(greatest(0.0::DOUBLE, CASE WHEN "limit" IS NOT NULL THEN "limit" - used END), 2) AS remaining,
       round(least(100.0::DOUBLE, CASE WHEN "limit" IS NOT NULL THEN used / "limit" * 100 END), 1) AS percent FROM l
""")
def usage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usage_budget(table(spark, sf_dir, "events"), "event_type", "value", {"click": 100_000, "view": 50_000, "purchase": 10})


@query("""
WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'signup') a, count(*) FILTER (WHERE event_type = 'view') b, count(*) FILTER (WHERE event_type = 'click') d,
                  count(*) FILTER (WHERE event_type = 'refund') e, count(*) FILTER (WHERE event_type = 'purchase') f FROM events)
SELECT 0 AS step, 'signup' AS stage, a AS count, CAST(NULL AS DOUBLE) AS conversion FROM c
UNION ALL SELECT 1, 'view', b, round(b::DOUBLE / nullif(a, 0)::DOUBLE * 100, 1) FROM c
UNION ALL SELECT 2, 'click', d, round(d::DOUBLE / nullif(b, 0)::DOUBLE * 100, 1) FROM c
UNION ALL SELECT 3, 'refund', e, round(e::DOUBLE / nullif(d, 0)::DOUBLE * 100, 1) FROM c
UNION ALL SELECT 4, 'purchase', f, round(f::DOUBLE / nullif(e, 0)::DOUBLE * 100, 1) FROM c
""")
def funnel_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.funnel(table(spark, sf_dir, "events"), "event_type", ("signup", "view", "click", "refund", "purchase"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS years, CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def distinct_years_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    year = F.year("o_orderdate")
    return rows.groupBy("o_custkey").agg(F.array_join(R.sorted_distinct(year).cast("array<string>"), ",").alias("years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


@query("""
SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS items
FROM lineitem GROUP BY 1 HAVING count(*) >= 2
""")
def children_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("x")).where("n >= 2")
    return got.select("l_orderkey", "n", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"], s["l_returnflag"])), ",").alias("items"))


@query("""
SELECT 'orders' AS domain, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2
""")
def union_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [R.top_groups(table(spark, sf_dir, t), F.col(c)).select(F.lit(t).alias("domain"), "value", "count") for t, c in (("orders", "o_orderstatus"), ("events", "event_type"), ("documents", "lang"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH x AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2)
SELECT dimension, value, count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS rank FROM x) WHERE rank <= 4
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivot_counts(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 4)


@query("""
WITH k AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o.o_custkey, count(*) AS contacts, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS emails, min(o_orderpriority) AS best_priority,
       (SELECT string_agg(k.o_orderstatus || '=' || k.n, ',' ORDER BY k.o_orderstatus) FROM k WHERE k.o_custkey = o.o_custkey) AS by_role
FROM orders o GROUP BY 1
""")
def coverage_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.when(F.col("o_totalprice") > 250000, F.lit(1))
    got = R.coverage(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", mail, F.col("o_orderpriority"))
    return got.withColumn("by_role", F.array_join(F.transform(F.map_entries("by_role"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("""
SELECT 'orders' AS domain, '{"total":' || count(*) || ',"open":' || count(*) FILTER (WHERE o_orderstatus = 'O') || '}' AS metrics FROM orders
""")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return R.metrics_json(one, "orders")


@query("""
SELECT json_extract_string(props, '$.k')::INT % 10 AS k, count(*) AS count, CAST(round(avg(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS mean_value FROM events GROUP BY 1
""")
def json_path_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count("*").alias("count"), F.round(F.avg(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("mean_value"))


@query("""
SELECT m AS median_price, round(n::DOUBLE / s::DOUBLE, 4) AS mode_share
FROM (SELECT median(o_totalprice) AS m FROM orders), (SELECT max(n) AS n, sum(n) AS s FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))
""")
def median_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    share = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 4).alias("mode_share"))
    return orders.agg(F.median("o_totalprice").alias("median_price")).withColumn("mode_share", share.scalar())
