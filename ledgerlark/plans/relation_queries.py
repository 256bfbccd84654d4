"""Joins, filters, windows, sorts, pages and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators import filters as P
from ledgerlark.operators import ranking as K
from ledgerlark.operators import rollups as R
from ledgerlark.operators import sweeps
from ledgerlark.plans.registry import ORDERS_AS_OF, query
from ledgerlark.tables import table


@query("""
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(DISTINCT user_id) FROM events) AS users
""")
def uncorrelated_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "events")}
    return spark.sql("SELECT (SELECT count(*) FROM {customer}) AS customers, (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(DISTINCT user_id) FROM {events}) AS users", **views)


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS n_orders FROM customer")
def per_row_child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    got = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return got.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 450000 THEN o_custkey END FROM orders WHERE o_totalprice > 449000)
""")
def not_in_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    barred = table(spark, sf_dir, "orders").where("o_totalprice > 449000").select(F.when(F.col("o_totalprice") > 450000, F.col("o_custkey")).alias("c_custkey"))
    return sweeps.retention_as_written(table(spark, sf_dir, "customer").select("c_custkey"), barred, "c_custkey")


@query("""
SELECT n_name, count(*) AS customers, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000)) AS with_large_open
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def exists_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice > 400000").select("o_custkey").distinct()
    rows = table(spark, sf_dir, "customer").join(flag, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.conditional_counts(rows, {"with_large_open": F.col("o_custkey").isNotNull()}, ["n_name"], customers=F.count("*"))


@query("""
SELECT l_orderkey, l_linenumber, c_name, p_name, s_name, cn.n_name AS customer_nation, sn.n_name AS supplier_nation
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
""")
def star_join_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    nation = table(spark, sf_dir, "nation")
    got = items.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    got = got.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    got = got.join(nation.alias("cn"), F.col("cn.n_nationkey") == F.col("c_nationkey"), "left").join(nation.alias("sn"), F.col("sn.n_nationkey") == F.col("s_nationkey"), "left")
    return got.select("l_orderkey", "l_linenumber", "c_name", "p_name", "s_name", F.col("cn.n_name").alias("customer_nation"), F.col("sn.n_name").alias("supplier_nation"))


@query("""
SELECT d.doc_id AS duplicate, k.doc_id AS kept, k.source AS kept_source FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS link FROM documents) d JOIN documents k ON k.doc_id = d.link WHERE d.doc_id <> d.link
""")
def self_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    link = docs.groupBy(F.col("h").alias("of")).agg(F.min("doc_id").alias("link"))
    linked = docs.join(link, F.col("h") == F.col("of")).where("doc_id <> link").select(F.col("doc_id").alias("duplicate"), "link")
    return linked.join(docs.alias("k"), F.col("k.doc_id") == F.col("link")).select("duplicate", F.col("k.doc_id").alias("kept"), F.col("k.source").alias("kept_source"))


@query(r"SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\' OR source ILIKE '%c1\_%' ESCAPE '\'")
def filter_contains_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(P.contains_any("%%%", F.col("text")) | P.contains_any("c1_", F.col("source"))).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 're%'")
def filter_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(P.starts_with("Re", F.col("p_name"))).select("p_partkey", "p_name")


@query("""
SELECT count(*) FILTER (WHERE (quality = 1) IS TRUE) AS is_true, count(*) FILTER (WHERE (quality = 1) IS NOT TRUE) AS is_not_true, count(*) AS unfiltered
FROM documents LEFT JOIN labels USING (doc_id)
""")
def filter_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = F.col("quality") == 1
    return R.conditional_counts(rows, {"is_true": P.is_true(flag, P.tristate("yes")), "is_not_true": P.is_true(flag, P.tristate("0")), "unfiltered": P.is_true(flag, P.tristate(None))})


@query(r"SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^(red|hot) (bolt|gear)') AND regexp_matches(p_brand, '#[12][0-9]$') AND p_size <= 30")
def filter_regex_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike("^(red|hot) (bolt|gear)") & F.col("p_brand").rlike("#[12][0-9]$") & P.RowFilter(at_most={"p_size": 30}).column()).select("p_partkey")


@query("""
SELECT p_partkey, p_brand FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size >= 5 AND p_size <= 20 AND (p_name ILIKE '%bolt%' OR p_brand ILIKE '%bolt%')
""")
def filter_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = P.RowFilter(one_of={"p_type": ["PROMO", "SMALL"]}, at_least={"p_size": 5}, at_most={"p_size": 20}, equal={"p_brand": None}, search="bolt", search_in=("p_name", "p_brand"))
    return table(spark, sf_dir, "part").where(wanted.column()).select("p_partkey", "p_brand")


@query("""
SELECT o_orderkey FROM orders WHERE (o_custkey = 7 OR o_orderkey % 11 = 7) OR (nullif(o_orderstatus, 'P') IS NULL AND o_orderkey % 5 = 0)
""")
def filter_row_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)
    claimed = F.when(F.col("o_orderkey") % 11 == 7, F.lit("7")).when(~nobody, (F.col("o_orderkey") % 11 + 100).cast("string"))
    assigned = F.when(F.col("o_custkey") == 7, F.lit("7")).when(~nobody, F.lit("x"))
    return table(spark, sf_dir, "orders").where(P.row_scope("7", assigned, claimed, pool=True)).select("o_orderkey")


@query("""
SELECT count(*) FILTER (WHERE d >= TIMESTAMP '2000-01-01' AND s <= TIMESTAMP '2000-01-01') AS open, count(*) FILTER (WHERE d BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-15') AS closing_soon,
       count(*) FILTER (WHERE d < TIMESTAMP '2000-01-01') AS closed, count(*) FILTER (WHERE s > TIMESTAMP '2000-01-01') AS upcoming
FROM (SELECT o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS d FROM orders)
""")
def filter_registration_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, as_of = F.col("o_orderdate"), F.to_timestamp_ntz(F.lit(ORDERS_AS_OF))
    deadline = start + F.make_dt_interval(days=F.lit(30))
    return R.conditional_counts(table(spark, sf_dir, "orders"), {s: P.registration(s, start, deadline, as_of) for s in ("open", "closing_soon", "closed", "upcoming")})


@query("""
SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders) ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40
""")
def page_sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return K.page_rows(rows, [K.sort_key("price", True, sparse=True), F.col("o_orderkey")], 3, 20)


@query("""
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 25
""")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.page_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [K.sort_key("o_custkey", True), F.col("o_orderkey")], 2, 25)


@query("SELECT c_custkey, true AS truncated FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def export_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.capped(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 50).select("c_custkey", "truncated")


@query("""
SELECT domain, id, name, rank FROM (
 SELECT 'part' AS domain, p_partkey AS id, p_name AS name, CASE WHEN p_name ILIKE 'red%' THEN 2 ELSE 1 END AS rank FROM part WHERE p_name ILIKE '%red%'
 UNION ALL SELECT 'customer', c_custkey, c_name, CASE WHEN c_name ILIKE 'red%' THEN 2 ELSE 1 END FROM customer WHERE c_name ILIKE '%red%'
 UNION ALL SELECT 'supplier', s_suppkey, s_name, CASE WHEN s_name ILIKE 'red%' THEN 2 ELSE 1 END FROM supplier WHERE s_name ILIKE '%red%') ORDER BY rank DESC, domain, name, id LIMIT 30
""")
def search_ranked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, text in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")):
        hit = table(spark, sf_dir, name).where(P.contains_any("red", F.col(text)))
        parts.append(hit.select(F.lit(name).alias("domain"), F.col(key).alias("id"), F.col(text).alias("name"), K.search_rank("red", F.col(text)).alias("rank")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("rank"), "domain", "name", "id").limit(30)


@query("""
SELECT kind, id, turn, event_type FROM (SELECT 'message' AS kind, conv_id AS id, turn, CAST(NULL AS VARCHAR) AS event_type FROM conversations
UNION ALL SELECT 'event', event_id, NULL, event_type FROM events)
""")
def timeline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.lit("message").alias("kind"), F.col("conv_id").alias("id"), "turn")
    done = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "event_type")
    return K.timeline(said, done, by=[F.desc("id"), F.asc_nulls_last("turn"), F.col("kind")])


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1
""")
def best_child_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return K.best_per(table(spark, sf_dir, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latest_per(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT p_brand, p_partkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3
""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_per(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3, "rank").select("p_brand", "p_partkey", "rank")


@query("""
SELECT o_custkey, y AS year, CAST(lead(y) OVER (PARTITION BY o_custkey ORDER BY y) - y AS INT) AS gap FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS y FROM orders)
""")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    return years.withColumn("gap", F.lead("year").over(Window.partitionBy("o_custkey").orderBy("year")) - F.col("year"))


@query("""
SELECT conv_id, string_agg(role || ' ' || length(text), ' | ' ORDER BY turn) AS recent FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY 1
""")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = K.best_per(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 4)
    line = F.struct("turn", F.concat_ws(" ", "role", F.char_length("text").cast("string")).alias("x"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["x"]), " | ").alias("recent"))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))
