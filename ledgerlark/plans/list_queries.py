"""Lists of leads, events and institutions: projections, filters, orders, claims and what is computed for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import filters as P
from ledgerlark.operators import lists as L
from ledgerlark.plans.registry import ORDERS_AS_OF, query
from ledgerlark.tables import table


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE extract(month FROM o_orderdate) = 3")
def filter_event_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(P.in_month(3, F.col("o_orderdate"))).select("o_orderkey", "o_orderdate")


@query("""
WITH d AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS pay_min, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN event_type END AS pay_text FROM events)
SELECT event_id, (pay_min IS NOT NULL OR coalesce(pay_text, '') <> '') AS has_pay FROM d
""")
def filter_has_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("pay_min"), F.when(third == 0, "").when(third == 1, F.col("event_type")).alias("pay_text"))
    return rows.select("event_id", P.has_pay(True, F.col("pay_min"), F.col("pay_text")).alias("has_pay"))


@query("""
WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'PREDICTED' WHEN 'F' THEN 'CONFIRMED' END AS status FROM orders)
SELECT 'predicted' AS kind, o_orderkey FROM d WHERE status IN ('PREDICTED', 'LOW_CONFIDENCE_PREDICTION', 'RECURRING_PATTERN')
UNION ALL SELECT 'confirmed', o_orderkey FROM d WHERE status NOT IN ('PREDICTED', 'LOW_CONFIDENCE_PREDICTION', 'RECURRING_PATTERN')
""")
def filter_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "PREDICTED").when(F.col("o_orderstatus") == "F", "CONFIRMED")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))
    parts = [rows.where(P.predicted(wanted, F.col("status"))).select(F.lit(kind).alias("kind"), "o_orderkey") for kind, wanted in (("predicted", True), ("confirmed", False))]
    return parts[0].unionAll(parts[1])


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal > 5000 THEN true END) IS NOT FALSE")
def filter_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.when(F.col("c_acctbal") < 0, F.lit(False)).when(F.col("c_acctbal") > 5000, F.lit(True))
    return table(spark, sf_dir, "customer").where(P.not_deleted(active)).select("c_custkey")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def filter_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(P.has_json_key(F.col("props"), "k")).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'a_e' || '%'")
def filter_contains_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that takes % and _ of the term as wildcards."""
    return table(spark, sf_dir, "part").where(P.contains_as_written("a_e", F.col("p_name"))).select("p_partkey", "p_name")


@query("""
WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 < 2 THEN 'u' || o_custkey % 5 END AS assigned, CASE WHEN o_custkey % 7 < 3 THEN 'u' || o_custkey % 7 END AS claimed FROM orders)
SELECT 'mine' AS kind, count(*) FILTER (WHERE assigned = 'u1' OR claimed = 'u1') AS n FROM d UNION ALL SELECT 'unclaimed', count(*) FILTER (WHERE claimed IS NULL) FROM d
UNION ALL SELECT 'claimed', count(*) FILTER (WHERE claimed IS NOT NULL) FROM d UNION ALL SELECT 'assigned', count(*) FILTER (WHERE assigned IS NOT NULL) FROM d
""")
def filter_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    five, seven = F.col("o_custkey") % 5, F.col("o_custkey") % 7
    assigned, claimed = (F.when(c < n, F.concat(F.lit("u"), c.cast("string"))) for c, n in ((five, 2), (seven, 3)))
    rows = table(spark, sf_dir, "orders").select(assigned.alias("assigned"), claimed.alias("claimed"))
    kinds = ("mine", "unclaimed", "claimed", "assigned")
    counts = rows.agg(*(F.count_if(P.ownership(k, "u1", F.col("assigned"), F.col("claimed"))).alias(k) for k in kinds))
    return counts.unpivot([], list(kinds), "kind", "n")


@query("""
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@x.org' WHEN c_custkey % 3 = 1 THEN '' END AS email, CASE WHEN c_acctbal > 5000 THEN 'valid' END AS status FROM customer)
SELECT c_custkey, CASE WHEN coalesce(name, '') = '' AND coalesce(email, '') = '' THEN 'none' WHEN coalesce(name, '') <> '' AND coalesce(email, '') <> '' THEN 'enriched' ELSE 'partial' END AS depth, coalesce(status = 'valid', false) AS verified FROM d
""")
def filter_contact_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name, email = F.when(key % 2 == 0, F.col("c_name")), F.when(key % 3 == 0, F.concat("c_name", F.lit("@x.org"))).when(key % 3 == 1, "")
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), email.alias("email"), F.when(F.col("c_acctbal") > 5000, "valid").alias("status"))
    is_ = {k: P.contact_depth(k, F.col("name"), F.col("email"), F.col("status")) for k in ("none", "partial", "enriched", "verified")}
    return rows.select("c_custkey", F.when(is_["none"], "none").when(is_["enriched"], "enriched").when(is_["partial"], "partial").alias("depth"), is_["verified"].alias("verified"))


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 30 DAY END AS deadline FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY (deadline >= TIMESTAMP '1998-07-01') DESC NULLS LAST, o_orderdate ASC NULLS LAST, o_orderkey) AS place FROM d ORDER BY place LIMIT 200
""")
def order_open_deadlines_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("deadline", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    keys = [L.true_first(F.col("deadline") >= F.lit("1998-07-01").cast("timestamp_ntz")), F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")]
    return L.placed(rows, keys, 200).select("o_orderkey", "place")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders ORDER BY place LIMIT 200
""")
def order_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [L.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.col("o_orderdate"), F.col("o_orderkey")]
    return L.placed(table(spark, sf_dir, "orders"), keys, 200).select("o_orderkey", "place")


@query("""
SELECT p_partkey, p_name, row_number() OVER (ORDER BY (lower(p_name) = lower((SELECT min(p_name) FROM part))) DESC NULLS LAST, p_name, p_partkey) AS place
FROM part WHERE lower(p_name) LIKE lower(split_part((SELECT min(p_name) FROM part), ' ', 1)) || '%' ORDER BY place LIMIT 50
""")
def order_exact_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = parts.agg(F.min("p_name").alias("name"))  # one row
    rows = parts.crossJoin(F.broadcast(name)).where(F.lower("p_name").startswith(F.lower(F.split_part("name", F.lit(" "), F.lit(1)))))
    return L.placed(rows, [L.true_first(F.lower("p_name") == F.lower("name")), F.col("p_name"), F.col("p_partkey")], 50).select("p_partkey", "p_name", "place")


@query("""
SELECT o_orderkey AS id, c_name AS company_name, n_name AS state, r_name AS country, concat_ws(', ', nullif(c_mktsegment, ''), n_name, r_name) AS location, o_orderpriority AS priority, o_totalprice AS salary_max, o_orderstatus AS lead_status,
 CASE WHEN c_acctbal > 7000 THEN 'hot' WHEN c_acctbal > 3000 THEN 'warm' ELSE 'cold' END AS score_band, round(greatest(0, c_acctbal) / 1000.0, 1) AS score_10, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age_days
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    balance = F.col("c_acctbal")
    return L.projected(
        rows,
        {"o_orderkey": "id", "c_name": "company_name", "n_name": "state", "r_name": "country", "o_orderpriority": "priority", "o_totalprice": "salary_max", "o_orderstatus": "lead_status"},
        location=L.composed_location(F.col("c_mktsegment"), F.col("n_name"), F.col("r_name")),
        score_band=F.when(balance > 7000, "hot").when(balance > 3000, "warm").otherwise("cold"),
        score_10=F.round(F.greatest(F.lit(0.0), balance) / 1000.0, 1),
        age_days=L.days_between(F.col("o_orderdate"), F.lit(ORDERS_AS_OF)),
    )


@query("""
SELECT source, count(*) AS discovered, count(DISTINCT md5(coalesce(text, ''))) AS stored, count(*) - count(DISTINCT md5(coalesce(text, ''))) AS duplicates, count(*) FILTER (WHERE coalesce(text, '') = '') AS errors FROM documents GROUP BY ALL
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_totals(table(spark, sf_dir, "documents"), "source", F.coalesce("text", F.lit("")))


@query("""
SELECT c_custkey, md5('{"balance":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE floor(c_acctbal)::BIGINT::VARCHAR END || ',"name":"' || c_name || '","nation":' || c_nationkey || '}') AS digest FROM customer
""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("long")))
    return rows.select("c_custkey", F.md5(L.canonical_json({"nation": F.col("c_nationkey"), "name": F.col("c_name"), "balance": F.col("balance")})).alias("digest"))


@query("""
SELECT c_custkey, (c_name <> '')::INT + (c_acctbal IS NOT NULL AND c_acctbal > 0)::INT + (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS data_points FROM customer
""")
def data_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.lit("x")), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment"))]
    return table(spark, sf_dir, "customer").select("c_custkey", L.filled(*flags).alias("data_points"))


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\\.[A-Za-z.]+[A-Za-z])', 1)) AS host FROM documents),
h AS (SELECT DISTINCT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT host, count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM h WHERE h.host = x.host) AS pages FROM (SELECT doc_id, lower(host) AS host FROM m) x GROUP BY host
""")
def address_host_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the addresses in documents, with the pages that lie there."""
    hosts = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.[A-Za-z.]+[A-Za-z])"), F.lit(1))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(hosts).alias("host")).select("doc_id", F.lower("host").alias("host"))
    found = found.groupBy("host").agg(F.countDistinct("doc_id").alias("documents"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)).alias("host")).distinct()
    return found.join(pages.groupBy("host").agg(F.count("*").alias("pages")), "host", "left").select("host", "documents", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("""
WITH asked AS (SELECT DISTINCT event_id * 3 AS id FROM events), known AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'someone' WHEN o_custkey % 4 = 1 THEN 'me' END AS owner, o_orderstatus FROM orders)
SELECT a.id, CASE WHEN k.id IS NULL THEN 'not_found' WHEN k.o_orderstatus = 'F' THEN 'closed' WHEN owner = 'me' THEN 'already_mine' WHEN owner IS NOT NULL THEN 'taken' ELSE 'claimed' END AS outcome FROM asked a LEFT JOIN known k USING (id)
""")
def bulk_claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id"))
    owner = F.when(F.col("o_custkey") % 4 == 0, "someone").when(F.col("o_custkey") % 4 == 1, "me")
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), owner.alias("owner"), (F.col("o_orderstatus") == "F").alias("closed"))
    return L.claim_outcomes(asked, known, "id", "owner", "closed", "me")


@query("""
WITH asked AS (SELECT DISTINCT event_id * 3 AS id FROM events), done AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F')
SELECT id FROM asked EXCEPT SELECT id FROM done
""")
def skipped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id"))
    return L.skipped(asked, table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")), "id")
