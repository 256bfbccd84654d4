"""Upserts, claims, merges, stages and anonymising over split orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import lifecycle, merging
from ledgerlark.plans.registry import query
from ledgerlark.streaming import flows
from ledgerlark.tables import table

_OLD = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ' ' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, o_custkey AS stamp FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'N' || o_orderstatus END AS priority, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * 2 END AS price, o_custkey + o_orderkey % 2 * 2 - 1 AS stamp FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = o.where("o_orderdate < timestamp_ntz '1999-01-01'").select("o_orderkey", F.when(key % 5 == 0, None).when(key % 5 == 1, " ").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(key % 4 != 0, F.col("o_totalprice")).alias("price"), F.col("o_custkey").alias("stamp"))
    new = o.where("o_orderdate >= timestamp_ntz '1998-01-01'").select("o_orderkey", F.when(key % 7 != 0, F.concat(F.lit("N"), "o_orderstatus")).alias("priority"), F.when(key % 6 != 0, F.col("o_totalprice") * 2).alias("price"), (F.col("o_custkey") + key % 2 * 2 - 1).alias("stamp"))
    return old, new


def _merged(priority: str, price: str, stamp: str) -> str:
    both = "t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL"
    return (
        f"SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN {both} THEN {priority} ELSE coalesce(t.priority, s.priority) END AS priority, "
        f"CASE WHEN {both} THEN {price} ELSE coalesce(t.price, s.price) END AS price, CASE WHEN {both} THEN {stamp} ELSE coalesce(t.stamp, s.stamp) END AS stamp "
        f"FROM ({_OLD}) t FULL JOIN ({_NEW}) s ON t.o_orderkey = s.o_orderkey"
    )


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) n WHERE n.o_orderkey NOT IN (SELECT o_orderkey FROM ({_OLD}))")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.insert_ignore(*_sides(spark, sf_dir), ["o_orderkey"])


@query(_merged("s.priority", "s.price", "s.stamp"))
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.upsert(*_sides(spark, sf_dir), ["o_orderkey"])


@query(_merged("CASE WHEN t.priority IS NULL OR trim(t.priority) = '' THEN s.priority ELSE t.priority END", "coalesce(t.price, s.price)", "coalesce(t.stamp, s.stamp)"))
def upsert_fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.fill_blank(*_sides(spark, sf_dir), ["o_orderkey"])


@query(_merged("coalesce(t.priority, s.priority)", "CASE WHEN s.stamp >= t.stamp THEN coalesce(s.price, t.price) ELSE coalesce(t.price, s.price) END", "greatest(t.stamp, s.stamp)"))
def upsert_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.newest_wins(*_sides(spark, sf_dir), ["o_orderkey"], "stamp", protected=["priority"])


@query(_merged("coalesce(s.priority, t.priority)", "coalesce(s.price, t.price)", "coalesce(s.stamp, t.stamp)"))
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.history(*_sides(spark, sf_dir), ["o_orderkey"])


@query(_merged("CASE WHEN t.priority IS NULL OR trim(t.priority) = '' OR s.stamp > t.stamp THEN coalesce(s.priority, t.priority) ELSE t.priority END", "coalesce(s.price, t.price)", "greatest(t.stamp, s.stamp)"))
def upsert_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.confident(*_sides(spark, sf_dir), ["o_orderkey"], "stamp", ["priority"])


@query("""
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200) THEN 'already_claimed' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'claimed' ELSE 'already_claimed' END AS outcome FROM events WHERE event_type = 'click'
""")
def claim_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    taken = events.where("event_type = 'signup' AND value > 200").select("user_id")
    return merging.claim_first(events.where("event_type = 'click'").select("user_id", "ts", "event_id"), "user_id", "event_id", "ts", taken).select("event_id", "outcome")


def _moves_sql() -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in lifecycle.moves())


@query(f"""
WITH s AS (SELECT {list(lifecycle.STAGES)!r} AS stages), m(o, n) AS (VALUES {_moves_sql()}), a AS (SELECT o_orderkey, stages[o_custkey % {len(lifecycle.STAGES)} + 1] AS old_stage, stages[o_orderkey % {len(lifecycle.STAGES)} + 1] AS new_stage FROM orders, s)
SELECT o_orderkey, old_stage, new_stage, m.o IS NOT NULL AS ok, CASE WHEN m.o IS NOT NULL THEN new_stage ELSE old_stage END AS after FROM a LEFT JOIN m ON m.o = old_stage AND m.n = new_stage
""")
def stage_transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed move for every order."""
    stages = F.array(*(F.lit(s) for s in lifecycle.STAGES))
    old, new = (F.get(stages, (F.col(c) % len(lifecycle.STAGES)).cast("int")) for c in ("o_custkey", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old_stage"), new.alias("new_stage"))
    return rows.select("*", lifecycle.transition_ok(F.col("old_stage"), F.col("new_stage")).alias("ok"), lifecycle.advance(F.col("old_stage"), F.col("new_stage")).alias("after"))


@query("""
WITH k AS (SELECT * FROM (SELECT o_orderkey AS duplicate, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept FROM orders) WHERE duplicate <> kept)
SELECT coalesce(kept, l_orderkey) AS l_orderkey, count(*) AS n FROM lineitem LEFT JOIN k ON duplicate = l_orderkey GROUP BY 1
""")
def duplicate_merge_reparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("kept"))
    links = orders.join(first, ["o_custkey", "o_orderpriority"]).where("o_orderkey <> kept").select(F.col("o_orderkey").alias("duplicate"), "kept")
    rest, moved = merging.merge_duplicates(orders, links, "o_orderkey", {"lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")})
    return moved["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN '2000-01-01' END AS erased FROM customer")
def retention_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merging.anonymise(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey") % 9 == 0, ["c_name", "c_mktsegment"], "erased", F.lit("2000-01-01").cast("timestamp"))
    return got.withColumn("erased", F.date_format("erased", "yyyy-MM-dd"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice >= 250000 AND o_orderstatus <> 'F' AS changed FROM orders")
def reclassify_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("o_totalprice") >= 250000, "F").otherwise(F.col("o_orderstatus"))
    return merging.reclassified(table(spark, sf_dir, "orders"), "o_orderstatus", new).select("o_orderkey", "o_orderstatus", "changed")


@query("SELECT event_id, CASE WHEN value >= 250 THEN 'dead' ELSE 'retry' END AS goes, CAST(CASE WHEN value >= 250 THEN 5 ELSE 1 END AS INT) AS attempts FROM events WHERE event_type = 'error'")
def retry_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.when(F.col("value") >= 250, 4).alias("attempts"))
    again, dead = flows.with_retries(failed)
    return again.withColumn("goes", F.lit("retry")).unionByName(dead.withColumn("goes", F.lit("dead")))


@query("""
SELECT e.event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'purchase' AND h.user_id = e.user_id AND h.ts < e.ts AND h.ts >= e.ts - INTERVAL 24 HOUR)
""")
def cooldown_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return flows.cooled(sends, sends, "user_id", "ts").select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE THEN 'stored' WHEN event_type = 'view' THEN 'processing' ELSE event_type END AS state FROM events")
def reclaim_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type")).alias("state"))
    return flows.reclaimed(jobs, "state", "ts", F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))).select("event_id", "state")


@query("SELECT event_id, array_to_string(list_sort([event_type || '=new', 'base=' || CASE WHEN event_type = 'base' THEN 'new' ELSE 'old' END]), ',') AS merged FROM events")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = F.create_map(F.lit("base"), F.lit("old"), F.col("event_type"), F.lit("old")), F.create_map(F.col("event_type"), F.lit("new"))
    merged = F.transform(F.map_entries(merging.right_wins(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(merged), ",").alias("merged"))
