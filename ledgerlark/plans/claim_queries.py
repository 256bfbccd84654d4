"""Claims that write: leases of a queue's buckets, and bulk claims, assignments and stages of a table with versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.leases import Leases, Queue
from ledgerlark.plans.registry import query
from ledgerlark.sources.snapshots import Snapshots, bulk_assign, bulk_claim, bulk_status
from ledgerlark.tables import table
from ledgerlark.workspace import scratch


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn, conv_id % 8 AS bucket, conv_id % 5 = 0 AS bad FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, CASE WHEN bad THEN 'failed' ELSE 'processed' END AS status, CASE WHEN NOT bad THEN 0 WHEN bucket IN (1, 3) THEN 4 ELSE 5 END AS attempts,
 CASE WHEN bad THEN 5 WHEN bucket IN (1, 3) THEN 2 ELSE 1 END AS claims, CASE WHEN bucket IN (0, 2) AND NOT bad THEN 'a' ELSE 'b' END AS worker FROM t
""")
def inflight_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers; the first leaves half of its claims behind and comes back after the leases have ended."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    folder = scratch(spark, "queue")
    leases = Leases(spark, f"{folder}/leases", 8)
    queue = Queue(turns, ["conv_id", "turn"], "turn", F.pmod("conv_id", F.lit(8)), leases, folder)
    began, ok = dt.datetime(2024, 1, 1), F.col("conv_id") % 5 != 0
    own = leases.acquire("a", began, want=4)
    left = queue.claim("a", began, own)
    theirs = leases.acquire("b", began)
    queue.finish(queue.claim("b", began, theirs), ok)
    leases.release(theirs)
    bucket = F.pmod("conv_id", F.lit(8))
    queue.finish(left.where(bucket.isin(0, 2)), ok)
    leases.release({b: own[b] for b in (0, 2)})
    for minutes in (10, 31, 40, 50, 60):
        now = began + dt.timedelta(minutes=minutes)
        theirs = leases.acquire("b", now)
        queue.finish(queue.claim("b", now, theirs), ok)
        leases.release(theirs)
        if minutes == 31:
            queue.finish(left.where(bucket.isin(1, 3)), F.lit(True))  # too late
    return queue.state().select("conv_id", "turn", "status", F.col("attempts").cast("long").alias("attempts"), "claims", "worker")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ann' WHEN doc_id % 5 = 0 THEN 'bob' END AS claimed_by, CASE WHEN doc_id % 4 = 0 THEN 'cas' END AS assigned_to,
 CASE WHEN doc_id % 14 = 0 THEN 'enriching' WHEN doc_id % 2 = 0 THEN 'enriching' WHEN doc_id % 7 = 0 THEN 'suppressed' ELSE 'discovered' END AS stage,
 CASE WHEN doc_id % 15 = 0 THEN 'taken' WHEN doc_id % 5 = 0 THEN 'claimed' END AS of_bob, CASE WHEN doc_id % 14 = 0 THEN 'illegal' WHEN doc_id % 7 = 0 THEN 'moved' END AS of_move
FROM documents
UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL, 'not_found', NULL FROM documents WHERE doc_id % 50 = 0
""")
def bulk_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users claim what they want, an admin assigns, and stages move; the table's last version beside what was answered."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    none, at = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    leads = Snapshots(spark, scratch(spark, "leads"), ["doc_id"])
    leads.create(docs.select("doc_id", none.alias("claimed_by"), at.alias("claimed_at"), none.alias("assigned_to"), F.when(F.col("doc_id") % 14 == 7, "bounced").otherwise("discovered").alias("stage"), at.alias("updated_at")))
    key = F.col("doc_id")
    bulk_claim(leads, docs.where(key % 3 == 0), "ann", at)
    of_bob = bulk_claim(leads, docs.where(key % 5 == 0).unionAll(docs.where(key % 50 == 0).select((-key - 1).alias("doc_id"))), "bob", at)
    bulk_assign(leads, docs.where(key % 4 == 0), "cas", at)
    bulk_status(leads, docs.where(key % 2 == 0), "enriching", at)
    leads.compact()
    of_move = bulk_status(leads, docs.where((key % 14 == 0)), "discovered", at).unionAll(bulk_status(leads, docs.where(key % 14 == 7), "suppressed", at))
    said = of_bob.select("doc_id", F.col("outcome").alias("of_bob")).join(of_move.select("doc_id", F.col("outcome").alias("of_move")), "doc_id", "full")
    return leads.read().join(said, "doc_id", "full").select("doc_id", "claimed_by", "assigned_to", "stage", "of_bob", "of_move")
