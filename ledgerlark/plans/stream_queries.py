"""Streams over events: each runs to the end of the input and returns what its sink holds."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.registry import query
from ledgerlark.streaming import chains, flows
from ledgerlark.tables import table
from ledgerlark.workspace import scratch


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """events as a stream with ts as a zoned timestamp, which watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    got = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    return got.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, tag: str, state: Callable[[SparkSession], AbstractContextManager] = lambda spark: nullcontext()) -> DataFrame:
    """Run a stream over all there is into a folder and read that. The checkpoint lies beside it, so a run can go on where it stopped."""
    spark = stream.sparkSession
    path = scratch(spark, tag)
    with state(spark):
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(flows.deduplicated(event_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "dedup")


@query("""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, event_type, n, total FROM (
 SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2)
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    got = flows.tumbling(event_stream(spark, sf_dir), "ts", "1 day", "1 hour", "event_type", n=F.count("*"), total=total)
    return drained(got, "tumbling").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(6 * k AS INT)) AS w FROM events, range(0, 4) r(k))
GROUP BY w HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = flows.sliding(event_stream(spark, sf_dir), "ts", "1 day", "6 hours", "1 hour", n=F.count("*"))
    return drained(got, "sliding").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drained(flows.sessions(event_stream(spark, sf_dir), "ts", "8 hours", "1 hour", "user_id"), "sessions")
    return got.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


#: The breaker as recursive SQL: a user's calls one after the other. 2 failures open it for a day; after 5 days without a call it is a new one.
_BREAKER_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
b AS (SELECT user_id, 0::BIGINT AS k, 0 AS failures, 0::DOUBLE AS until, 1e18 AS last, '' AS state FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL
 SELECT user_id, k, f, CASE WHEN rests THEN until WHEN f >= 2 THEN t + 86400 ELSE 0 END, t, CASE WHEN rests OR f >= 2 THEN 'open' ELSE 'closed' END FROM (
  SELECT *, CASE WHEN rests THEN failures WHEN ok THEN 0 ELSE failures + 1 END AS f FROM (
   SELECT e.user_id, e.k, e.ok, e.t, CASE WHEN e.t - b.last > 432000 THEN 0 ELSE b.failures END AS failures, CASE WHEN e.t - b.last > 432000 THEN 0 ELSE b.until END AS until,
    e.t < CASE WHEN e.t - b.last > 432000 THEN 0 ELSE b.until END AS rests FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)))
SELECT user_id, state, count(*) AS n FROM b WHERE k > 0 GROUP BY 1, 2
"""
_BREAKER = {"limit": 2, "rest": 86_400.0, "forget": 432_000.0}


def _calls(events: DataFrame) -> DataFrame:
    return events.select("user_id", (F.col("event_type") != "error").alias("ok"), "ts")


@query(_BREAKER_SQL)
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = flows.breaker(_calls(event_stream(spark, sf_dir)), "user_id", "ok", "ts", **_BREAKER)
    return drained(stream, "breaker", flows.on_rocksdb).groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query(_BREAKER_SQL)
def breaker_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.breaker_batch(_calls(table(spark, sf_dir, "events")), "user_id", "ok", "ts", **_BREAKER).groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 20 AS slot, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = event_stream(spark, sf_dir).select("event_type", (F.col("user_id") % 20).alias("slot"), "event_id")
    return drained(flows.first_seen(keyed, ["event_type", "slot"], ["event_id"]), "ingest", flows.on_rocksdb)


def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a stream."""
    schema = table(spark, sf_dir, "conversations").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/conversations.parquet*")


@query("SELECT DISTINCT 'conversations' AS domain, coalesce(role, '') AS source, sha256(coalesce(text, '')) AS checksum, strlen(coalesce(text, ''))::BIGINT AS bytes FROM conversations")
def raw_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    raw = turn_stream(spark, sf_dir).select(F.lit("conversations").alias("domain"), F.coalesce("role", F.lit("")).alias("source"), F.sha2(text.cast("binary"), 256).alias("checksum"), F.octet_length(text).cast("long").alias("bytes"))
    return drained(flows.distinct_forever(raw, ["domain", "source", "checksum"]), "raw", flows.on_rocksdb)


#: What a turn's place in the table makes of it, told alike to the chain and to the SQL: some rows fail a few times, some without end.
_CHAIN_SQL = """
WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words, CASE WHEN (conv_id + turn) % 7 = 0 THEN conv_id % 6 ELSE 0 END AS fails FROM conversations),
a AS (SELECT *, CASE WHEN n_words = 0 OR role = 'system' THEN 'skipped' WHEN fails >= 5 THEN 'dead' ELSE 'passed' END AS o1 FROM t),
b AS (SELECT a.*, n_name, CASE WHEN o1 <> 'passed' THEN NULL WHEN n_name IS NULL THEN 'dead' ELSE 'passed' END AS o2 FROM a LEFT JOIN nation ON n_nationkey = conv_id % 26)
SELECT conv_id, turn, n_words, o1 AS outcome, CASE o1 WHEN 'skipped' THEN 1 WHEN 'dead' THEN 5 ELSE fails + 1 END AS attempts, 'normalise' AS stage, NULL AS place, NULL AS points FROM b WHERE o1 <> 'passed'
UNION ALL SELECT conv_id, turn, n_words, o2, 5, 'enrich', NULL, NULL FROM b WHERE o2 = 'dead'
UNION ALL SELECT conv_id, turn, n_words, CASE WHEN turn % 3 = 2 AND n_words % 2 = 1 THEN 'skipped' ELSE 'passed' END, 1, 'score', n_name, least(100, 10 + n_words) FROM b WHERE o2 = 'passed'
"""


def chain_of_turns(spark: SparkSession, sf_dir: str, folder: str) -> chains.Chain:
    """normalise, enrich and score over conversations; a row has its words, then its place, then its points."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("place"))

    def normalise(rows: DataFrame) -> DataFrame:
        words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
        fails = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.col("conv_id") % 6).otherwise(0)
        rows = rows.withColumn("n_words", F.size(words).cast("long"))
        return rows.withColumn("outcome", F.when((F.col("n_words") == 0) | (F.col("role") == "system"), "skipped").when(F.col("attempts") < fails, "failed").otherwise("passed"))

    def enrich(rows: DataFrame) -> DataFrame:
        known = rows.join(nation, F.col("conv_id") % 26 == F.col("_key"), "left").drop("_key")
        return known.withColumn("outcome", F.when(F.col("place").isNotNull(), "passed").otherwise("failed"))

    def score(rows: DataFrame) -> DataFrame:
        outcome = F.when((F.col("turn") % 3 == 2) & (F.col("n_words") % 2 == 1), "skipped").otherwise("passed")
        return rows.withColumn("points", F.least(F.lit(100).cast("long"), 10 + F.col("n_words"))).withColumn("outcome", outcome)

    return chains.Chain(spark, folder, [chains.Hop("normalise", normalise), chains.Hop("enrich", enrich), chains.Hop("score", score)])


def ended(chain: chains.Chain, stream: DataFrame) -> DataFrame:
    """Each row where its way ended: at the last hop, or where it wasn't passed on."""
    out = None
    for k, hop in enumerate(chain.hops):
        got = chain.table(stream, k).withColumn("stage", F.lit(hop.name))
        if k < len(chain.hops) - 1:
            got = got.where(F.col("outcome") != "passed")
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out.select("conv_id", "turn", "n_words", "outcome", F.col("attempts").cast("long").alias("attempts"), "stage", "place", "points")


@query(_CHAIN_SQL)
def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = turn_stream(spark, sf_dir)
    chain = chain_of_turns(spark, sf_dir, scratch(spark, "chain"))
    chain.drain(stream)
    return ended(chain, stream)
