"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records are hashed into some thousands of slots, whose number never changes. The map says which shard
has a slot; it is a small table with a folder for each version. Rebalancing weighs the slots by their
bytes and edits the map: slots move from shards above the mean to the emptiest one while that brings
both nearer to the mean, then while it narrows the gap between the two. All of it is DataFrame code; the
edit is a fold over an array of the map's slots, whose number is fixed.

Nulls: a null text has no bytes and a size of 1; a null doc_id is a record like any other. Empty texts
have a size of 1. Rows of one doc_id and text are one record with many copies, which goes to slots in
pieces of COPIES, so even a third of all rows being one row is spread. Ties are ordered by doc_id, size,
checksum and piece. Very long texts are never cut. Extra columns are ignored by place() and kept by
write_shards(). Empty tables give empty tables and a map of empty slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import new_path, staged

SLOTS = 4096
#: Copies of a record that go to a slot together.
COPIES = 1024
_KEY = ("doc_id", "size", "text_crc32")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64(*_KEY, "piece"), F.lit(slots)).cast("int").alias("virtual_slot")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row for each piece of a record: its key, piece, copies and virtual slot."""
    n = _measured(docs).groupBy(*_KEY).agg(F.count("*").alias("n"))
    pieces = n.select(*_KEY, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("piece"))
    return pieces.select(*_KEY, "piece", F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("piece")).alias("copies"), _slot(slots))


def loads(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return placed.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(weighed: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, shard, bytes and rows: slots dealt out in turn."""
    every = weighed.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))
    zero = F.lit(0).cast("long")
    return every.join(weighed, "virtual_slot", "left").select("virtual_slot", "shard", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows"))


def _edited(slot_map: DataFrame, shards: int, may: str) -> DataFrame:
    """The map after one fold over its slots, largest first, that moves a slot to the emptiest shard where `may` holds."""
    load = f"transform(sequence(0, {shards - 1}), i -> aggregate(slots, 0L, (a, x) -> a + if(x.shard = i, x.bytes, 0L)))"
    start = f"named_struct('load', {load}, 'moved', cast(array() as array<struct<virtual_slot: int, to: int>>))"
    to = "cast(array_position(acc.load, array_min(acc.load)) - 1 as int)"
    after = f"named_struct('load', transform(acc.load, (v, i) -> v + if(i = {to}, x.bytes, 0L) - if(i = x.shard, x.bytes, 0L)), 'moved', concat(acc.moved, array(named_struct('virtual_slot', x.virtual_slot, 'to', {to}))))"
    moved = f"aggregate(slots, {start}, (acc, x) -> if(x.bytes > 0 and {may}, {after}, acc), acc -> acc.moved)"
    one = slot_map.agg(F.reverse(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")))).alias("slots"))
    moves = one.select(F.explode(F.expr(moved)).alias("m")).select("m.virtual_slot", "m.to")
    got = slot_map.join(F.broadcast(moves), "virtual_slot", "left")
    return got.select("virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows")


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map with slots moved until the shards' bytes are near equal; also when shards are added (not when they are taken away).

    First moves that bring both shards nearer to the mean, then moves that narrow the gap of two shards.
    """
    mean = f"(aggregate(acc.load, 0L, (a, v) -> a + v) / {shards})"
    near = _edited(slot_map, shards, f"x.bytes <= acc.load[x.shard] - {mean} and x.bytes <= {mean} - array_min(acc.load)")
    return _edited(near, shards, "x.bytes < acc.load[x.shard] - array_min(acc.load)")


def store(slot_map: DataFrame, path: str, version: int) -> None:
    """Write a version of the map; a version that is there already is an error, so of two editors one wins."""
    slot_map.select("virtual_slot", "shard", "bytes", "rows").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest one if none is named, with its number."""
    kept = spark.read.schema("virtual_slot int, shard int, bytes long, rows long, version int").parquet(path)
    return kept.where(F.col("version") == (kept.agg(F.max("version")).first()[0] if version is None else version))


def place(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, shard, slot (its place there, from 0), virtual_slot and map_version.

    Places are counted in each virtual slot and begin behind the slots before it in the shard, so no task
    sees a whole shard. path: where the map's versions go, the shared folder by default.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    pieces = staged(records(docs, slots), "slot-records")
    store(first_map(loads(pieces), shards, slots), path, 1)
    store(rebalanced(stored(spark, path), shards), path, 2)
    return numbered(pieces, stored(spark, path))


def numbered(pieces: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records() with shard and slot by a stored map, a row for each copy."""
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begins"))
    own = Window.partitionBy("virtual_slot").orderBy(*_KEY, "piece").rowsBetween(Window.unboundedPreceding, -1)
    got = pieces.withColumn("within", F.coalesce(F.sum("copies").over(own), F.lit(0)))
    got = got.join(F.broadcast(begins), "virtual_slot")  # a row for each of the fixed number of slots
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return got.select(*_KEY, "shard", (F.col("begins") + F.col("within") + F.col("copy")).alias("slot"), "virtual_slot", "map_version")


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write the rows of docs, with all their columns, to a folder for each shard.

    A record of many copies is dealt over its pieces by the rows' places in the input, which a task that
    runs again finds the same.
    """
    many = records(docs, slots).where(F.col("piece") > 0).groupBy(*_KEY).agg(F.max("piece").alias("pieces"))
    names, folder = docs.columns, "shard"
    while folder in names:
        folder = f"_{folder}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct(*names).alias("row"), "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    same = F.col("many.doc_id").eqNullSafe(F.col("all.doc_id")) & (F.col("many.size") == F.col("all.size")) & (F.col("many.text_crc32") == F.col("all.text_crc32"))
    row = row.alias("all").join(many.alias("many"), same, "left").select("all.*", F.pmod(F.col("place"), F.coalesce(F.col("pieces"), F.lit(0)) + 1).alias("piece"))
    shard = F.broadcast(slot_map.select(F.col("virtual_slot"), F.col("shard").alias(folder)))
    row.withColumn("virtual_slot", _slot(slots)).join(shard, "virtual_slot").select("row.*", folder).write.partitionBy(folder).parquet(path)
