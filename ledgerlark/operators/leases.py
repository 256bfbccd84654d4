"""In-flight claims: workers lease buckets of a queue for a while, so no row is worked on twice at a time.

Parquet has no row locks. A worker takes a lease of whole hash buckets, a marker made by put-if-absent, and
then has all rows of the bucket to itself until the lease ends. A lease has an epoch, one more than the
bucket's last one, and what a worker logs carries it: a worker that wakes up after its lease ended can
log what it likes, the later epoch counts. Times are given, never read from a clock.

The queue's state is a log of small tables (claims and their ends) over the rows, which are never rewritten. A row is
claimed if it is stored, failed fewer than `most` times, or was claimed in a lease that has ended. Rows
with a NULL key are never claimed. A row that repeats a key is the same piece of work.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources import markers


class Leases:
    """Leases of buckets 0 to `buckets` - 1 as markers in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, lasting: dt.timedelta = dt.timedelta(minutes=30)):
        self.spark, self.folder, self.buckets, self.lasting = spark, folder.rstrip("/"), buckets, lasting

    def _newest(self) -> dict[int, tuple[int, bool]]:
        """The epoch of each bucket's last lease, and whether it was given back."""
        out: dict[int, tuple[int, bool]] = {}
        for name in markers.names(self.spark, self.folder):  # in order, so the last lease of a bucket stays
            lease, _, done = name.partition(".")
            bucket, _, epoch = lease.partition("-")
            out[int(bucket)] = int(epoch), bool(done)
        return out

    def _name(self, bucket: int, epoch: int) -> str:
        return f"{self.folder}/{bucket:06d}-{epoch:09d}"

    def _runs(self, bucket: int, epoch: int, as_of: dt.datetime) -> str | None:
        """The worker of a lease that hasn't ended."""
        told = json.loads(markers.text(self.spark, self._name(bucket, epoch)))
        return told["worker"] if dt.datetime.fromisoformat(told["until"]) > as_of else None

    def held(self, as_of: dt.datetime) -> dict[int, str]:
        """Bucket to worker of the leases that run."""
        newest = self._newest().items()
        return {b: w for b, (epoch, done) in newest if not done and (w := self._runs(b, epoch, as_of))}

    def acquire(self, worker: str, as_of: dt.datetime, want: int | None = None) -> dict[int, int]:
        """Bucket to epoch of the leases that the worker gets now, `want` at most.

        A lease is the marker of one epoch more than the last one seen; who saw an older state finds the
        marker there, or a later one beside its own, and gets nothing.
        """
        newest, got = self._newest(), {}
        for bucket in range(self.buckets):
            if len(got) == (self.buckets if want is None else want):
                break
            last, done = newest.get(bucket, (0, True))
            if not done and self._runs(bucket, last, as_of):
                continue
            if markers.put_if_absent(self.spark, self._name(bucket, last + 1), json.dumps({"worker": worker, "until": (as_of + self.lasting).isoformat()})):
                got[bucket] = last + 1
        newest = self._newest()
        return {b: epoch for b, epoch in got.items() if newest[b][0] == epoch}

    def forget(self) -> None:
        """Remove the markers of leases that were followed by another."""
        newest = self._newest()
        for name in markers.names(self.spark, self.folder):
            bucket, _, epoch = name.partition(".")[0].partition("-")
            if int(epoch) < newest[int(bucket)][0]:
                markers.remove(self.spark, f"{self.folder}/{name}")

    def release(self, leases: dict[int, int]) -> None:
        for bucket, epoch in leases.items():
            markers.put_if_absent(self.spark, self._name(bucket, epoch) + ".done", "")


class Queue:
    """Rows of work with a log of what became of them. bucket: an expression over the key, from 0."""

    def __init__(self, work: DataFrame, key: Sequence[str], stamp: str, bucket: Column, leases: Leases, folder: str, most: int = 5):
        self.spark, self.key, self.most = work.sparkSession, list(key), most
        known = F.lit(True)
        for k in self.key:
            known = known & F.col(k).isNotNull()
        self.work = work.where(known).groupBy(*self.key).agg(F.min(stamp).alias("since")).withColumn("bucket", bucket.cast("int"))
        self.leases, self.folder = leases, folder.rstrip("/")
        kinds = {f.name: f.dataType.simpleString() for f in work.schema}
        self.schema = ", ".join(f"{k} {kinds[k]}" for k in self.key) + ", epoch long, step int, status string, attempts int, until timestamp, worker string"
        markers.make_folder(self.spark, f"{self.folder}/log")

    def _log(self, rows: DataFrame, worker: str) -> DataFrame:
        path = f"{self.folder}/log/{worker}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def state(self) -> DataFrame:
        """key, since (its stamp), bucket, status, attempts, until, worker and how often it was claimed, for every row of work."""
        log = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/log")
        last = F.max_by(F.struct("status", "attempts", "until", "worker"), F.struct("epoch", "step")).alias("last")
        told = log.groupBy(*self.key).agg(last, F.count_if(F.col("status") == "processing").alias("claims"))
        return self.work.join(told, self.key, "left").select(
            *self.key, "since", "bucket", F.coalesce("last.status", F.lit("stored")).alias("status"), F.coalesce("last.attempts", F.lit(0)).alias("attempts"), "last.until", "last.worker", F.coalesce("claims", F.lit(0).cast("long")).alias("claims"),
        )

    def claim(self, worker: str, as_of: dt.datetime, leases: dict[int, int], limit: int | None = None) -> DataFrame:
        """The rows of the leased buckets that can be worked on, the oldest first, logged as in processing."""
        own = self.spark.createDataFrame(sorted(leases.items()) or [(-1, -1)], "bucket int, epoch long")  # as many rows as buckets
        rows = self.state().join(F.broadcast(own), "bucket")
        now, status = F.lit(as_of).cast("timestamp"), F.col("status")
        ready = (status.isin("stored", "failed") | ((status == "processing") & (F.col("until") <= now))) & (F.col("attempts") < self.most)
        rows = rows.where(ready)
        if limit is not None:
            rows = rows.orderBy("since", *self.key).limit(limit)
        until = F.lit(as_of + self.leases.lasting).cast("timestamp")
        return self._log(rows.select(*self.key, "epoch", F.lit(1).alias("step"), F.lit("processing").alias("status"), "attempts", until.alias("until"), F.lit(worker).alias("worker")), worker)

    def finish(self, claimed: DataFrame, ok: Column) -> None:
        """Log the end of claimed rows: processed where ok, else failed with an attempt more."""
        worker = claimed.select("worker").first()
        failed = ~F.coalesce(ok, F.lit(False))
        ended = claimed.withColumns({"step": F.lit(2), "status": F.when(failed, "failed").otherwise("processed"), "attempts": F.col("attempts") + failed.cast("int"), "until": F.lit(None).cast("timestamp")})
        if worker:
            self._log(ended, worker[0])
