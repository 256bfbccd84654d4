"""Chains of stages: streaming queries in a row with a hand-off table behind each.

A hop reads the rows that the hop before it passed and its own failed rows, and appends every row with its outcome to
its own table. The file sink's log and the hop's checkpoint make that exactly once by row, hop and attempt:
a hop that is killed and started again goes on where it stopped, and files of a batch that wasn't
committed are never read. No row is held by the driver, and no hop reads a table twice.

An outcome is passed, skipped (wanted no further), failed (tried again) or, after `most` attempts, dead.
A NULL outcome counts as failed. Rows of equal values are rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.sources.markers import make_folder

PASSED, SKIPPED, FAILED, DEAD = "passed", "skipped", "failed", "dead"
_ATTEMPTS, _OUTCOME = "attempts", "outcome"


@dataclass(frozen=True)
class Hop:
    """A stage. step keeps its input's columns, may add others, and adds `outcome`; it can read `attempts`, the earlier ones."""

    name: str
    step: Callable[[DataFrame], DataFrame]
    most: int = 5


class Chain:
    """hops over a stream, with tables and checkpoints below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, hops: Sequence[Hop]):
        self.spark, self.folder, self.hops = spark, folder.rstrip("/"), list(hops)

    def _path(self, k: int, what: str) -> str:
        return f"{self.folder}/{k:02d}-{self.hops[k].name}/{what}"

    def _shape(self, fresh: DataFrame, k: int) -> T.StructType:
        """What hop k's table holds, told by its step on no rows."""
        return self._judged(fresh.withColumn(_ATTEMPTS, F.lit(0)), k).schema

    def _judged(self, rows: DataFrame, k: int) -> DataFrame:
        hop = self.hops[k]
        got = hop.step(rows).withColumn(_ATTEMPTS, F.col(_ATTEMPTS) + 1)
        said = F.coalesce(_OUTCOME, F.lit(FAILED))
        return got.withColumn(_OUTCOME, F.when((said == FAILED) & (F.col(_ATTEMPTS) >= hop.most), DEAD).otherwise(said))

    def _handed_on(self, k: int, schema: T.StructType, outcome: str) -> DataFrame:
        make_folder(self.spark, self._path(k, "table"))
        return self.spark.readStream.schema(schema).parquet(self._path(k, "table")).where(F.col(_OUTCOME) == outcome)

    def _rows(self, stream: DataFrame, k: int) -> tuple[DataFrame, T.StructType]:
        """The rows that come to hop k as a stream, its failed ones among them, and the shape of its table."""
        fresh = stream
        for j in range(k):
            fresh = self._handed_on(j, self._shape(fresh, j), PASSED).drop(_ATTEMPTS, _OUTCOME)
        shape = self._shape(fresh, k)
        again = self._handed_on(k, shape, FAILED).select(*fresh.columns, _ATTEMPTS)
        return self._judged(fresh.withColumn(_ATTEMPTS, F.lit(0)).unionByName(again), k), shape

    def start(self, stream: DataFrame, k: int, **trigger: str | bool) -> StreamingQuery:
        """Hop k as a running query, until it is stopped or, by default, has seen all there is."""
        rows, _ = self._rows(stream, k)
        out = rows.writeStream.format("parquet").option("path", self._path(k, "table")).option("checkpointLocation", self._path(k, "state"))
        return out.queryName(f"{self.hops[k].name}-{id(self)}").trigger(**(trigger or {"availableNow": True})).start()

    def drain(self, stream: DataFrame, first: int = 0, last: int | None = None) -> None:
        """Run hops one after the other, each until it has no row to try again."""
        for k in range(first, len(self.hops) if last is None else last + 1):
            for _ in range(self.hops[k].most + 1):
                run = self.start(stream, k)
                run.awaitTermination()
                if not sum(p.numInputRows for p in run.recentProgress):
                    break

    def table(self, stream: DataFrame, k: int) -> DataFrame:
        """What hop k has decided: its rows but for attempts that were followed by another."""
        schema = self._rows(stream, k)[1]
        return self.spark.read.schema(schema).parquet(self._path(k, "table")).where(F.col(_OUTCOME) != FAILED)
