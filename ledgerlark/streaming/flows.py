"""Structured Streaming flows: keyed dedup, windows, sessions, breaker, cooldown, idempotent sinks.

Event time and watermarks take the place of wall clocks, so a replay gives the same answer. Sinks are
file sinks, whose log makes them exactly once, so a batch that runs again after a lost executor does no harm.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State on the executors' disks with a log of changes in the checkpoint, so it may outgrow memory.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own settings come back."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicated(events: DataFrame, keys: list[str], stamp: str, within: str = "30 days") -> DataFrame:
    """The first row of each key within the time; state older than the watermark goes."""
    return events.withWatermark(stamp, within).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, stamp: str, size: str, late: str, *by: str, **aggregates: Column) -> DataFrame:
    got = events.withWatermark(stamp, late).groupBy(F.window(stamp, size), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return got.select(F.col("window.start").alias("window_start"), *by, *aggregates)


def sliding(events: DataFrame, stamp: str, size: str, slide: str, late: str, *by: str, **aggregates: Column) -> DataFrame:
    got = events.withWatermark(stamp, late).groupBy(F.window(stamp, size, slide), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return got.select(F.col("window.start").alias("window_start"), *by, *aggregates)


def sessions(events: DataFrame, stamp: str, gap: str, late: str, key: str) -> DataFrame:
    got = events.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return got.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def breaker_states(ok: pd.Series, at: pd.Series, failures: int, until: float, limit: int, rest: float, forget: float = float("inf"), last: float = float("inf")) -> Iterator[tuple[str, int, float]]:
    """State after each call: open for `rest` once `limit` calls in a row have failed; then one may try.

    After a pause of over `forget` since the last call (at `last`) nothing is known of the calls before.
    """
    for good, t in zip(ok.tolist(), at.tolist(), strict=True):
        if t - last > forget:
            failures, until = 0, 0.0
        last = t
        if t < until:
            yield "open", failures, until
            continue
        failures = 0 if good else failures + 1
        until = t + rest if failures >= limit else 0.0
        yield ("open" if failures >= limit else "closed"), failures, until


class _Breaker(StatefulProcessor):
    """Failures in a row, the end of the rest and the last call of a key.

    A key without failures has the state of a new key, so it is dropped at once; the others go by a timer in event
    time, `forget` after their last call.
    """

    def __init__(self, key: str, ok: str, at: str, limit: int, rest: float, forget: float):
        self.names, self.rule, self.forget = (key, ok, at), (limit, rest, forget), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", "failures int, until double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  the names of the interface
        name, ok, at = self.names
        failures, until, last = self.calls.get() if self.calls.exists() else (0, 0.0, float("inf"))
        calls = pd.concat(list(rows)).sort_values(at, kind="stable")
        states = []
        for state, failures, until in breaker_states(calls[ok], calls[at], failures, until, *self.rule, last):
            states.append(state)
        last = float(calls[at].iloc[-1])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if failures == 0:
            self.calls.clear()
        else:
            self.calls.update((failures, until, last))
            if self.forget != float("inf"):
                self.handle.registerTimer(int((last + self.forget) * 1000) + 1)
        yield pd.DataFrame({name: key[0], at: calls[at].to_numpy(), "state": states})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.calls.clear()
        yield from ()

    def close(self) -> None:
        pass


def _breaker_schema(events: DataFrame, key: str, at: str) -> str:
    return f"{key} {events.schema[key].dataType.simpleString()}, {at} double, state string"


def breaker(events: DataFrame, key: str, ok: str, stamp: str, limit: int = 5, rest: float = 7200.0, forget: float | None = None, late: str = "1 hour") -> DataFrame:
    """key, stamp (seconds) and state of every call in a stream; the state store holds only keys with failures.

    forget: seconds without a call after which a key begins anew. Times are the calls' own. Start it on_rocksdb().
    """
    rows = events.withWatermark(stamp, late).select(key, ok, F.col(stamp).alias("_stamp"), (F.unix_micros(F.col(stamp)) / 1e6).alias(stamp))
    own = _Breaker(key, ok, stamp, limit, rest, float("inf") if forget is None else forget)
    return rows.groupBy(key).transformWithStateInPandas(own, _breaker_schema(rows, key, stamp), "append", "eventTime")


def breaker_batch(events: DataFrame, key: str, ok: str, stamp: str, limit: int = 5, rest: float = 7200.0, forget: float | None = None) -> DataFrame:
    """breaker() over a table. A key's calls come in order to one task, as the state depends on the order; it holds a batch of them at a time."""
    rows = events.select(key, ok, (F.unix_micros(F.col(stamp).cast("timestamp")) / 1e6).alias(stamp))
    rule = (limit, rest, float("inf") if forget is None else forget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, failures, until, last = None, 0, 0.0, float("inf")
        for f in frames:
            for k, calls in f.groupby(key, sort=False, dropna=False):
                if k != own and not (pd.isna(k) and pd.isna(own) and own is not None):
                    own, failures, until, last = k, 0, 0.0, float("inf")
                states = []
                for state, failures, until in breaker_states(calls[ok], calls[stamp], failures, until, *rule, last):
                    states.append(state)
                last = float(calls[stamp].iloc[-1])
                yield pd.DataFrame({key: calls[key], stamp: calls[stamp], "state": states})

    return rows.repartition(key).sortWithinPartitions(key, stamp).mapInPandas(run, _breaker_schema(rows, key, stamp))


def cooled(sends: DataFrame, history: DataFrame, key: str, stamp: str, hours: int = 24) -> DataFrame:
    """Sends of keys without an earlier send in the hours before them; a NULL key or time is never near another.

    History shrinks to the first and last send of each key in each period of that many hours, so a hot key
    is spread over its periods and no send meets more than two rows: in its own period an earlier first
    send is near, in the period before a last send that is late enough.
    """
    width = hours * 3_600_000_000

    def period(c: Column) -> Column:
        micros = F.unix_micros(c.cast("timestamp"))
        return micros - F.pmod(micros, F.lit(width))

    h = history.groupBy(F.col(key).alias("_k"), period(F.col(stamp)).alias("_p")).agg(F.min(stamp).alias("_first"), F.max(stamp).alias("_last"))
    own = h.select("_k", "_p", "_first")
    before = h.select(F.col("_k").alias("_kb"), (F.col("_p") + width).alias("_pb"), "_last")
    got = sends.withColumn("_period", period(F.col(stamp)))
    got = got.join(own, (F.col(key) == F.col("_k")) & (F.col("_period") == F.col("_p")), "left")
    got = got.join(before, (F.col(key) == F.col("_kb")) & (F.col("_period") == F.col("_pb")), "left")
    near = (F.col("_first") < F.col(stamp)) | (F.col("_last") >= F.col(stamp) - F.make_dt_interval(hours=F.lit(hours)))
    return got.where(~F.coalesce(near, F.lit(False))).drop("_period", "_k", "_p", "_first", "_kb", "_pb", "_last")


def with_retries(failed: DataFrame, attempts: str = "attempts", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Failed rows to try again, with one attempt more, and those that go to the dead letters."""
    tried = failed.withColumn(attempts, F.coalesce(F.col(attempts), F.lit(0)) + 1)
    return tried.where(F.col(attempts) < most), tried.where(F.col(attempts) >= most)


def reclaimed(jobs: DataFrame, state: str, stamp: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """Jobs in processing for too long go back to stored."""
    late = (F.col(state) == "processing") & (F.col(stamp) < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn(state, F.when(late, "stored").otherwise(F.col(state)))


class _First(StatefulProcessor):
    """How often a key came, for ever; its first row is the least of the first batch that has the key."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], names: Sequence[str]):
        self.keys, self.order, self.names = list(keys), list(order), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n, best = self.seen.get()[0] if self.seen.exists() else 0, None
        known = n > 0
        for f in rows:
            n += len(f)
            if not known:
                best = pd.concat([f] if best is None else [best, f]).sort_values(self.order, kind="stable").head(1)
        self.seen.update((n,))
        if best is not None:
            yield best[self.names]

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, once for ever: insert-or-ignore on a stream.

    What was delivered is known from the state store alone, a counter for each key, so a batch costs by its own rows, not
    by what the sink holds. Of the rows of a key in one batch the least by `order` is the first.
    """
    schema = T.StructType([stream.schema[c] for c in stream.columns])
    return stream.groupBy(*keys).transformWithStateInPandas(_First(keys, order, stream.columns), schema, "append", "none")


def distinct_forever(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, once for ever, where all rows of a key are the same (a checksum is one of the keys): Spark's own state, without Python."""
    return stream.dropDuplicates(list(keys))
