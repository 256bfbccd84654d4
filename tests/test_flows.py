"""Streams that stop and go on, leases, table versions and day claims, against plain Python."""

from __future__ import annotations

import collections
import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.leases import Leases, Queue
from ledgerlark.sources import markers
from ledgerlark.sources.snapshots import Snapshots, bulk_assign, bulk_claim, bulk_status
from ledgerlark.streaming import chains, flows
from ledgerlark.workspace import scratch

BEGAN = dt.datetime(2024, 1, 1)


def put(spark, folder: str, n: int, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")


def stream_of(spark, folder: str, schema: str, **options):
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/*")


def hops(broken: bool = False) -> list[chains.Hop]:
    """The first hop fails id % 4 times, the second keeps odd values and can break down in the middle of a batch."""

    def first(rows):
        return rows.withColumn("outcome", F.when(F.col("v").isNull(), None).when(F.col("attempts") < F.col("id") % 4, "failed").otherwise("passed"))

    def second(rows):
        got = rows.withColumn("double", F.col("v") * 2)
        if broken:
            got = got.withColumn("double", F.when(F.col("id") == 50, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("double")))
        return got.withColumn("outcome", F.when(F.col("v") % 2 == 0, "skipped").otherwise("passed"))

    return [chains.Hop("first", first, most=3), chains.Hop("second", second)]


def test_chain_goes_on_after_it_was_killed(spark):
    schema, folder = "id long, v long", scratch(spark, "in")
    put(spark, folder, 0, [(i, i * 3) for i in range(60)] + [(None, 1), (60, None)], schema)
    stream, root = stream_of(spark, folder, schema), scratch(spark, "chain")
    chains.Chain(spark, root, hops()).drain(stream, 0, 0)
    with pytest.raises(Exception, match="broken"):
        chains.Chain(spark, root, hops(broken=True)).drain(stream, 1)
    put(spark, folder, 1, [(i, i * 3) for i in range(61, 80)], schema)
    chain = chains.Chain(spark, root, hops())
    chain.drain(stream)
    chain.drain(stream)  # nothing is left to do
    one, two = (collections.Counter(tuple(r) for r in chain.table(stream, k).collect()) for k in (0, 1))
    ids = [i for i in range(80) if i != 60]
    want = collections.Counter((i, i * 3, i % 4 + 1 if i % 4 < 3 else 3, "passed" if i % 4 < 3 else "dead") for i in ids)
    # a NULL outcome (that of a NULL value) is a failure; NULL attempts left are none
    assert one == want + collections.Counter([(None, 1, 1, "passed"), (60, None, 3, "dead")])
    assert two == collections.Counter((i, i * 3, 1, i * 6, "passed" if i % 2 else "skipped") for i in ids if i % 4 < 3) + collections.Counter([(None, 1, 1, 2, "passed")])


def run_to_end(stream, path: str, out: str) -> None:
    with flows.on_rocksdb(stream.sparkSession):
        run = stream.writeStream.format("parquet").option("path", f"{path}/{out}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()


@pytest.mark.parametrize("kind", ["first_seen", "distinct_forever"])
def test_delivery_knows_what_it_delivered_without_the_sink(spark, kind):
    schema, folder, path = "source string, checksum string, n long", scratch(spark, "in"), scratch(spark, "out")

    def go(out: str) -> list[tuple]:
        stream = stream_of(spark, folder, schema)
        got = flows.first_seen(stream, ["source", "checksum"], ["n"]) if kind == "first_seen" else flows.distinct_forever(stream, ["source", "checksum"])
        run_to_end(got, path, out)
        return sorted(map(tuple, spark.read.schema(schema).parquet(f"{path}/{out}/part-*").collect()), key=repr)

    put(spark, folder, 0, [("a", "1", 5), ("a", "1", 4), ("b", "1", 6), (None, "1", 7)], schema)
    first = go("one")
    assert [r[:2] for r in first] == [("a", "1"), ("b", "1"), (None, "1")]
    assert kind == "distinct_forever" or ("a", "1", 4) in first
    put(spark, folder, 1, [("a", "1", 1), ("a", "2", 9), (None, "1", 8), ("b", "2", 3)], schema)
    assert go("two") == [("a", "2", 9), ("b", "2", 3)]  # into another folder: nothing was read of the first


def breaker_by_hand(calls: list[tuple], limit: int, rest: float, forget: float) -> collections.Counter:
    out, known = collections.Counter(), {}
    for k, ok, t in calls:
        fails, until, last = known.get(k, (0, 0.0, t))
        if t - last > forget:
            fails, until = 0, 0.0
        if t >= until:
            fails = 0 if ok else fails + 1
            until = t + rest if fails >= limit else 0.0
            out[k, t, "open" if fails >= limit else "closed"] += 1
        else:
            out[k, t, "open"] += 1
        known[k] = fails, until, t
    return out


def test_breaker_over_batches_drops_state_and_forgets(spark):
    r, schema = random.Random(4), "k string, ok boolean, ts timestamp"
    calls, t = [], 0.0
    for _ in range(400):
        t += r.choice([1, 20, 300, 5000])
        calls.append((r.choice("abcd"), r.random() < 0.3, t))
    want = breaker_by_hand(calls, 3, 600.0, 4000.0)
    rows = [(k, ok, BEGAN + dt.timedelta(seconds=t)) for k, ok, t in calls]
    zero = BEGAN.replace(tzinfo=dt.timezone.utc).timestamp()
    folder, path = scratch(spark, "in"), scratch(spark, "out")
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "ok", "ts"]))
    for n in range(4):
        frame.where((F.col("ts") >= rows[n * 100][2]) & (F.col("ts") <= rows[n * 100 + 99][2])).coalesce(1).write.parquet(f"{folder}/{n}")
    run_to_end(flows.breaker(stream_of(spark, folder, schema, maxFilesPerTrigger=1), "k", "ok", "ts", 3, 600.0, 4000.0, late="1 second"), path, "out")
    for got in (spark.read.schema("k string, ts double, state string").parquet(f"{path}/out"), flows.breaker_batch(frame, "k", "ok", "ts", 3, 600.0, 4000.0)):
        assert collections.Counter((g.k, round(g.ts - zero, 3), g.state) for g in got.collect()) == want


def test_leases_go_to_one_worker_each_and_come_back(spark):
    folder = scratch(spark, "leases")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda w: Leases(spark, folder, 12).acquire(w, BEGAN, 5), "abcd"))
    assert sorted(b for g in got for b in g) == list(range(12))
    leases = Leases(spark, folder, 12)
    assert leases.acquire("e", BEGAN + dt.timedelta(minutes=29)) == {}
    leases.release(got[0])
    assert leases.acquire("e", BEGAN + dt.timedelta(minutes=29)) == dict.fromkeys(got[0], 2)
    again = leases.acquire("f", BEGAN + dt.timedelta(minutes=31))
    assert set(again) == set(range(12)) - set(got[0]) and set(again.values()) == {2}
    leases.forget()
    assert set(leases.held(BEGAN + dt.timedelta(minutes=32)).values()) == {"e", "f"} and len(markers.names(spark, folder)) == 12


def test_queue_gives_no_row_twice_and_takes_back_what_was_left(spark):
    work = spark.createDataFrame([(i, i % 7) for i in range(40)] + [(3, 0), (None, 1)], "id long, since_day int")
    folder = scratch(spark, "queue")
    leases = Leases(spark, f"{folder}/leases", 4)

    def queue():
        return Queue(work, ["id"], "since_day", F.pmod("id", F.lit(4)), leases, folder, most=2)

    a = leases.acquire("a", BEGAN, 2)
    b = leases.acquire("b", BEGAN)
    with ThreadPoolExecutor(2) as pool:
        mine, theirs = pool.map(lambda x: queue().claim(x[0], BEGAN, x[1]), (("a", a), ("b", b)))
    both = [r.id for d in (mine, theirs) for r in d.collect()]
    assert sorted(both) == list(range(40))
    assert queue().claim("a", BEGAN + dt.timedelta(minutes=5), a).count() == 0  # in work already
    queue().finish(theirs, F.col("id") % 3 != 0)
    late = BEGAN + dt.timedelta(minutes=31)
    taken = leases.acquire("c", late)
    assert len(taken) == 4
    oldest = queue().claim("c", late, taken, limit=9)
    done = {r.id for r in theirs.collect() if r.id % 3}
    assert {r.id for r in oldest.collect()} == set(sorted(set(range(40)) - done, key=lambda i: (0 if i == 3 else i % 7, i))[:9])
    queue().finish(mine, F.lit(True))  # its leases are over: nobody listens
    queue().finish(oldest, F.lit(False))
    state = {r.id: r for r in queue().state().collect()}
    assert len(state) == 40 and all(state[r.id].status == "failed" and state[r.id].worker == "c" for r in oldest.collect())
    gone = {i for i, s in state.items() if s.attempts == 2}
    assert gone == {r.id for r in oldest.collect()} & {r.id for r in theirs.collect()}
    rest = queue().claim("c", late + dt.timedelta(minutes=1), taken)
    assert not gone & {r.id for r in rest.collect()}


def leads_of(spark, n: int) -> Snapshots:
    leads = Snapshots(spark, scratch(spark, "leads"), ["id"])
    rows = [(i, "zoe" if i == 0 else None, None, None, "converted" if i == 1 else "discovered", None) for i in range(n)]
    assert leads.create(spark.createDataFrame(rows, "id long, claimed_by string, claimed_at timestamp, assigned_to string, stage string, updated_at timestamp"))
    return leads


def test_of_two_claims_at_once_one_wins(spark):
    leads, at = leads_of(spark, 30), F.lit(BEGAN)
    assert not leads.create(leads.read())
    asked = {"ann": [*range(20), 99, 5], "bob": [*range(10, 30), 99, None]}

    def go(user: str) -> dict:
        frame = spark.createDataFrame([(i,) for i in asked[user]], "id long")
        return {r.id: (r.outcome, r.claimed_by) for r in bulk_claim(leads, frame, user, at).collect()}

    with ThreadPoolExecutor(2) as pool:
        said = dict(zip(asked, pool.map(go, asked), strict=True))
    owners = {r.id: r.claimed_by for r in leads.read().collect()}
    assert len(owners) == 30 and leads.version() == 3
    for user, other in (("ann", "bob"), ("bob", "ann")):
        assert set(said[user]) == set(asked[user]) and said[user][99][0] == "not_found"
        for i in set(asked[user]) & set(owners):
            assert said[user][i] == (("claimed", None) if owners[i] == user else ("taken", owners[i]))
        assert owners[0] == "zoe" and {owners[i] for i in range(10, 20)} in ({user}, {other})
    assert {r.outcome for r in bulk_claim(leads, leads.read().where("claimed_by = 'ann'"), "ann", at).collect()} == {"already_mine"}


def test_bulk_assign_and_status(spark):
    leads, at = leads_of(spark, 6), F.lit(BEGAN)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 77)], "id long")
    assert {r.id: r.outcome for r in bulk_assign(leads, ids, "cas", at).collect()} == {1: "assigned", 2: "assigned", 3: "assigned", 77: "not_found"}
    assert {r.id: r.outcome for r in bulk_status(leads, ids, "enriched", at).collect()} == {1: "illegal", 2: "moved", 3: "moved", 77: "not_found"}
    bulk_assign(leads, ids.where("id = 3"), None, at)
    before = sorted(map(repr, leads.read().collect()))
    assert leads.compact() and sorted(map(repr, leads.read().collect())) == before
    assert {r.id: (r.assigned_to, r.stage) for r in leads.read().where("id < 4").collect()} == {0: (None, "discovered"), 1: ("cas", "converted"), 2: ("cas", "enriched"), 3: (None, "enriched")}
    assert leads.read(1).where("assigned_to is not null").count() == 0  # older versions stay readable
    assert not leads.commit(2, leads.read()) and bulk_claim(leads, ids.limit(0), "ann", at).count() == 0


def test_a_day_is_claimed_once(spark):
    folder = scratch(spark, "days")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda h: markers.claim_day(spark, folder, "army", BEGAN + dt.timedelta(hours=h)), range(16))) == 1
    assert not markers.claim_day(spark, folder, "army", BEGAN) and markers.claim_day(spark, folder, "army", BEGAN + dt.timedelta(days=1))
    assert markers.claim_day(spark, folder, "other", BEGAN) and markers.names(spark, f"{folder}/army") == ["2024-01-01", "2024-01-02"]
