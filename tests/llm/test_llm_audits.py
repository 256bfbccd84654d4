"""The audits of filters and sources, and sharding by virtual slots, against plain Python and SQL."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import filter_audit, queries, source_divergence, virtual_slots
from ledgerlark.llm.common import new_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHES = "size part mask digest n first good toxic text_crc32 piece copies virtual_slot shard slot term d chunk place width block value rank row bytes rows".split()


def odd_rows() -> list[tuple]:
    prose = " ".join(f"wort{i % 90} Ünïcode x{i}y" for i in range(150))
    rows = [(i, f"the cat number {'abcdefghij'[i]} sat ON the mat", "en", f"s{i % 3}") for i in range(10)] * 2
    rows += [(20, prose, "de", "a"), (21, prose, "de", None), (21, prose, "de", "b"), (None, prose, "de", "a"), (None, prose, None, "a"), (22, None, "en", "s9"), (23, "", None, None), (24, " \n\t ", "fr", "a")]
    rows += [(25, "A & B", "fr", "b"), (26, "ÀÉ TEN one" * 3, "fr", "b"), (27, "x" * 200_000 + " y", "en", "s0"), (-5, prose, "de", "a")]
    return [(d, t, lang, s, None) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *(["x"] * len(CLASHES))) for r in odd_rows()]
    return spark.createDataFrame(rows, COLUMNS + ", " + ", ".join(f"{c} string" for c in CLASHES)).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(20, 1, 0), (20, 0, 1), (21, 1, None), (25, 1, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def sql(frames: dict, text: str) -> list[tuple]:
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, pa.Table.from_batches(df.toArrow().to_batches()))
    got = con.sql(text)
    return sorted(map(repr, got.select(*sorted(got.columns)).fetchall()))


def rows_of(df, columns) -> list[tuple]:
    return sorted(repr(tuple(r)) for r in df.select(*sorted(columns)).collect())


def test_plain_changes_visit_every_order_once():
    for n in range(1, 6):
        order = list(range(n))
        seen = [tuple(order)]
        for k in filter_audit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) and set(seen) == set(itertools.permutations(range(n)))


def test_walk_is_what_each_order_gives():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 9, (16, 3))
    got = filter_audit.walk(cells, "ABCD").set_index(["filter_order", "step"])
    total = collections.Counter()
    for order in itertools.permutations(range(4)):
        name, left = "".join("ABCD"[x] for x in order), list(range(16))
        for step, x in enumerate(order, 1):
            gone = [m for m in left if m >> x & 1]
            left = [m for m in left if not m >> x & 1]
            row = got.loc[name, step]
            assert [row.kept, row.removed, row.good_lost, row.toxic_lost] == [cells[left, 0].sum(), *cells[gone].sum(axis=0)]
            assert row.redundant == sum(cells[m, 0] for m in range(16) if m >> x & 1) - row.removed and row.unique_fails == cells[1 << x, 0]
            total["ABCD"[x]] += row.removed
    assert all(r.shapley == total[r["filter"]] for _, r in got.iterrows())


def test_audit_of_odd_rows(spark, odd, labels):
    got = filter_audit.audit(odd, labels)
    assert rows_of(got, got.columns) == sql({"documents": spark.createDataFrame(odd_rows(), COLUMNS), "labels": labels}, queries.AUDIT_SQL)
    assert {r.part for r in got.select("part").distinct().collect()} == {"", "de", "en", "fr"} and got.count() == 4 * 600
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_terms_are_counted_by_bytes():
    texts = ["a-B b", None, "", "Éé é x", "a", "@[`{\x7f\x00Zz"]
    got = collections.Counter()
    for g, t, n, d in source_divergence.term_counts(pa.array(texts), np.array([0, 0, 0, 1, 0, 1])):
        for row in zip(g.tolist(), t.to_pylist(), n.tolist(), d.tolist(), strict=True):
            got[(row[0], row[1].decode())] += 1000 * row[2] + row[3]
    assert got == {(0, "a"): 2002, (0, "b"): 2001, (1, "Éé"): 1001, (1, "é x"): 1001, (1, "zz"): 1001}


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    for high in (50, 10**9, 10**12, 1 << 55):
        total = rng.integers(high // 2 + 2, high + 3, 50)
        count = (total * rng.random(50)).astype(np.int64) - 2
        count = np.maximum(count, 0)
        assert source_divergence.share(count, total).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_packed_counts_come_back():
    for index, count in (([], []), ([3, 70_000], [1, 1 << 40]), ([0, 255], [255, 256])):
        got = source_divergence.unpack(source_divergence.pack(np.array(index, dtype=np.int64), np.array(count, dtype=np.int64)))
        assert [x.tolist() for x in got] == [index, count]


@pytest.mark.parametrize(("chunk", "block"), [(4096, 64), (3, 1), (5, 2)])
def test_divergence_of_odd_rows(spark, odd, chunk, block):
    got = source_divergence.divergence(odd, chunk=chunk, block=block)
    assert rows_of(got, got.columns) == sql({"documents": spark.createDataFrame(odd_rows(), COLUMNS)}, queries.DIVERGENCE_SQL)


def test_divergence_without_terms(spark, odd):
    few = spark.createDataFrame([(1, "a b", "en", "x", 3), (2, "c", "en", "y", 1), (3, None, "fr", "x", 0)], COLUMNS)
    assert sorted(map(tuple, source_divergence.divergence(few).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence.divergence(odd.limit(0)).count() == 0


def shards_hold(rows: list, docs: list[tuple], shards: int) -> dict[int, int]:
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    places, size = collections.defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in rows:
        places[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(places) <= set(range(shards)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    return size


def test_shards_have_near_equal_bytes(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    rows = virtual_slots.place(docs, 8).collect()
    size = shards_hold(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 8
    assert sorted(map(repr, virtual_slots.place(docs.repartition(7), 8).collect())) == sorted(map(repr, rows))
    shards_hold(virtual_slots.place(odd, 3, slots=16).collect(), odd_rows(), 3)
    assert virtual_slots.place(odd.limit(0), 8).count() == 0


def test_one_row_a_thousand_times_is_spread(spark, monkeypatch):
    monkeypatch.setattr(virtual_slots, "COPIES", 16)
    rows = [(None, "again", "en", "a", 5)] * 1000 + [(i, f"text {i}", "en", "b", 6) for i in range(500)]
    size = shards_hold(virtual_slots.place(spark.createDataFrame(rows, COLUMNS), 4, slots=256).collect(), rows, 4)
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 4
    path = new_path(spark, "shards")
    docs = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", shard string")
    pieces = virtual_slots.records(docs, 256)
    slot_map = virtual_slots.rebalanced(virtual_slots.first_map(virtual_slots.loads(pieces), 4, 256), 4)
    virtual_slots.write_shards(docs, slot_map, path, 256)
    got = spark.read.parquet(path)
    assert collections.Counter((r.doc_id, r.text, r.shard) for r in got.collect()) == collections.Counter((d, t, "x") for d, t, *_ in rows)
    each = [r["count"] for r in got.groupBy("_shard").count().collect()]
    assert len(each) == 4 and min(each) > 250


def test_map_has_versions_and_grows_by_few_moves(spark, sf_dir):
    path = new_path(spark, "map")
    pieces = virtual_slots.records(table(spark, sf_dir, "documents"), 512)
    virtual_slots.store(virtual_slots.rebalanced(virtual_slots.first_map(virtual_slots.loads(pieces), 8, 512), 8), path, 1)
    virtual_slots.store(virtual_slots.rebalanced(virtual_slots.stored(spark, path), 9), path, 2)
    old, new = ({r.virtual_slot: r for r in virtual_slots.stored(spark, path, v).collect()} for v in (1, None))
    assert len(old) == len(new) == 512 and {r.version for r in new.values()} == {2}
    moved = [s for s in old if old[s].shard != new[s].shard]
    size = collections.Counter()
    for r in new.values():
        size[r.shard] += r.bytes
    assert sum(new[s].shard == 8 for s in moved) > 0.5 * len(moved) and len(moved) < 200
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 9
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        virtual_slots.store(virtual_slots.stored(spark, path), path, 2)
