"""Similarity joins against all pairs."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import similarity
from ledgerlark.operators import matching, simjoin


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(seed: int, n: int) -> list[str]:
    r, out = random.Random(seed), []
    for _ in range(n):
        if out and r.random() < 0.6:
            s = list(r.choice(out))
            for _ in range(r.randint(0, 3)):
                k = r.randint(0, len(s))
                s[k : k + r.randint(0, 1)] = r.choices("abé😀", k=r.randint(0, 1))
            out.append("".join(s))
        else:
            out.append("".join(r.choices("abcdefé ", k=r.randint(0, 14))))
    return out


@pytest.mark.parametrize("least", [0.45, 0.6, 0.8, 0.85, 1.0])
def test_edit_pairs_against_all_pairs(spark, least):
    rows = [(i, s, "xy"[i % 2] if i % 17 else None) for i, s in enumerate([*names(int(least * 100), 150), None, "", "", "a", "b", "ab"])]
    got = {(r.left, r.right): r.similarity for r in matching.edit_pairs(spark.createDataFrame(rows, "id long, name string, b string"), "id", "name", ["b"], least).collect()}
    want = {}
    for (i, a, x), (j, b, y) in itertools.combinations(rows, 2):
        if None not in (a, b, x, y) and x == y:
            s = 1.0 if a == b else 1.0 - distance(a, b) / max(len(a), len(b))
            if s >= least:
                want[i, j] = s
    assert not set(got) ^ set(want), [(k, rows[k[0]], rows[k[1]], want.get(k)) for k in set(got) ^ set(want)]
    assert got == pytest.approx(want) and len(want) > 5


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, least):
    r, rows = random.Random(7), []
    for i in range(160):
        s = set(rows[r.randrange(i)][1] or [] if i and r.random() < 0.6 else r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(0, 12)))
        for x in r.choices("abcdefgh", k=r.randint(0, 2)):
            s ^= {x}
        rows.append((i, sorted(s), "xy"[i % 2]))
    rows += [(200, None, "x"), (201, [], "x"), (202, ["a"], None), (None, ["a"], "x")]
    heads, members = simjoin.classes(spark.createDataFrame(rows, "id long, words array<string>, b string"), "id", "words", ["b"])
    links = simjoin.similar_sets(heads, "id", "words", ["b"], least)
    of = {m.id: m.representative for m in members.collect()}
    assert set(of) == {i for i, *_ in rows if i is not None}
    head = {i: (set(w), b) for i, w, b in rows if i is not None and of[i] == i and w is not None and b is not None}
    want = {(i, j): len(a & b) / len(a | b) for (i, (a, x)), (j, (b, y)) in itertools.combinations(sorted(head.items()), 2) if x == y and (a or b) and len(a & b) / len(a | b) >= least}
    assert {(k.left, k.right): k.similarity for k in links.collect()} == pytest.approx(want)
    got = {k.id: k.links for k in simjoin.link_counts(links, members, "id").collect()}
    assert got == {i: sum(of[i] in p for p in want) for i in of}
    words = {i: (w, b) for i, w, b in rows if i is not None}
    assert all(words[i] == words[h] and h <= i for i, h in of.items())


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, name string, b string")
    assert matching.edit_pairs(none, "id", "name", ["b"]).count() == matching.trigram_pairs(none, "id", "name", ["b"]).count() == 0


def test_candidates_grow_with_the_rows(spark):
    def candidates(n: int) -> tuple[int, int]:
        r = random.Random(n)
        rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=24)), "b") for i in range(n)]
        df = spark.createDataFrame(rows, "id long, name string, b string")
        sets = df.withColumn("name", F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.substr("name", i, F.lit(5)))))
        return simjoin.string_candidates(df, "id", "name", ["b"], 0.85).count(), simjoin.set_candidates(sets, "id", "name", ["b"], 0.8).count()

    few, many = candidates(300), candidates(3000)  # of 44,850 and 4,498,500 pairs
    assert max(few) < 300 and max(many) < 3000


@pytest.mark.parametrize(("least", "most"), [(0.3, 512), (0.7, 512), (0.86, 512), (0.86, 0), (1.0, 512)])
def test_subsequence_candidates_against_all_pairs(spark, monkeypatch, least, most):
    monkeypatch.setattr(simjoin, "MOST_WAYS", most)
    many = [("college" if i % 3 else "") + s + ("city" if i % 2 else "") for i, s in enumerate(names(11, 120))]
    rows = [(i, s, "xyz"[i % 3] if i % 17 else None) for i, s in enumerate([*many, "", "a", "ab", *(f"customer{i * 7919 % 100000:09d}" for i in range(60))])]
    heads, _ = simjoin.classes(spark.createDataFrame(rows, "id long, name string, b string"), "id", "name", ["b"])
    texts = {r.id: (r.b, r.name) for r in heads.collect()}
    got = [tuple(sorted((r._a, r._b))) for r in simjoin.subsequence_candidates(heads, "id", "name", ["b"], least).collect()]
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) if a and b else 0.0
    want = {(i, j) for (i, (x, a)), (j, (y, b)) in itertools.combinations(sorted(texts.items()), 2) if x == y and ratio(a, b) >= least}
    assert len(got) == len(set(got)) and want <= set(got) and (want or least == 1.0)
    assert all(texts[i][0] == texts[j][0] for i, j in got)


def test_subsequence_candidates_grow_with_the_rows(spark):
    """Names of one block that differ in a few characters behind what all begin with: 1,000 names, 499,500 pairs."""
    df = spark.createDataFrame([(i, f"customer{i * 7919 % 1000000:09d}", "b") for i in range(1000)], "id long, name string, b string")
    assert simjoin.subsequence_candidates(df, "id", "name", ["b"], 0.92).count() < 500
    assert simjoin.subsequence_candidates(df, "id", "name", ["b"], 0.86).count() < 15000


def test_matching_share_against_difflib():
    r = random.Random(9)
    texts = ["".join(r.choices("ab é😀0", k=r.choice((1, 2, 5, 12, 30, 199, 200, 260)))) for _ in range(400)]
    for a, b in zip(texts, [*texts[1:200], *(t[1:] + "a" for t in texts[199:])], strict=True):
        assert similarity.matching_share(a, b) == SequenceMatcher(None, a, b).ratio()
