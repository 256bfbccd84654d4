from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import imports, lifecycle, matching, merging, prediction, ranking, rollups, sweeps
from ledgerlark.sources import tabular
from ledgerlark.streaming import flows


def test_stage_machine():
    assert lifecycle.legal("discovered", "verified") and not lifecycle.legal("sent", "drafted")
    assert lifecycle.legal("verification_failed", "contact_unavailable")
    assert not lifecycle.legal("converted", "suppressed") and lifecycle.legal("bounced", "suppressed")
    assert lifecycle.legal("bounced", "retry_pending") and not lifecycle.legal("send_failed", "sent")


def test_not_in_with_a_null_is_empty_and_the_anti_join_is_not(spark):
    people = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 1))], "id int, seen timestamp")
    barred = spark.createDataFrame([(1,), (None,)], "id int")
    assert sweeps.retention_as_written(people, barred, "id").count() == 0
    got = sweeps.retention(people, barred.limit(0), barred, "id", "seen", F.lit("2024-01-01").cast("timestamp"), 30)
    assert [r.id for r in got.collect()] == [2]


@pytest.mark.parametrize(
    ("history", "want"),
    [
        ([(2024, "2024-03-10"), (2025, "2025-03-12"), (2026, "2026-03-11")], ("PREDICTED", dt.date(2027, 3, 11), 75)),
        ([(2024, "2024-03-10"), (2025, "2025-03-12")], ("RECURRING_PATTERN", None, 60)),
        ([(2022, "2022-05-01"), (2024, "2024-05-01"), (2026, "2026-05-01")], ("PREDICTED", dt.date(2028, 5, 1), 65)),
        ([(2024, None), (2025, None)], ("RECURRING_PATTERN", None, 45)),
    ],
)
def test_recurrence(spark, history, want):
    df = spark.createDataFrame([("h", y, d and dt.datetime.fromisoformat(d)) for y, d in history], "id string, y int, s timestamp")
    r = prediction.recurrence(df, "id", F.col("y"), F.col("s")).first()
    assert (r.status, r.predicted_date, r.confidence) == want
    assert prediction.recurrence(df.limit(1), "id", F.col("y"), F.col("s")).count() == 0


def test_merges_with_nulls_repeats_and_unknown_columns(spark):
    old = spark.createDataFrame([(1, "a", ["x"]), (2, " ", None), (None, "n", None)], "k int, v string, l array<string>")
    new = spark.createDataFrame([(2, "b", ["y"], 1), (2, "c", ["z"], 2), (3, None, None, 1), (None, "m", None, 1)], "k int, v string, l array<string>, t int")
    got = {r.k: r.v for r in merging.fill_blank(old, new, ["k"], "t").collect()}
    assert got == {1: "a", 2: "c", 3: None, None: "n"}
    assert {r.k: r.v for r in merging.upsert(old, new, ["k"], "t").collect()} == {1: "a", 2: "c", 3: None, None: "m"}
    assert merging.insert_ignore(old, new, ["k"]).count() == 4
    empty = old.limit(0)
    assert merging.upsert(empty, new, ["k"], "t").count() == 3 and merging.upsert(old, new.limit(0), ["k"], "t").count() == 3


def test_newest_wins_unites_lists(spark):
    old = spark.createDataFrame([(1, "a", ["x"], 5)], "k int, v string, l array<string>, t int")
    new = spark.createDataFrame([(1, "b", ["y", "x"], 4)], "k int, v string, l array<string>, t int")
    r = merging.newest_wins(old, new, ["k"], "t", lists=["l"]).first()
    assert (r.v, r.l, r.t) == ("a", ["x", "y"], 5)


def test_funnel_has_null_after_an_empty_stage(spark):
    df = spark.createDataFrame([("a",), ("a",), ("c",)], "s string")
    got = [(r.stage, r["count"], r.conversion) for r in rollups.funnel(df, "s", ("a", "b", "c")).collect()]
    assert got == [("a", 2, None), ("b", 0, 0.0), ("c", 1, None)]


def test_page_counts(spark):
    p = ranking.page(spark.range(45), [F.col("id")], 3, 20)
    assert (p.total, p.pages, [r.id for r in p.rows.collect()]) == (45, 3, [40, 41, 42, 43, 44])


def test_first_match_prefers_the_newest(spark):
    rows = spark.createDataFrame([(1, "abcdef", "x", 1), (2, "abcdeg", "x", 2), (3, "abcdeh", "x", 3), (4, "zzz", "x", 9), (5, "abcdef", "y", 9)], "id int, t string, b string, s int")
    got = {r.id: r.match for r in matching.first_match(rows, rows, "id", "t", ["b"], "s", least=0.8).collect()}
    assert got == {1: 3, 2: 3, 3: 2, 4: None, 5: None}


def test_raw_records_are_staged_once(spark):
    old = spark.createDataFrame([("j", "s", "1", "p")], "domain string, source string, checksum string, payload string")
    new = spark.createDataFrame([("j", "s", "1", "q"), ("j", "s", "2", "r"), ("j", "s", "2", "r")], old.schema)
    assert sorted(r.payload for r in tabular.stage_raw(old, new).collect()) == ["p", "r"]


def test_fallback_wave(spark):
    runs = spark.createDataFrame([("a", "failed", 0), ("b", "ok", 5), ("c", "ok", 0)], "s string, status string, found int")
    kin = spark.createDataFrame([("a", "x", 1), ("a", "b", 1), ("c", "y", 2), ("b", "z", 1)], "of string, sibling string, tier int")
    assert sorted((r["of"], r.sibling) for r in sweeps.fallback_wave(runs, kin, "s").collect()) == [("a", "x"), ("c", "y")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 50)), max_size=30))
def test_breaker_against_a_plain_loop(calls):
    calls.sort(key=lambda c: c[1])
    got = [s for s, _, _ in flows.breaker_states(pd.Series([c[0] for c in calls], dtype=bool), pd.Series([float(c[1]) for c in calls], dtype=float), 0, 0.0, 3, 10.0)]
    run, until, want = 0, 0.0, []
    for ok, t in calls:
        if t < until:
            want.append("open")
            continue
        run = 0 if ok else run + 1
        if run >= 3:
            until = t + 10.0
        want.append("open" if run >= 3 else "closed")
    assert got == want


def test_stream_and_batch_breaker_agree(spark, sf_dir):
    from ledgerlark.plans.stream_queries import breaker_batch, stream_breaker

    a, b = (sorted(map(tuple, f(spark, sf_dir).collect())) for f in (stream_breaker, breaker_batch))
    assert a == b


def test_ratio_pairs_against_difflib(spark):
    from difflib import SequenceMatcher

    from ledgerlark.functions.similarity import ratio

    words = ["smart india hack", "smart india hackathon", "india smart hack", "", None, "zeta"]
    df = spark.createDataFrame([(i, w, "b") for i, w in enumerate(words)], "id int, t string, b string")
    got = {(r.left, r.right): round(r.similarity, 9) for r in matching.fuzzy_pairs(df, "id", "t", ["b"], ratio, 0.5).collect()}
    want = {}
    for i, a in enumerate(words):
        for j, b in enumerate(words[i + 1 :], i + 1):
            s = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            if s >= 0.5:
                want[i, j] = round(s, 9)
    assert got == want


def test_ratio_pairs_tell_each_two_texts_once(spark, monkeypatch):
    """Rows, keys out of order, repeated texts and blocks, against difflib; 3,000 rows of 6 texts need no more than their 30 ratios."""
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    r = random.Random(2)
    words = ["tide", "diet", "blue ring", "blue rings", "bue rinlg", "", None, *("".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(30))]
    rows = [(r.randrange(10**6), r.choice(words), r.choice(("x", "y", None))) for _ in range(250)] + [(None, "tide", "x")]
    df = spark.createDataFrame(rows, "id long, t string, b string")
    got = {(k.left, k.right): k.similarity for k in matching.ratio_pairs(df, "id", "t", ["b"], 0.5).collect()}
    want = {}
    for (i, a, x), (j, b, y) in combinations(sorted(rows[:-1], key=lambda t: t[0]), 2):
        s = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        if x and x == y and s >= 0.5:
            want[i, j] = s
    assert got == want and len(set(want.values())) > 5
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()

    told = []

    def counted(a, b):
        told.append(spark.sparkContext.accumulator(0))
        return F.udf(lambda x, y, n=told[-1]: n.add(1) or SequenceMatcher(None, x, y).ratio(), "double")(a, b)

    monkeypatch.setattr(matching, "ratio", counted)
    many = spark.range(3000).select("id", F.concat(F.lit("part"), F.col("id") % 6).alias("t"), (F.col("id") % 7 % 2).alias("b"))
    pairs = matching.ratio_pairs(many, "id", "t", ["b"], 0.7).count()
    assert pairs == sum(n * (n - 1) // 2 for n in (many.where("b = 0").count(), many.where("b = 1").count())) and sum(n.value for n in told) <= 30


def test_same_college(spark):
    fields = "id int, code_key string, site string, state_key string, name_key string, city_key string, district_key string"
    rows = [
        (1, "", None, "kerala", "governmentengineeringcollege", "", ""),
        (2, "", None, "gujarat", "governmentengineeringcollege", "", ""),
        (3, "c1", None, "x", "a", "", ""),
        (4, "c1", None, "y", "b", "", ""),
        (5, "", "abc.edu", "goa", "abc", "", ""),
        (6, "", "abc.edu", "", "abccollege", "", ""),
        (7, "", None, "goa", "collegeofartsgoa", "panaji", "north"),
        (8, "", None, "goa", "collegeofartsgoaa", "panaji", "north"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], fields + ", block int")
    same, sure = matching.same_college("a", "b")
    got = {(r.l, r.r): r.sure for r in matching.pairs(df, "id", ["block"]).where(same).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), sure.alias("sure")).collect()}
    assert got[3, 4] == 1.0 and got[5, 6] == 0.97 and (7, 8) in got and (1, 2) not in got


def test_same_event(spark):
    fields = "id int, url_key string, name_key string, organizer_key string, city_key string, site string, year int, block int"
    rows = [(1, "u", "a", "o", "", None, 2026, 1), (2, "u", "b", "p", "", None, 2025, 1), (3, "", "hack", "o", "", None, 2026, 1), (4, "", "hack", "q", "", None, 2026, 1), (5, "", "hack", "q", "", None, 2025, 1)]
    same, sure = matching.same_event("a", "b")
    got = {(r.l, r.r): r.sure for r in matching.pairs(spark.createDataFrame(rows, fields), "id", ["block"]).where(same).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), sure.alias("sure")).collect()}
    assert got == {(1, 2): 1.0, (3, 4): 0.98}


def _against_all_pairs(spark, rows, fields, blocks, rule):
    df = spark.createDataFrame(rows, fields)
    a, b = (df.select(F.struct("*").alias(s)) for s in ("a", "b"))
    sure = rule("a", "b")[1]
    every = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), sure.alias("sure")).where(F.col("sure") >= matching.SAME_ENTITY)
    want = {(r.l, r.r): r.sure for r in every.collect()}
    links, members = matching.linked(df, "id", [c for c in df.columns if c != "id"], blocks, rule)
    of = {}
    for r in members.collect():
        of.setdefault(r.representative, []).append(r.id)
    assert sorted(x for m in of.values() for x in m) == sorted(r[0] for r in rows) and all(k == min(m) for k, m in of.items())
    got = {}
    for r in links.collect():
        for x in of[r.left]:
            for y in of[r.right]:
                assert (min(x, y), max(x, y)) not in got
                got[min(x, y), max(x, y)] = r.confidence
    within = {(x, y) for m in of.values() for x in m for y in m if x < y}
    assert got == {k: v for k, v in want.items() if k not in within} and got


def test_linked_events_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    names = ("smartindiahackathon", "smartindiahackathon2", "smartindiahackaton", "codesprint", "")
    rows = [(i, rng.choice(("", "", "", "u1", None)), rng.choice(names), rng.choice(("acmelabs", "acmelab", "zeta")), rng.choice(("pune", "goa", "", None)), rng.choice((None, "x.org", "y.org")), rng.choice((2025, 2026, None))) for i in range(150)]
    rows += [(200 + i, *rows[0][1:]) for i in range(20)]
    _against_all_pairs(spark, rows, "id int, url_key string, name_key string, organizer_key string, city_key string, site string, year int", matching.EVENT_BLOCKS, matching.same_event)


def test_linked_colleges_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = ("governmentcollegeofarts", "governmentcollegeofart", "stxavierscollege", "")
    rows = [(i, rng.choice(("", "", "", "c1", None)), rng.choice((None, None, "a.edu", "")), rng.choice(("goa", "kerala", "", None)), rng.choice(names), rng.choice(("panaji", "kochi", "")), rng.choice(("north", "south", None))) for i in range(150)]
    rows += [(200 + i, *rows[0][1:]) for i in range(20)]
    _against_all_pairs(spark, rows, "id int, code_key string, site string, state_key string, name_key string, city_key string, district_key string", matching.COLLEGE_BLOCKS, matching.same_college)


def test_linked_colleges_with_many_names_against_all_pairs(spark):
    """Names on both sides of what is missing with and without the district, in blocks and without one."""
    import random

    rng = random.Random(6)
    stems = ("customer000", "governmentcollegeofartsand", "")
    rows = [(i, rng.choice(("", None)), rng.choice((None, None, None, "a.edu")), rng.choice(("goa", "goa", "goa", "", None)), rng.choice(stems) + f"{rng.randrange(900):06d}", rng.choice(("panaji", "panaji", "")), rng.choice("123") or None) for i in range(260)]
    rows += [(300 + i, *rows[i][1:5], "panaji", None) for i in range(30)]
    _against_all_pairs(spark, rows, "id int, code_key string, site string, state_key string, name_key string, city_key string, district_key string", matching.COLLEGE_BLOCKS, matching.same_college)


def test_linked_without_rows(spark):
    df = spark.createDataFrame([], "id int, code_key string, site string, state_key string, name_key string, city_key string, district_key string")
    links, members = matching.linked(df, "id", [c for c in df.columns if c != "id"], matching.COLLEGE_BLOCKS, matching.same_college)
    assert links.count() == members.count() == 0


def test_cooled_against_a_plain_loop(spark):
    import random

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    moment = lambda: start + dt.timedelta(hours=rng.randrange(0, 200), minutes=rng.choice((0, 0, 30)))
    history = [(rng.choice("abcde"), moment()) for _ in range(40)] + [("a", None), (None, start)]
    sends = [(i, rng.choice("abcdef"), moment()) for i in range(120)] + [(900, "a", None), (901, None, start + dt.timedelta(hours=1))]
    h, s = spark.createDataFrame(history, "k string, t timestamp_ntz"), spark.createDataFrame(sends, "id int, k string, t timestamp_ntz")
    want = {i for i, k, t in sends if not any(k == kk and t and tt and k and t - dt.timedelta(hours=24) <= tt < t for kk, tt in history)}
    got = flows.cooled(s, h, "k", "t")
    assert got.columns == s.columns and {r.id for r in got.collect()} == want and 0 < len(want) < len(sends)


def test_name_keys_against_python(spark, sf_dir):
    import re
    import unicodedata

    from ledgerlark.plans.text_queries import name_key_folded
    from ledgerlark.tables import table

    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in name_key_folded(spark, sf_dir).collect():
        folded = unicodedata.normalize("NFKD", " ".join(texts[r.doc_id].split())).encode("ascii", "ignore").decode()
        assert r.key == re.sub("[^a-z0-9]", "", folded.lower())


def test_import_ladder_steps(spark):
    """Each step of the ladder once, against five known leads."""
    rows = [
        (1, None, "Acme Pvt Ltd", "Python Developer", "https://acme.com/j/1", "fuzzy", "L1"), (2, None, "ACME", "Python  developer", "https://acme.com/j/9", "fingerprint", "L1"),
        (3, "L2", "Other", "Else", "https://o.org/1", "lead_id", "L2"), (4, None, "Initech Limited", "Data Lead", "https://initech.com/jobs/7/?utm=1", "url", "L3"),
        (5, None, "Globex", "Senior Backend Engineers", "https://globex.io/b", "fuzzy", "L4"), (6, None, "Newco", "Tester", "https://new.co/1", "created", None), (7, None, " ", None, "", "invalid", None),
        (8, None, "Acme", "Python Developer", "https://other.com/j/1", "created", None), (9, None, "Newco", "tester!", "https://new.co/2", "in_file", None),
    ]
    known = [("L1", "Acme", "Python Developer", "https://acme.com/j/5", 5), ("L0", "Acme", "python developer", "https://acme.com/j/6", 1), ("L2", "Zed", "Zed", "https://zed.org/1", 2), ("L3", "Initech Ltd", "Head of Data", "https://initech.com/jobs/7", 3), ("L4", "Globex Inc", "Senior Backend Engineer", "https://globex.io/a", 4)]
    leads = spark.createDataFrame(known, "lead_id string, company string, title string, url string, seen int")
    resolved = imports.resolve(spark.createDataFrame([r[:5] for r in rows], "row int, lead_id string, company string, title string, url string"), leads)
    assert sorted((r.row, r.outcome, r.target) for r in resolved.collect()) == [(r[0], r[5], r[6]) for r in rows]
    assert tuple(imports.tally(resolved).first()) == (9, 2, 4, 2, 1)


def _import_of_repeated_titles(spark, n: int = 1200):
    """n rows and n leads of two companies at one host each with the same dozen of titles, none with a known id, fingerprint or URL."""
    title = F.concat(F.lit("Senior Backend Engineer of Area "), F.col("id") % 12)
    base = spark.range(n).select("id", F.when(F.col("id") % 5 == 0, "Acme").otherwise("Globex").alias("company"), title.alias("title"))
    leads = base.select(F.format_string("L%05d", "id").alias("lead_id"), "company", "title", F.concat(F.lit("https://"), F.lower("company"), F.lit(".com/j/"), "id").alias("url"), (F.col("id") % 50).alias("seen"))
    rows = base.select(F.col("id").alias("row"), F.lit(None).cast("string").alias("lead_id"), "company", F.concat("title", F.lit("s")).alias("title"), F.concat(F.lit("https://"), F.lower("company"), F.lit(".com/x/"), "id").alias("url"))
    return rows, leads


def _counted(spark, monkeypatch):
    from ledgerlark.operators import simjoin

    told = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(simjoin, "overlap", lambda x, y: F.udf(lambda a, b: told.add(1) or len(set(a) & set(b)) / max(1, len(set(a) | set(b))), "double")(x, y))
    return told


def test_import_compares_titles_once(spark, monkeypatch):
    """Of 1,200 rows and as many leads the titles of a company meet, not the rows: the newest lead of all like titles is the same."""
    from ledgerlark.functions.similarity import trigram_similarity

    rows, leads = _import_of_repeated_titles(spark)
    a, b = (df.select(F.col("title").alias(n)).distinct() for df, n in ((rows, "a"), (leads, "b")))
    like = {(r.a, r.b) for r in a.crossJoin(b).where(trigram_similarity(F.col("a"), F.col("b")) >= 0.85).collect()}
    known = sorted(((r.company, r.title, -r.seen, r.lead_id) for r in leads.collect()), key=lambda r: r[2:])
    want = {}
    for company, title in {(r.company, r.title) for r in rows.collect()}:
        want[company, title] = next((k[3] for k in known if k[0] == company and (title, k[1]) in like), None)
    told = _counted(spark, monkeypatch)
    got = imports.resolve(rows, leads).where("first_row = row").collect()
    assert {(r.company, r.title): r.target for r in got} == want and {r.outcome for r in got} == {"fuzzy"}
    assert 0 < told.value <= 2 * 12 * 12


@pytest.mark.parametrize("least", [0.3, 0.85, 1.0])
def test_sets_between_against_all_pairs(spark, least):
    import random

    from ledgerlark.operators import simjoin

    r = random.Random(3)
    a, b = ([(i, sorted(set(r.choices("abcdefghij", k=r.randint(0, 9)))), r.choice(("x", "y", None))) for i in range(90)] for _ in range(2))
    new, known = (spark.createDataFrame(rows, "id long, words array<string>, b string") for rows in (a, b))
    got = [tuple(p) for p in simjoin.sets_between(new, known, "id", "words", ["b"], least).collect()]
    want = {(i, j) for i, x, p in a for j, y, q in b if p and p == q and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_import_without_titles_or_row_numbers(spark):
    """NULL titles are like nothing, and a row without a number has no like title."""
    rows = spark.createDataFrame([(1, None, "Acme", None, "https://acme.com/1"), (None, None, "Acme", "Tester of Parts", "https://acme.com/2"), (3, None, "Acme", "Tester of Part", "https://acme.com/3")], "row int, lead_id string, company string, title string, url string")
    leads = spark.createDataFrame([("L1", "Acme", "Tester of Parts", "https://www.acme.com/9", None), ("L2", "Acme", None, "https://www.acme.com/8", 1)], "lead_id string, company string, title string, url string, seen int")
    assert sorted((r.row or 0, r.outcome, r.target) for r in imports.resolve(rows, leads, 0.8).collect()) == [(0, "created", None), (1, "created", None), (3, "fuzzy", "L1")]


def test_import_tally_compares_titles_once(spark, monkeypatch):
    """A tally of 1,200 rows takes the titles' comparisons only: 24 first rows are fuzzy, the others come earlier in the file."""
    told = _counted(spark, monkeypatch)
    assert tuple(imports.tally(imports.resolve(*_import_of_repeated_titles(spark))).first()) == (1200, 0, 1176, 24, 0)
    assert 0 < told.value <= 2 * 12 * 12
