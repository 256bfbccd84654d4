"""Operators over tables: nulls, ties, repeats, empty tables, clashing columns, and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import block_lstm, fingerprints, minhash, mixing, packing, pfor, quality_rules, rulefit, secrets, toxicity
from ledgerlark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, as extra columns of the input.
CLASHES = "size taken shard source_size row key node component kept of label d1 d2 n bands run guest score text_2 batch id place".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(" ", "  ", 3).split(" ")
    near[60] = "changed"
    rows = [(0, base, "a"), (1, base, "b"), (2, " ".join(near), None), (3, None, "a"), (4, "", None), (5, " \n", "é"), (6, "one", "a"), (7, "one two", "b")]
    rows += [(8, prose(8, 3000), "a"), (9, prose(9, 200), "b"), (9, prose(9, 200), "b"), (None, prose(10, 80), "a"), (None, base, "b"), (11, 'token = "abcdefghijklmnop"', "a")]
    return [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *(["x"] * len(CLASHES))) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_rules(odd):
    got = collections.Counter((r.doc_id, r.n_words, r.kept) for r in quality_rules.measure(odd).collect())
    assert got[9, 200, True] == 2 and got[3, 0, False] == 1 and got[8, 3000, True] == 1 and sum(got.values()) == 14
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert quality_rules.measure(odd.limit(0)).count() == quality_rules.keep(odd.limit(0)).count() == 0


def mix_by_hand(rows: list[tuple], plan: mixing.Plan) -> dict[str | None, float]:
    sizes: dict[str | None, int] = collections.defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: plan.weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]] if total else []
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(target.values())


def test_mix(odd, docs):
    for df, plan in ((odd, mixing.Plan(block=4, shard=500)), (docs, mixing.Plan()), (docs, mixing.Plan(block=8, shard=300))):
        want = mix_by_hand([(r.doc_id, r.text, None, r.source) for r in df.select("doc_id", "text", "source").collect()], plan)
        rows = mixing.mix(df, plan).collect()
        assert len(rows) == df.count()
        taken, target, n_shards = collections.Counter(), {}, collections.Counter()
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            n_shards[r.source] += r.size
        for s, t in target.items():
            assert t == pytest.approx(want[s])
            assert abs(taken[s] - t) <= plan.block * (1 + 2 * (n_shards[s] // plan.shard + 1))
        again = sorted(map(repr, mixing.mix(df.repartition(5), plan).collect()))
        assert again == sorted(map(repr, rows))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixed_documents_have_the_words_taken(odd):
    plan = mixing.Plan(block=4, shard=500)
    taken = sum(r.taken for r in mixing.mix(odd, plan).collect())
    got = mixing.mixed(odd, plan)
    assert got.columns == odd.columns
    rows = got.collect()
    assert taken == sum(len(WORD.findall(r.text)) for r in rows)
    whole = {r.text for r in odd.collect()}
    assert all(r.n_chars == len(r.text) and any((t or "").startswith(r.text) for t in whole) for r in rows)
    assert mixing.mixed(odd.limit(0), plan).count() == 0


def test_mix_down_a_tree_of_shards(docs, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    plan = mixing.Plan(block=8, shard=200)
    rows = mixing.mix(docs, plan).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert len(rows) == docs.count()
    for s, t in target.items():
        assert abs(taken[s] - t) <= plan.block * (2 + size[s] // plan.shard)


@pytest.mark.parametrize("copies", [1024, 7])
def test_equal_rows_take_equal_parts(spark, copies, monkeypatch):
    """Give or take a word where they are in one piece; mixed() cuts just as many rows."""
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(None, "a b c d e f g h", "x", i) for i in range(40)] + [(7, "one two three", "x", i) for i in range(3)] + [(k, prose(k, 9), "y", 0) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(5)
    plan = mixing.Plan(block=4, shard=50)
    got = mixing.mix(df, plan).collect()
    each = collections.defaultdict(list)
    for r in got:
        each[r.doc_id, r.source].append(r.taken)
    assert len(got) == 73 and (copies < 40 or all(max(t) - min(t) <= 1 for t in each.values()))
    words = collections.Counter()
    for r in mixing.mixed(df, plan).collect():
        words[r.doc_id, r.source, r.other] += len(WORD.findall(r.text))
    for key, taken in each.items():
        assert sorted(w for (d, s, _), w in words.items() if (d, s) == key) == sorted(t for t in taken if t)


def near_targets(spark, rows: list[tuple]) -> None:
    """Every source's words are within a half of a hundredth of its target, or a document."""
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    want = mix_by_hand([(d, t, None, s) for d, t, s in rows], mixing.Plan())
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1.0, min(0.005 * t, longest[s])), (s, t, taken[s])


@pytest.mark.parametrize("sources", [1, 2, 9, 300, 1000])
def test_sources_of_any_size_come_near_their_targets(spark, sources):
    r = random.Random(sources)
    rows = []
    for s in range(sources):
        left = int(10 ** r.uniform(0, 4 if sources < 100 else 3))
        while left > 0:
            n = min(left, r.choice([1, 5, 40, 700]))
            text = " ".join(["w"] * n)
            rows.append((len(rows) if r.random() < 0.7 else None, text, f"s{s}" if s % 97 else None))
            left -= n
    near_targets(spark, rows)


def test_small_sources_and_equal_rows_come_near_their_targets(spark):
    near_targets(spark, [(1, "a " * 30, "p"), (2, "a " * 28, "q")])
    near_targets(spark, [(5, "a b c d e f g h i j", "p")] * 3000 + [(i, prose(i, 100), "q") for i in range(100)])
    near_targets(spark, [(5, "a b", "p")] * 1000 + [(i, prose(i, 10), "q") for i in range(40)])


def test_secrets(odd):
    got = {r.doc_id: r for r in secrets.scan(odd).collect()}
    assert got[11].n_assign == 1 and got[11].spans == "assign:0:25" and got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and {r.doc_id: r.text for r in clean.collect()}[11] == '[assign]"'
    assert secrets.scan(odd.limit(0)).count() == secrets.redact(odd.limit(0)).count() == 0


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes_by_hand(rows: list[tuple[int | None, str | None]]) -> list[set[int]]:
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if (not a and not b) or (both and both >= 0.8 * (len(a) + len(b) - both)):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    return list(groups.values())


def near_copies(seed: int, n: int, edits: int) -> list[str]:
    r, base = random.Random(seed), prose(seed, 150).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[r.randrange(len(words))] = "z" + str(r.random())
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("near", ["odd", "copies", "documents"])
def test_classes_against_all_pairs(spark, odd, docs, near):
    if near == "copies":  # groups whose members are partly above and partly below the threshold
        texts = near_copies(20, 40, 2) + near_copies(21, 40, 5) + [prose(s, 60) for s in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = (odd if near == "odd" else docs).select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want = collections.Counter()
    for g in classes_by_hand(rows):
        ids = [rows[i][0] for i in g]
        least = min((d for d in ids if d is not None), default=None)
        want.update((d, least, len(g)) for d in ids)
    assert collections.Counter(map(tuple, minhash.classes(df).collect())) == want


def test_large_group_against_all_pairs(spark):
    """Members on both sides of the threshold, most of them linked to few others."""
    texts = near_copies(30, 150, 3) + near_copies(30, 150, 4) + near_copies(30, 300, 5)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter(frozenset(g) for g in classes_by_hand(rows))
    got = collections.defaultdict(set)
    for r in minhash.classes(df).collect():
        got[r.class_id].add(r.doc_id)
    assert collections.Counter(map(frozenset, got.values())) == want


def test_links_of_blocks_against_sets(monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 16)
    monkeypatch.setattr(minhash, "TALL", 4)
    r = random.Random(3)
    sets = [set(r.sample(range(20), r.randint(6, 20))) | {100 + k} for k in range(40)]
    node, component = np.arange(40) * 7, np.array([k % 17 if k % 3 else 0 for k in range(40)])
    at = np.cumsum([0, *map(len, sets)])
    key = np.array([x for s in sets for x in sorted(s)], dtype=np.int64)
    for second in (np.zeros(40, dtype=bool), np.arange(40) % 2 == 1):
        want = {(7 * i, 7 * j) for i in range(40) for j in range(i + 1, 40) if component[i] != component[j] and (second[i] != second[j] or not second.any()) and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
        got = set(zip(*(x.tolist() for x in minhash.links_of_blocks(node, component, second, key, at, 0.6)), strict=True))
        assert want and got <= want and len(got) < len(set(component.tolist()))
        groups = []
        for links in (want, got):
            label = {c: c for c in set(component.tolist())}
            for u, v in links:
                x, y = label[component[u // 7]], label[component[v // 7]]
                label = {c: min(x, y) if k in (x, y) else k for c, k in label.items()}
            groups.append(label)
        assert groups[0] == groups[1]


def test_one_of_each_class_stays(odd):
    got = minhash.keep_first(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 3, 6, 7, 8, 9, 11] and sum(r.doc_id is None for r in rows) == 1
    assert minhash.classes(odd.limit(0)).count() == minhash.keep_first(odd.limit(0)).count() == 0


def in_order(df) -> list[tuple]:
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_token_files_round_trip(spark, odd, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    for df, form in ((odd, pfor.Format(file_ids=500)), (docs, pfor.Format())):
        want, before = [], 0
        for d, text in in_order(df):
            ids = np.array([*own.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
            want.append((d, before, len(ids), zlib.crc32(ids.tobytes())))
            before += len(ids)
        got = [tuple(r) for r in pfor.encode(df, TOKENIZER, 2, form).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert pfor.encode(odd.limit(0), TOKENIZER).count() == 0


def test_packing_covers_every_id_once(odd, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    for df in (odd, docs):
        rows = packing.pack_documents(df, TOKENIZER, packing.Pack(group=20_000)).collect()
        crcs = collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
        assert sum(crcs.values()) == df.count()
        by_seq = collections.defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append((r.offset, r.length))
        for pieces in by_seq.values():
            pieces.sort()
            total = 0
            for offset, length in pieces:
                assert offset == total and length > 0
                total += length
            assert total == 4096 or total & (total - 1) == 0
        texts = collections.defaultdict(list)
        for d, t in in_order(df):
            texts[d].append(np.array([*own.encode(t, add_special_tokens=False).ids, 2], dtype="<u4"))
        want = collections.Counter(d for d, x in texts.items() for _ in x)
        assert sum(r.length for r in rows) == sum(len(i) for x in texts.values() for i in x)
        for r in rows:
            assert any(len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in texts[r.doc_id])
        assert collections.Counter(r.doc_id for r in rows if r.start == 0) == want
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_fingerprints_against_lists(spark, odd, docs):
    for df in (odd, docs, docs.limit(1)):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for k, (d, text) in enumerate(rows):
            following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            own, new, theirs = (fingerprints.fingerprint(t) for t in (text, edited, following))
            near = [fingerprints.likeness(fingerprints.parsed(own), fingerprints.parsed(x)) for x in (new, theirs)]
            want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, *near))
        got = [tuple(r) for r in fingerprints.fingerprint_documents(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert fingerprints.fingerprint_documents(odd.limit(0)).count() == 0


def labelled(spark) -> tuple:
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = prose(i, 60).split()
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[r.randrange(60)] = r.choice(("foulword", "vilest", "Stenchful!"))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(5000, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "good"), [(rulefit, "quality", lambda i: i % 5 != 0), (toxicity, "toxic", lambda i: i % 7 == 0)])
def test_held_out_accuracy(spark, odd, module, column, good):
    docs, labels = labelled(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = module.fit(docs, labels, ~held)
    rows = module.score_documents(docs, model).where(held).collect()
    wrong = [r.doc_id for r in rows if (r.score >= 0.7) != good(r.doc_id)]
    assert len(rows) > 150 and len(wrong) <= 0.02 * len(rows)
    got = module.score_documents(odd, model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    nothing = module.fit(docs, labels.limit(0), ~held)
    assert module.score_documents(odd, nothing).count() == 14
    assert module.score_documents(odd.limit(0), model).count() == 0


def test_rules_compile_to_what_they_predict(spark):
    docs, labels = labelled(spark)
    model = rulefit.fit(docs, labels, F.lit(True))
    rows = rulefit.score_documents(docs, model).collect()
    x = np.array([[r[n] for n in rulefit.STATISTICS] for r in rows])
    assert np.allclose(model.predict(x), [r.score for r in rows]) and 0 < len(model.rules) < 100


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity.Index, "DENSE", 3)
    r = np.random.default_rng(6)

    def unit(n: int) -> tuple:
        t = np.sort(r.choice(40, n, replace=False))
        w = r.random(n) + 0.01
        return t, w / np.sqrt((w * w).sum())

    rows = [unit(r.integers(1, 8)) for _ in range(400)]
    rows += rows[:30]  # ties
    index = toxicity.Index(rows, r.integers(0, 2, len(rows)).tolist(), list(range(len(rows))), 16, 40)
    full = np.zeros((len(rows), 40))
    for i, (t, w) in enumerate(index.rows):
        full[i, t] = w
    queries = [unit(4) for _ in range(100)]
    for (t, w), (score, near) in zip(queries, index.nearest(queries, 10), strict=True):
        q = np.zeros(40)
        q[t] = w
        want = full @ q
        assert np.allclose(score, np.sort(want)[::-1][:10][np.sort(want)[::-1][:10] > 0]) and np.allclose(want[near], score) and len(set(near.tolist())) == len(near)


def test_toxicity_against_plain_python(spark):
    """The whole operator: terms, weights, neighbours, votes and calibration."""
    docs, labels = labelled(spark)
    own = toxicity.Settings(k=7)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels, F.col("doc_id") < 500, own)).collect()}
    label = collections.defaultdict(int)
    for r in labels.collect():
        if r.toxic is not None and r.doc_id < 500:
            label[r.doc_id] = max(label[r.doc_id], r.toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counted = {d: collections.Counter(t for w in x.split() for t in toxicity.terms_of(w)) for d, x in texts.items()}
    n, toxic, total = collections.Counter(), collections.Counter(), len(label)
    for d, y in label.items():
        n.update(set(counted[d]))
        toxic.update(set(counted[d]) if y else ())
    positive, weight = sum(label.values()), {}
    for t, c in n.items():
        if 5 <= c < total:
            a, b, q = toxic[t], c - toxic[t], total - positive
            chi = total * (a * (q - b) - b * (positive - a)) ** 2 / (c * (total - c) * positive * q)
            weight[t] = (1 + np.log((1 + total) / (1 + c))) * (chi + 0.05) ** own.told
    vectors = {}
    for d, c in counted.items():
        raw = {t: (1 + np.log(k)) * weight[t] for t, k in c.items() if t in weight}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        vectors[d] = {t: w / norm for t, w in raw.items()}

    def vote(d: int) -> float:
        near = sorted(((sum(w * vectors[e].get(t, 0.0) for t, w in vectors[d].items()), e) for e in label if e != d or d not in label), reverse=True)[: own.k]
        return sum(s * s * label[e] for s, e in near) / (sum(s * s for s, _ in near) + own.far)

    knots = toxicity.isotonic(np.array([vote(d) for d in sorted(label)]), np.array([label[d] for d in sorted(label)]))
    for d in range(500, 620):
        assert got[d] == pytest.approx(float(np.interp(vote(d), *knots)), abs=1e-6)


def test_main_text_of_pages(spark, sf_dir):
    import html as H

    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in block_lstm.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = (" ".join(H.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("<(?:/?p|/?h1|br)>", article))
        assert got[r.page_id].text == " ".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>", "x"), (2, "u", "<script>", "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in block_lstm.extract(odd).collect()] == [""] * 4
    assert block_lstm.extract(odd.limit(0)).count() == 0


def test_pipeline_by_hand(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality_rules.measure(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    firsts = {min(rows[i][0] for i in g) for g in classes_by_hand(rows)}
    clean = [(d, secrets.redacted(t), "en", s, 0) for d, t, s in ((r.doc_id, r.text, r.source) for r in docs.collect()) if d in firsts]
    wanted = mix_by_hand(clean, mixing.Plan())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and {r.doc_id for r in got} <= firsts
    assert len(corpus_pipeline.STAGES) == 5
    words = sum(len(WORD.findall(t)) for _, t, *_ in clean)
    assert sum(wanted.values()) == pytest.approx(words)
    frame = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = [(r.doc_id, r.text) for r in mixing.mixed(frame).collect()]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((d, len(own.encode(t, add_special_tokens=False).ids) + 1) for d, t in mixed)
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    """Nulls, empty texts, repeated rows, clashing columns and no rows at all go through every stage."""
    import corpus_pipeline
    from ledgerlark.llm.common import staged

    last = corpus_pipeline.STAGES[-1][1]
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            assert docs.columns == odd.columns
            if name == "near-duplicates":  # long texts only, one of each class; 9 is there twice and one text has no id
                assert start is not odd or sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()) == [-1, 0, 8, 9]
        pieces = last(spark, docs, sf_dir).collect()
        assert bool(pieces) == (start is odd)
        assert all(0 < r.length <= 4096 and r.doc_id in (None, 0, 8, 9) for r in pieces)
