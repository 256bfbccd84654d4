"""Operators on single texts against plain Python: rules, secrets, fingerprints, tokens, packing, pages."""

from __future__ import annotations

import base64
import bz2
import collections
import gzip
import hashlib
import itertools
import lzma
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import block_lstm, block_lstm_train, fingerprints, html_blocks, mixing, packing, pfor, quality_rules, secrets, textscan, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 30_000
ODD = [None, "", " ", "\n\n", "a", "a\n", "a\na", "a\na\n\n a \na", "x y z x y z", "é ñ\té ñ\ré ñ", "﻿x", "\x00 \x1c", "#$ |\n#$ |", LONG]


def plain_rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def measured(texts: list) -> list[tuple]:
    got = quality_rules._measured(pa.array(texts, pa.string()), quality_rules.Limits())
    return list(zip(*(got[c].tolist() for c in quality_rules.COLUMNS[:5]), strict=True))


def test_rules_of_odd_texts():
    assert measured(ODD) == [plain_rules(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n\t\x1c　", max_size=40), min_size=1, max_size=5))
def test_rules_of_random_texts(texts):
    assert measured(texts) == [plain_rules(t) for t in texts]


def test_repeated_passages_are_rejected_and_prose_is_kept():
    r = random.Random(1)
    prose = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(300))
    some = " ".join(prose.split()[:120])
    texts = [prose, " ".join([some] * 3), "\n".join([prose[:300]] * 5), prose + " " + some[:60]]
    assert quality_rules._measured(pa.array(texts), quality_rules.Limits())["kept"].tolist() == [True, False, False, True]


def test_gram_coverage_against_sets():
    r = random.Random(2)
    texts = [" ".join(r.choices("a b c d e f".split(), k=60)) for _ in range(20)]
    got = quality_rules._measured(pa.array(texts), quality_rules.Limits())["dup_gram_chars"]
    for text, n in zip(texts, got.tolist(), strict=True):
        words, seen, inside = text.split(), set(), set()
        for i in range(len(words) - 4):
            g = tuple(words[i : i + 5])
            if g in seen:
                inside |= set(range(i, i + 5))
            seen.add(g)
        assert n == sum(len(words[i]) for i in inside)


SECRET = "token=abcdefghijklmnop1"


def wrapped() -> list[str]:
    b64 = base64.b64encode(SECRET.encode()).decode()
    quoted = urllib.parse.quote(SECRET, safe="")
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    return [
        quoted,
        urllib.parse.quote(quoted, safe=""),
        b64,
        base64.b64encode(b64.encode()).decode(),
        base64.b64encode(zlib.compress(SECRET.encode())).decode(),
        base64.b64encode(gzip.compress(f"é {b64} é".encode())).decode(),
        escaped,
        "".join(f"%{b:02X}" for b in b64.encode()),
        base64.urlsafe_b64encode(f"é?>{SECRET}".encode()).decode(),
    ]


@pytest.mark.parametrize("inner", wrapped())
def test_nested_secrets_map_to_their_place(inner):
    text = f"é before {inner} after"
    base, spans, depth = secrets.scan_text(text)
    assert depth >= 1 and len(spans) > len(base)
    start, _, end = next(s for s in spans if s not in base)
    assert 9 <= start < end <= 9 + len(inner)
    assert SECRET not in secrets.redacted(text) and inner not in secrets.redacted(text)
    assert secrets.redacted(text).startswith("é before ") and secrets.redacted(text).endswith(" after")


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, lambda raw: raw.decode().encode("utf-16"), lambda raw: b"\x01" + raw + b"\xff"])
@pytest.mark.parametrize("form", ["wrapped", "crlf", "path/", "a-b_", "xx/yyy/"])
def test_secrets_in_wrapped_and_shifted_base64(pack, form):
    wide = " ".join(f"{k * 7919 % 10007:x}q" for k in range(60))  # more than a line, also compressed
    code = base64.b64encode(pack(f"{wide} {SECRET} {wide}".encode())).decode()
    if form in ("wrapped", "crlf"):
        code = ("\r\n" if form == "crlf" else "\n").join(code[k : k + 76] for k in range(0, len(code), 76))
    else:
        code = form + code
    text = f"é before {code} after"
    _, spans, depth = secrets.scan_text(text)
    assert spans and depth == 1 and all(text.index(code) <= s < e <= text.index(code) + len(code) for s, _, e in spans)
    left = secrets.redacted(text)
    assert not secrets.scan_text(left)[1] and left.startswith("é before ") and left.endswith(" after")


def plain_base(text: str | None) -> str:
    text, out = text or "", []
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for s, k, e in sorted(found):
        out.append(f"{secrets.KINDS[k]}:{s}:{e}")
    return ",".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "API_key", "pass", "word", ":", "=", " ", '"', "0123456789abcdef", "AKIA", "ABCDEFGHIJ", "x", "ſ", "K", "%41", "\\u0041", "\n"]), max_size=12).map("".join))
def test_base_spans(text):
    base, spans, _ = secrets.scan_text(text)
    assert secrets.joined(base) == plain_base(text)
    assert set(base) <= set(spans) and spans == sorted(spans)


def test_cycles_and_odd_texts_end():
    for text in [*ODD, "%", "%4", "%25" * 50, "\\", "\\u", "\\ud800", "A" * 5000, "%u0041", "\\u{110000}"]:
        base, spans, _ = secrets.scan_text(text)
        assert set(base) <= set(spans)
    assert secrets.redacted(None) is None


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda raw: gzip.compress(b"first") + gzip.compress(raw), lambda raw: zlib.compress(gzip.compress(raw))])
@pytest.mark.parametrize("where", ["end", "middle", "edge"])
def test_large_layers_are_scanned_whole(pack, where, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 11)
    n = {"end": 50_000, "middle": 20_000, "edge": (1 << 14) - 20}[where]
    code = base64.b64encode(pack(b"a " * (n // 2) + b" " * (n % 2) + SECRET.encode() + b" b" * (0 if where == "end" else 9000))).decode()
    text = f"é before {code} after"
    _, spans, depth = secrets.scan_text(text)
    assert spans and depth >= 1
    assert all(s <= text.index(code) + 90 and e >= text.index(code) + len(code) - 4 for s, _, e in spans)
    assert SECRET not in secrets.redacted(text) and len(secrets.redacted(text)) < 120


FILL = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:9] + "." for k in range(9000)).encode()  # packs badly


@pytest.mark.parametrize("middle", ["gzip", "zlib", "bz2", "lzma", "base64", "lines", "base64 gzip", "gzip base64", "base64 base64", "zlib bz2", "lines gzip base64", "percent", "utf-16", "percent base64", "base64 utf-16"])
@pytest.mark.parametrize("lead", [0, 1, 9_000, 16_000, 40_000])
def test_nested_streams_go_over_the_edges_of_windows(middle, lead, monkeypatch):
    """What a small window gives is what an unbounded one gives: nothing is lost at an edge."""
    packs = {
        "gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "lzma": lzma.compress, "base64": base64.b64encode, "utf-16": lambda raw: raw.decode("latin-1").encode("utf-16-le"),
        "lines": base64.encodebytes, "percent": lambda raw: "".join(f"%{b:02X}" for b in raw).encode(),
    }
    raw = FILL + b" " + SECRET.encode() + b" " + FILL[:30_000]
    for name in reversed(middle.split()):
        raw = packs[name](raw)
    code = base64.b64encode(gzip.compress(FILL[:lead] + b" cfg = " * (lead > 0) + raw + b" . " + FILL[:5000])).decode()
    text = f"é before {code} after"
    want = secrets.scan_text(text)[1]
    assert any(s < 12 and e > len(text) - 12 for s, _, e in want)
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 11)
    got = secrets.scan_text(text)[1]
    assert set(want) <= set(got)  # bytes that look like a stream and are none may give more at other edges
    assert all(9 <= s < e <= len(text) - 6 for s, _, e in got) and len(got) <= len(want) + 1


def test_a_stream_that_holds_itself_ends(monkeypatch):
    """Layers of zeros, and streams whose content begins like them again."""
    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 11)
    deep = b"x"
    for _ in range(20):
        deep = zlib.compress(deep + b" " * 3000)
    for raw in (deep, gzip.compress(bytes(1 << 20)), zlib.compress(b"x^" * 5000), b"x\x9c" * 3000):
        assert secrets.scan_text(base64.b64encode(raw).decode())[1] == secrets.scan_text(base64.b64encode(raw).decode())[0]


TEXTS = st.text(alphabet="abé", max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, st.data())
def test_extensions_of_prefix_hashes(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert fingerprints.Prefix(a).extension(i, fingerprints.Prefix(b), j) == n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.text(max_size=200))
def test_likeness(a, b):
    x, y = (fingerprints.parsed(fingerprints.fingerprint(t)) for t in (a, b))
    near = fingerprints.likeness(x, y)
    assert 0 <= near <= 1 and near == fingerprints.likeness(y, x) and fingerprints.likeness(x, x) == 1
    assert (fingerprints.fingerprint(a) == fingerprints.fingerprint(b)) == (a == b)
    both = fingerprints.parsed(fingerprints.fingerprint(a + b))
    shared = x.coarse(fingerprints.level_of(len(a + b))).at[:-1]
    assert not len(shared) or fingerprints.likeness(x, both) >= shared[-1] / len(a + b) - 1e-12
    assert near == pytest.approx(likeness_by_hand(a, b))


def likeness_by_hand(a: str, b: str) -> float:
    """Equal cells as strings, each counted as often as both texts have it."""
    if a == b or not a or not b:
        return float(a == b)
    level = max(fingerprints.level_of(len(a)), fingerprints.level_of(len(b)))
    cells = []
    for t in (a, b):
        at = [0, *fingerprints.made(t).coarse(level).at.tolist()]
        cells.append(collections.Counter(t[i:j] for i, j in itertools.pairwise(at)))
    return sum(len(c) * n for c, n in (cells[0] & cells[1]).items()) / max(len(a), len(b))


@pytest.mark.parametrize("n", [150, 1200, 5000, 80_000])
def test_likeness_of_edited_prose(n):
    r = random.Random(n)
    words = ["".join(r.choices("abcdefghijklmnopq", k=r.randint(2, 9))) for _ in range(n // 6)]
    text, other = " ".join(words), " ".join(r.sample(words, len(words) // 2) * 2)
    own, got = fingerprints.made(text), []
    for _ in range(40):
        k = r.randrange(len(text))
        edited = text[:k] + r.choice(["x", "", "two new words"]) + text[k + r.randrange(2) :]
        got.append(fingerprints.likeness(own, fingerprints.parsed(fingerprints.fingerprint(edited))))
        assert got[-1] == pytest.approx(likeness_by_hand(text, edited))
    moved = text[len(text) // 3 :] + text[: len(text) // 3]
    assert fingerprints.likeness(own, fingerprints.made(moved)) >= (0.5 if n < 1000 else 0.9)
    assert np.mean(got) >= (0.8 if n < 1000 else 0.95)
    if n == 5000:
        assert fingerprints.likeness(own, fingerprints.made("x" + text)) >= 0.9
    assert fingerprints.likeness(own, fingerprints.made(other)) < 0.35


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ß", "É", "é", "'s", "'S", "'ll", "1", " ", "\n", "\x1c", "\x85", "　", "İ", "Σ", "<|endoftext|>", "!", "K", "日", "\x00", "ª"]), max_size=15).map("".join))
def test_ids_are_the_tokenizers(encoder, text):
    ids, at = encoder.encode([text, "x " + text])
    for k, t in enumerate((text, "x " + text)):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_full_cache_gives_the_same_ids(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    r = random.Random(3)
    for _ in range(20):
        text = " ".join("".join(r.choices("abcdé", k=r.randint(1, 4))) for _ in range(50))
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.integers(0, 100))
def test_frame_of_reference_round_trip(ids, percentile):
    x = np.array(ids, dtype=np.uint32)
    lengths = np.array([len(x)])
    got = pfor.from_bytes(pfor.to_bytes(np.array([7]), np.array([False]), lengths, x, percentile))
    assert got[3].tolist() == ids and got[0].tolist() == [7] and got[2].tolist() == [len(x)]


def test_one_document_by_the_index_of_blocks(tmp_path):
    r = random.Random(8)
    docs = [[r.randrange(1 << r.choice([3, 9, 31])) for _ in range(n)] for n in (0, 1, 255, 256, 257, 5000, 3, 0, 700)]
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    path = tmp_path / "x.pfor"
    path.write_bytes(pfor.to_bytes(np.arange(len(docs)), np.zeros(len(docs), dtype=bool), np.array([len(d) for d in docs]), flat))
    assert [pfor.read_document(f"file://{path}", k).tolist() for k in range(len(docs))] == docs
    with pytest.raises(IndexError):
        pfor.read_document(f"file://{path}", len(docs))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_its_own_ids(name):
    own = tokens.Encoder(public_tokenizers.path(name))
    texts = ["", "Hello  World\n it's", "ÄÖ é日本 x1y22", "<|endoftext|> a", LONG[:3000]]
    ids, at = own.encode(texts)
    assert own.by_words == (name == "word_bpe_49k.json")
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_outliers_cost_little():
    x = np.arange(25_600, dtype=np.uint32) % 200
    small = len(pfor.pack_ids(x)[1])
    x[::100] = 40_000
    assert len(pfor.pack_ids(x)[1]) < 1.3 * small < 1.5 * len(x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=60))
def test_packs_are_full_and_whole(sizes):
    own = packing.Pack(length=64, scale=64)
    doc, start, length, sequence, offset = packing.place(np.array(sizes), own)
    for d, n in enumerate(sizes):
        pieces = sorted(zip(start[doc == d].tolist(), length[doc == d].tolist(), strict=True))
        at = 0
        for s, k in pieces:
            assert s == at and k > 0
            at += k
        assert at == n
    for s in set(sequence.tolist()):
        inside = sorted(zip(offset[sequence == s].tolist(), length[sequence == s].tolist(), strict=True))
        assert [o for o, _ in inside] == [sum(k for _, k in inside[:i]) for i in range(len(inside))]
        total = sum(k for _, k in inside)
        assert total == 64 or total & (total - 1) == 0 and total < 64


def test_packing_balances_cost():
    sizes = np.array([900] * 40 + [100] * 160 + [20] * 200)
    doc, _, length, sequence, _ = packing.place(sizes, packing.Pack(length=1000, scale=1000))
    cost = np.bincount(sequence, length + length**2 / 1000)
    rows = np.bincount(sequence, length) == 1000
    assert cost[rows].max() < 2.2 * cost[rows].min()


def test_apportionment_against_the_quotient_list():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 8)
        votes = [float(r.choice([0, 1, 2, 3.5, 10, 100])) for _ in range(n)]
        seats, limits = r.randint(0, 60), [r.randint(0, 20) for _ in range(n)]
        held = [0] * n
        for _ in range(min(seats, sum(m for v, m in zip(votes, limits, strict=True) if v > 0))):
            i = min((i for i in range(n) if votes[i] > 0 and held[i] < limits[i]), key=lambda i: (-votes[i] / (2 * held[i] + 1), i))
            held[i] += 1
        assert mixing.apportion(votes, seats, limits) == held


def test_targets():
    assert mixing.capped_targets([10, 10], [1, 3], 3) == [5.0, 15.0]
    got = mixing.capped_targets([100, 1, 0], [1, 100, 5], 3)
    assert got == [98.0, 3.0, 0.0]
    assert mixing.capped_targets([], [], 3) == []


PAGES = {
    "<p>a < b &amp;amp; c</p>": ["a < b &amp; c"],
    "<div>foo<b>bar</b> baz<br>q</div>": ["foobar baz", "q"],
    "x<script>var t='</p>'</script>y": ["x", "y"],
    "<ul><li>a<li>b</ul><p>c<p>d<div>e</div>": ["a", "b", "c", "d", "e"],
    "<p title='a>b'>t</p>": ["t"],
    "<p>unfinished <a href=": ["unfinished"],
    "": [],
    "<": ["<"],
    "a&nbsp;b &#x41;&copy": ["a b A©"],
    "<p hidden>x</p>y": ["x", "y"],
    "Press the <button>Start</button> control": ["Press the Start control"],
    "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds": ["so x=2 holds"],
    "<noscript><p>a</p></noscript><textarea>b</textarea>": ["a", "b"],
    "<head><title>t</title><p>left open": ["left open"],
    "<svg><title>logo</title><text>go</text></svg> home": ["logogo home"],
    "<i>a<div>b</i>c</div>d": ["a", "bc", "d"],
    "<!-- a > b --><p>z": ["z"],
    "<style>p{}": [],
    "<title>t</title><select><option>x</select>k": ["x", "k"],
    "<p>it's <b class=\"x>k</b>": ["it's k"],
}


@pytest.mark.parametrize("page", list(PAGES))
def test_blocks(page):
    assert [b.text for b in html_blocks.blocks(page)] == PAGES[page]


def test_the_time_of_blocks_grows_with_the_page():
    """Each of these takes minutes where an end tag or a path looks at all open elements."""
    n = 40_000
    began = time.monotonic()
    assert len(html_blocks.blocks("<div>x" * n)) == n
    assert len(html_blocks.blocks("<b>" * n + "<li>x" * n)) == n
    assert html_blocks.blocks("<i><div>" + "<b>" * n + "</i>" * n) == []
    assert html_blocks.blocks("<a '" * (n + 1)) == []
    assert time.monotonic() - began < 60


def kept(page: str) -> list[str]:
    found = html_blocks.blocks(page)
    return [b.text for b, y in zip(found, block_lstm.label([found])[0], strict=True) if y >= 0.5]


def test_main_text_is_judged_not_dropped_by_tag():
    """Buttons, formulas, noscript and hidden parts of the article stay; those of menus, forms and notices go."""
    prose = "The river rises in the north of the valley, and it runs past three mills before it meets the sea."
    page = (
        "<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><noscript>Please enable JavaScript.</noscript>"
        f"<article><h1>The river and its mills</h1><p>{prose}</p><p>Press the <button>Start</button> control, then wait until the pump has run for an hour.</p>"
        f"<p>The level is <math><mi>h</mi><mo>=</mo><mn>2</mn></math> metres in spring and falls below one metre in autumn.</p><noscript><p>{prose}</p></noscript><p>{prose}</p></article>"
        "<form class=search><select><option>One</option><option>Two</option></select><button>Search</button></form><footer><p>Privacy Policy</p></footer></body>"
    )
    assert kept(page) == [
        "The river and its mills", prose, "Press the Start control, then wait until the pump has run for an hour.",
        "The level is h=2 metres in spring and falls below one metre in autumn.", prose, prose,
    ]


def test_pages_of_div_alone():
    prose = "The river rises in the north of the valley, and it runs past three mills before it meets the sea."
    page = f"<div><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><h1>The river and its mills</h1><p>{prose}</p><p>{prose} {prose}</p><p>{prose}</p></div><div>Copyright 2024 Example. All rights reserved.</div></div>"
    assert kept(page) == ["The river and its mills", prose, f"{prose} {prose}", prose]


def test_labeller_on_pages_it_has_not_seen():
    found = [block_lstm_train.example(2_000_000_000 + k) for k in range(150)]
    right = total = 0
    for (_, y), p in zip(found, block_lstm.label([b for b, _ in found]), strict=True):
        right += int(((p >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert right / total > 0.99


def test_labels_do_not_depend_on_the_batch():
    pages = [block_lstm_train.example(k)[0] for k in range(40)]
    together = block_lstm.label(pages)
    for page, want in zip(pages, together, strict=True):
        assert np.allclose(block_lstm.label([page])[0], want, atol=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in block_lstm_train.start(rng).items()}
    batch = [(block_lstm.inputs(b), y) for b, y in (block_lstm_train.example(k) for k in range(3))]
    _, g = block_lstm_train.step(p, batch)
    for name in ("fw", "bu", "out", "words", "paths"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-3
        up, _ = block_lstm_train.step(p, batch)
        p[name][at] = old - 1e-3
        down, _ = block_lstm_train.step(p, batch)
        p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4


def test_chunks_hold_whole_documents():
    texts = ["a b", None, "", LONG, "c"] * 3
    seen = [c for c in textscan.chunks(pa.array(texts, pa.string()), 1000)]
    assert sum(c.n_docs for c in seen) == len(texts)
    assert np.concatenate([c.n_words for c in seen]).tolist() == [len((t or "").split()) for t in texts]
    assert hashlib.md5(b"".join(c.data.tobytes() for c in seen)).hexdigest() == hashlib.md5("".join(t or "" for t in texts).encode()).hexdigest()
