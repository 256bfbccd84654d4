"""Words and queries of a batch at once: the same results as one by one, each word learned once."""

from __future__ import annotations

import collections
import pickle
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerlark.llm import pfor, tokens, toxicity
from ledgerlark.llm.interned import Interned

ODD = ["", "  ", "Ünï x_y 12ab ΑΣ Β it's", "İİ a\x1cb\x85c don't½", "日本 語  abcdefghij\n\nabcdef", "The theme, THE THEMES", "the theme"]


def test_terms_of_a_batch_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(toxicity, "_CACHE_WORDS", 20)
    r = random.Random(4)
    texts = ODD + [" ".join("".join(r.choices("abcdé-", k=r.randint(1, 9))) for _ in range(r.randint(0, 60))) for _ in range(60)]
    names = sorted({t for x in texts[::2] for w in x.split() for t in toxicity.terms_of(w)})
    model = toxicity.Model({t: i for i, t in enumerate(names)}, np.ones(len(names)), toxicity.Settings())
    for at in range(0, len(texts), 20):
        for text, (term, count) in zip(texts[at : at + 20], model.counts(texts[at : at + 20]), strict=True):
            want = collections.Counter(model.terms[t] for w in text.split() for t in toxicity.terms_of(w) if t in model.terms)
            assert dict(zip(term.tolist(), count.tolist(), strict=True)) == want and term.tolist() == sorted(want)
    assert model.counts([]) == []


@pytest.mark.parametrize("dense", [0, 3, 500])
def test_an_index_that_went_to_a_task_finds_the_same(monkeypatch, dense):
    """The matrix is made again there, not sent; blocks that are skipped hold none of the nearest."""
    monkeypatch.setattr(toxicity.Index, "DENSE", dense)
    r = np.random.default_rng(8)
    rows = []
    for i in range(300):
        t = np.sort(r.choice(np.arange(20) + 20 * (i % 4), 6, replace=False))
        w = r.random(6) + 0.01
        rows.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(rows + rows[:10], [i % 2 for i in range(310)], list(range(310)), 16, 80)
    assert "matrix" not in index.__getstate__()
    full = np.zeros((310, 80))
    for i, (t, w) in enumerate(index.rows):
        full[i, t] = w
    for (t, w), (score, near) in zip(rows, pickle.loads(pickle.dumps(index)).nearest(rows, 9), strict=True):
        q = np.zeros(80)
        q[t] = w
        want = full @ q
        assert np.allclose(score, np.sort(want)[::-1][:9]) and np.allclose(want[near], score) and len(set(near.tolist())) == 9


def test_new_strings_are_learned_once_and_the_bound_holds():
    own, asked = Interned(), []

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        asked.extend(words)
        return np.array([ord(c) for w in words for c in w], dtype=np.uint32), np.array([len(w) for w in words], dtype=np.int64)

    words = ["b", "", "ab", "b", "abc", ""] * 3
    for _ in range(2):
        flat, at = own.gather(own.codes(words, learn))
        assert ["".join(map(chr, flat[a:z])) for a, z in zip(at[:-1], at[1:], strict=True)] == words
    assert asked == ["b", "", "ab", "abc"]
    own.codes([f"x{i}" for i in range(10_000)], learn)
    own.bound(100)
    assert list(own.index) == ["b", "", "ab", "abc"]
    flat, at = own.gather(own.codes(["abc", "x7", "ab"], learn))
    assert "".join(map(chr, flat)) == "abcx7ab" and at.tolist() == [0, 3, 5, 7]


def test_a_part_of_words_is_learned_once(monkeypatch):
    """Words that differ in case and marks share their parts; a long text and many short ones give the tokenizer's ids."""
    own, asked = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda parts, odd: asked.extend(parts) or learn(parts, odd))
    texts = [*ODD, "Theme, theme; THEME's (theme)", "thême\u0301 <|endoftext|>x a<b|c '\x00' ''re're", "日本 日本, Theme\x00theme", "theme\n" * 3000]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for column in (texts, pa.array(texts, pa.large_string()), pa.array(texts, pa.large_string()).slice(0)):
        ids, at = own.encode(column)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == want
    assert len(asked) == len(set(asked)) and asked.count("theme") == 1
    assert own.encode([])[1].tolist() == [0]


@pytest.mark.parametrize("bits", [*range(1, 34, 3), 8, 16, 32])
def test_bits_lie_lowest_first(bits):
    bits = min(bits, 32)
    x = np.random.default_rng(bits).integers(0, 1 << bits, (3, pfor.BLOCK), dtype=np.uint64).astype(np.uint32)
    data = pfor._pack(x, bits)
    for row, raw in zip(x.tolist(), data, strict=True):
        assert int.from_bytes(raw.tobytes(), "little") == sum(v << bits * k for k, v in enumerate(row))
    assert (pfor._unpack(data, bits) == x).all()


def test_runs_of_texts_stay_in_arrow(monkeypatch):
    """Runs of some bytes reach the encoder as Arrow, whole texts however long, nulls as empty, an end after each."""
    path, runs = public_tokenizers.path("word_bpe_49k.json"), []
    own = tokens.Encoder(path)
    encode = own.encode
    monkeypatch.setattr(tokens, "encoder", lambda _: own)
    monkeypatch.setattr(own, "encode", lambda x: runs.append(x) or encode(x))
    texts = ["skipped", "a b", None, "", "long words " * 100, "c", None, "thé end"]
    got = {}
    for first, ids, at in tokens.encoded(pa.array(texts).slice(1), path, 2, size=20):
        got |= {first + k: ids[a:z].tolist() for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True))}
    assert [got[k] for k in range(7)] == [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[1:]]
    assert len(runs) > 2 and all(isinstance(x, pa.Array) for x in runs)
