"""Whole texts to ids by a tokenizers file, with a cache of parts of words.

Texts are split at white space, which the tokenizer drops and no token spans, so a word's ids don't
depend on its neighbours. Arrow splits a run of texts and finds its different words. Those of printable ASCII and Latin-1 letters
are lowered and taken apart as the tokenizer's pattern does, all at once, and their new parts given to the tokenizer's model;
any other new word goes through the whole tokenizer. The cache is bounded: when it is full, parts seen only once or twice go. A file whose normalizer or
pattern is another one (see _KNOWN) has no such words, so its texts go to the tokenizer whole.

encoded() takes null texts as empty, gives each row its ids whether or not rows repeat, splits no text however long, and
gives nothing for an empty column.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlark.llm.common import tidy, worker_cache
from ledgerlark.llm.interned import Interned, ranges, split

#: Parts of words, and words of other letters, kept by one Python worker, about 80 MB.
CACHE_WORDS = 360_000

#: Words that NFC leaves as they are and whose letters lower to one letter each, a line each; what other words have, for Arrow.
_PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_ODD = "[^!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<[|]"
#: Parts of the others in lower case that the tokenizer's pattern takes apart, and what ends a word.
_PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|\n|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+")
#: Stands for one of the odd words among the others.
_PLACE = "\0"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()
_LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

#: The pipeline that words are taken apart like, as the tokenizers library writes it.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: The name of the worker cache.
CACHE = "tokens"
#: Runs of texts after which freed memory goes back.
_TIDY = 4

_encoders: dict[str, Encoder] = {}
worker_cache(CACHE, _encoders.clear)


def known(raw: str) -> bool:
    """Whether a tokenizer (as JSON) has the known pipeline, and added tokens that are written with '<|'."""
    own = json.loads(raw)
    return all(own.get(k) == v for k, v in _KNOWN.items()) and own["model"].get("type") == "BPE" and all(t["content"].startswith("<|") for t in own.get("added_tokens") or ())


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = known(self.tokenizer.to_str())
        self.parts = Interned()
        self.turn = 0

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their n + 1 offsets."""
        if not self.by_words:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else list(texts)
            coded = [c.ids for c in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(coded), dtype=np.uint32), np.append(0, np.cumsum([len(c) for c in coded], dtype=np.int64))
        names, words, at = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        ids, ends = self._words(names)
        first, last = ends[words], ends[words + 1]
        return ids[ranges(first, last)], np.append(0, np.cumsum(last - first))[at]

    def _words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words end to end, and their n + 1 offsets."""
        self.parts.bound(CACHE_WORDS)
        lines, odd = _lines(names), []
        if "<|" in lines or not _PLAIN.fullmatch(lines):
            found = pc.match_substring_regex(names, _ODD)
            odd = names.filter(found).to_pylist()
            lines = _lines(pc.if_else(found, _PLACE, names))
        parts = _PART.findall(lines.lower())
        if odd:
            rest = iter(odd)
            parts = [next(rest) if p == _PLACE else p for p in parts]
        codes = self.parts.codes(parts, lambda new: self._learn(new, set(odd)))
        ids, at = self.parts.gather(codes)
        ended = codes == self.parts.index["\n"] if len(codes) else np.zeros(0, dtype=bool)
        return ids, at[np.append(0, np.flatnonzero(ended) + 1)]

    def _whole(self, words: list[str]) -> list[tuple[int, ...]]:
        if not words:
            return []
        coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        at = np.searchsorted(np.array(coded.word_ids, dtype=np.int64), np.arange(len(words) + 1)).tolist()
        return [tuple(coded.ids[a:b]) for a, b in itertools.pairwise(at)]

    def _learn(self, parts: list[str], odd: set[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [p for p in parts if p in odd] if odd else []
        known = {"\n": (), **dict(zip(whole, self._whole(whole), strict=True))}
        tokenize, flat, size = self.model.tokenize, [], []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                ids = [t.id for t in tokenize(p if p.isascii() else p.translate(_LETTERS))]
            flat += ids
            size.append(len(ids))
        return np.array(flat, dtype=np.uint32), np.array(size, dtype=np.int64)


def _lines(words: pa.Array) -> str:
    """The words, each with a line end after it."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py() + "\n" * (len(words) > 0)


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end: int, size: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole texts of about size bytes: the first row, all ids with end after each text, offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64)) if len(column) else np.zeros(0, dtype=np.int64)
    own, first = encoder(path), 0
    while first < len(column):
        own.turn += 1
        if own.turn % _TIDY == 0:
            tidy(CACHE)
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + size, side="right")))
        ids, at = own.encode(column.slice(first, last - first))
        ids = np.insert(ids, at[1:], np.uint32(end))
        yield first, ids, at + np.arange(len(at))
        first = last
