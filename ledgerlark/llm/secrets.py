"""Secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned for the three kinds and then decoded:
percent escapes and Unicode escapes in place, so what stands around them stays, and every base64 run, joined over
line breaks, to layers of its own at each of the four alignments, inflated from wherever a compressed stream starts. Bytes that
are no text stand in a layer as U+FFFD, and a layer with zero bytes is also taken without them (UTF-16). New layers join the worklist until none is left.
A layer equal to one of the layers it came from, or to one already decoded from the same place, is not
taken again, so cycles end. Every character of a layer knows the span of the text it came from, and a
match in a layer counts for that span.

Null texts are empty. Repeated rows each get their row. Very long texts are scanned whole. Extra
columns are ignored by scan() and kept by redact(), whatever their names. Empty tables give empty
tables. What is compressed is inflated piece by piece, member by member, and scanned whole in windows that overlap
by OVERLAP bytes; what begins in a window and goes on behind it is followed as a stream. All it holds counts for the span of the compressed bytes.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import map_arrow

KINDS = ("assign", "access", "hex")

#: The patterns of the three kinds and the least length of a match (of group 2 for assign).
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+")
#: The shortest secret is 16 characters, which are 22 of base64.
_LEAST, _LEAST_BASE64 = 16, 22
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % _LEAST)
_PACKED = re.compile(rb"(?=\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00)")
#: A base64 run in bytes, maybe behind a line break of a run before it.
_RUN = re.compile(rb"(?:[ \t]*\r?\n[ \t]*)?[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
_IN_RUN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_- \t\r\n"))
_DIGITS = bytes.maketrans(b"-_", b"+/")
#: An escape that doesn't go on with the character of the one before it.
_NEW_ESCAPE = re.compile(r"%(?![89ABab])|\\(?!u[dD][c-fC-F]|x[89abAB])")
_NO_BASE64 = re.compile(r"[ \t\r\n]+")
_LONE = re.compile("[\ud800-\udfff]")

Span = tuple[int, int, int]


#: Bytes of an inflated piece, of a window of what is inflated, and of what two windows have in common.
PIECE, WINDOW, OVERLAP = 1 << 20, 1 << 22, 1 << 20


def matches(text: str) -> list[Span]:
    """(start, place in KINDS, end) of what the patterns find in a text, sorted."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, for each of its characters, where in the document it starts and ends."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, above: frozenset[str | bytes], depth: int) -> None:
        self.text, self.start, self.end, self.above, self.depth = text, start, end, above | {text}, depth


def _escaped(run: str) -> list[tuple[str, int]]:
    """Decoded characters of a run of escapes of one form and how many characters of the run each takes."""
    if run[0] == "%" or run[1] == "x":
        width = 3 if run[0] == "%" else 4
        raw = bytes(int(run[k + width - 2 : k + width], 16) for k in range(0, len(run), width))
        out, at = [], 0
        for c in raw.decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":  # no UTF-8: stays as it is
                out += [(x, 1) for x in run[width * at : width * (at + 1)]]
                at += 1
            else:
                n = len(c.encode())
                out.append((c, width * n))
                at += n
        return out
    if run[1] == "U" or run[2] == "{":
        code = int(run.strip("\\uU{}"), 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return [(x, 1) for x in run]
        return [(chr(code), len(run))]
    units = [int(run[k + 2 : k + 6], 16) for k in range(0, len(run), 6)]
    out, k = [], 0
    while k < len(units):
        if 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000:
            out.append((chr(0x10000 + (units[k] - 0xD800) * 0x400 + units[k + 1] - 0xDC00), 12))
            k += 2
        elif 0xD800 <= units[k] < 0xE000:
            out += [(x, 1) for x in run[6 * k : 6 * k + 6]]
            k += 1
        else:
            out.append((chr(units[k]), 6))
            k += 1
    return out


def _unescaped(layer: Layer) -> Layer | None:
    if "%" not in layer.text and "\\" not in layer.text:
        return None
    parts, took, last = [], [], 0
    for m in _ESCAPES.finditer(layer.text):
        parts.append(layer.text[last : m.start()])
        took.append(np.ones(m.start() - last, dtype=np.int64))
        pairs = _escaped(m[0])
        parts.append("".join(c for c, _ in pairs))
        took.append(np.array([n for _, n in pairs], dtype=np.int64))
        last = m.end()
    if not last:
        return None
    parts.append(layer.text[last:])
    took.append(np.ones(len(layer.text) - last, dtype=np.int64))
    end = np.cumsum(np.concatenate(took))
    return Layer("".join(parts), layer.start[end - np.concatenate(took)], layer.end[end - 1], layer.above, layer.depth + 1)


def _decoder(head: bytes):  # noqa: ANN202
    """A decompressor for what begins like this, or None."""
    if head[:3] == b"\x1f\x8b\x08" or len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def _pieces(raw: bytes, at: int) -> Iterator[bytes]:
    """raw from a place on, a small piece first: most places that look like a compressed stream are none."""
    size = 512
    while at < len(raw):
        yield raw[at : at + size]
        at, size = at + size, 1 << 16


class Members:
    """What the compressed members at the start of some pieces of bytes hold, piece by piece.

    used: bytes they take; cut: whether the last one would have gone on.
    """

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.pulled, self.used, self.cut = pieces, 0, 0, False

    def _pull(self) -> bytes | None:
        piece = next(self.pieces, None)
        self.pulled += len(piece or b"")
        return piece

    def __iter__(self) -> Iterator[bytes]:
        data = self._pull() or b""
        while (stream := _decoder(data[:8])) is not None:
            while not stream.eof:
                try:
                    out = stream.decompress(data, PIECE)
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    self.used = self.used or self.pulled
                    return
                data = stream.unconsumed_tail if hasattr(stream, "unconsumed_tail") else b""
                if out:
                    yield out
                elif not stream.eof and not data:
                    if (piece := self._pull()) is None:
                        self.used, self.cut = self.pulled, True
                        return
                    data = piece
            data = stream.unused_data
            self.used = self.pulled - len(data)
            while len(data) < 8 and (piece := self._pull()) is not None:
                data += piece


def windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a stream in windows, each with the last OVERLAP bytes of the one before."""
    held, new = b"", False
    for piece in pieces:
        held, new = held + piece, True
        while len(held) >= WINDOW:
            yield held[:WINDOW]
            held, new = held[WINDOW - OVERLAP :], len(held) > WINDOW
    if new and held:
        yield held


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs of a text, joined over line breaks, and where each of their characters stands."""
    for m in _BASE64.finditer(text):
        if m.end() - m.start() < _LEAST_BASE64:
            continue
        run, at = m[0], np.arange(m.start(), m.end())
        if "\n" in run:
            at = at[np.isin(np.frombuffer(run.encode(), dtype=np.uint8), list(b" \t\r\n"), invert=True)]
            run = _NO_BASE64.sub("", run)
        if len(run) >= _LEAST_BASE64:
            yield run.replace("-", "+").replace("_", "/"), at


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The text of some bytes, with and without zero bytes, and the size of each of its characters and what precedes it there."""
    if not _PRINTABLE.search(raw if b"\0" not in raw else raw.replace(b"\0", b"")):
        return
    text = raw.decode("utf-8", "surrogateescape")
    size = np.ones(len(text), dtype=np.int64) if len(text) == len(raw) else np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text], dtype=np.int64)
    text, end = _LONE.sub("\ufffd", text), np.cumsum(size)
    yield text, np.stack([end - size, end])
    if "\0" in text:
        held = np.array([c != "\0" for c in text], dtype=bool)
        yield text.replace("\0", ""), np.stack([end - size, end])[:, held]


def _behind(make: Callable[[], Iterator[bytes]], at: int) -> Iterator[bytes]:
    """A stream from a place on."""
    for piece in make():
        if at < len(piece):
            yield piece[at:] if at else piece
        at = max(0, at - len(piece))


def _open_run(window: bytes) -> int | None:
    """Where the base64 run begins that stands at the end of a window."""
    tail = window.rstrip(b" \t\r\n")
    last = np.flatnonzero(~_IN_RUN[np.frombuffer(tail, dtype=np.uint8)])
    start = int(last[-1]) + 1 if len(last) else 0
    at = None
    for m in _RUN.finditer(window, start):
        at = m.start() + len(m[0]) - len(m[0].lstrip(b" \t\r\n")) if m.end() == len(tail) else None
    return at


def _base64_stream(pieces: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """What the base64 run at the start of a stream holds, `skip` of its digits left out."""
    held = digits = b""
    for piece in pieces:
        held += piece
        m = _RUN.match(held)
        run, held = (m[0], held[m.end() :]) if m else (b"", held)
        digits += run.translate(_DIGITS, b" \t\r\n")
        skip, digits = max(0, skip - len(digits)), digits[skip:]
        whole = len(digits) // 4 * 4
        if whole:
            yield base64.b64decode(digits[:whole])
        digits = digits[whole:]
        if held.strip(b" \t\r\n"):
            break
    if len(digits) > 1:
        yield base64.b64decode(digits + b"=" * (-len(digits) % 4))


def _unescaped_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """A stream with its escapes decoded; a piece ends before an escape that the next piece may go on with."""
    reader, held = codecs.getincrementaldecoder("utf-8")("surrogateescape"), ""
    for piece in pieces:
        held += reader.decode(piece)
        cut = [m.start() for m in _NEW_ESCAPE.finditer(held, max(0, len(held) - 64))]
        end = cut[-1] if cut and cut[-1] else len(held)
        ready, held = held[:end], held[end:]
        yield _ESCAPES.sub(lambda m: "".join(c for c, _ in _escaped(m[0])), ready).encode("utf-8", "surrogateescape")
    held += reader.decode(b"", True)
    yield _ESCAPES.sub(lambda m: "".join(c for c, _ in _escaped(m[0])), held).encode("utf-8", "surrogateescape")


def _kinds_of(make: Callable[[], Iterator[bytes]], above: frozenset, depth: int, packed: bool = True) -> tuple[set[int], int]:
    """The kinds found in a stream of bytes and in all layers inside it, and the deepest of these layers. packed: whether it may hold compressed members.

    A window is a layer like another. What begins in it and goes on behind its end, a compressed member or a
    base64 run, is followed as a stream of its own over the windows behind; it is followed where it isn't whole in the next
    window. A stream of several windows that has escapes or zero bytes is also taken without them, as a whole.
    """
    kinds: set[int] = set()
    seen: set[bytes] = set()
    deepest, first, step, n, escapes, zeros = 0, None, WINDOW - OVERLAP, 0, False, False

    def follow(stream: Callable[[], Iterator[bytes]], over: frozenset, packed: bool = True) -> None:
        nonlocal kinds, deepest
        if len(kinds) < len(KINDS):
            more, deep = _kinds_of(stream, over, depth + 1, packed)
            kinds, deepest = kinds | more, max(deepest, deep)

    for window in windows(make()):
        at, n = n * step, n + 1
        key = hashlib.blake2b(window).digest()
        first = first or (key, window[:8])
        if key in above or len(kinds) == len(KINDS):
            continue
        inside = above | {key}
        for text, _ in _texts(window) if key not in seen else ():
            if text not in above:
                flat = np.broadcast_to(np.int64(0), (len(text),))
                found, deep = _closure(Layer(text, flat, flat, inside, depth))
                kinds |= {k for _, k, _ in found}
                deepest = max(deepest, deep)
        seen.add(key)
        goes_on = len(window) == WINDOW
        for k in (m.start() for m in _PACKED.finditer(window if packed else b"")):
            if k or n > 1:
                made: list[Members] = []

                def inner(k: int = k, w: bytes = window, made: list[Members] = made) -> Iterator[bytes]:
                    made.append(Members(_pieces(w, k)))
                    return iter(made[-1])

                follow(inner, inside)
                if goes_on and k <= step and made and made[0].cut:
                    follow(lambda k=at + k: iter(Members(_behind(make, k))), inside)
        run = _open_run(window) if goes_on else None
        if run is not None and run <= step and (run or n == 1):
            for skip in range(4):
                follow(lambda run=at + run, skip=skip: _base64_stream(_behind(make, run), skip), inside)
        escapes = escapes or b"%" in window or b"\\" in window
        zeros = zeros or b"\0" in window
    if first and packed and first[0] not in above and _decoder(first[1]) is not None:
        follow(lambda: iter(Members(make())), above | {first[0]})
    if n > 1 and escapes:
        plain = hashlib.blake2b()
        for piece in make():
            plain.update(piece)
        other = hashlib.blake2b()
        for piece in _unescaped_stream(make()):
            other.update(piece)
        if other.digest() != plain.digest():
            follow(lambda: _unescaped_stream(make()), above | seen, packed=False)
    if n > 1 and zeros:
        follow(lambda: (piece.replace(b"\0", b"") for piece in make()), above | seen, packed=False)
    return kinds, deepest


def _decoded(layer: Layer) -> Iterator[tuple[Layer | None, set[Span], int]]:
    """Layers of the base64 runs of a layer; spans of what is compressed in them, with the deepest layer of it."""
    for whole, at in _runs(layer.text):
        for skip in range(4):
            run, place = whole[skip:], at[skip:]
            run = run[:-1] if len(run) % 4 == 1 else run
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
            for text, bytes_at in _texts(raw):
                a, b = place[bytes_at[0] * 8 // 6], place[(bytes_at[1] * 8 - 1) // 6]
                yield Layer(text, layer.start[a], layer.end[b], layer.above, layer.depth + 1), set(), 0
            for k in [m.start() for m in _PACKED.finditer(raw)]:
                made: list[Members] = []

                def make(k: int = k, raw: bytes = raw, made: list[Members] = made) -> Iterator[bytes]:
                    made.append(Members(_pieces(raw, k)))
                    return iter(made[-1])

                kinds, deepest = _kinds_of(make, layer.above, layer.depth + 1)
                if kinds:
                    end = k + made[0].used
                    last = at[-1] if end == len(raw) else place[(end * 8 - 1) // 6]
                    span = int(layer.start[place[k * 8 // 6]]), int(layer.end[last])
                    yield None, {(span[0], kind, span[1]) for kind in kinds}, deepest


def _closure(root: Layer) -> tuple[set[Span], int]:
    """Spans of all layers of a worklist from a root, the text itself left out, and the deepest layer with a span of its own."""
    work, found, done, deepest = [root], set(), set(), 0
    while work:
        layer = work.pop()
        if layer.depth:
            own = {(int(layer.start[s]), kind, int(layer.end[e - 1])) for s, kind, e in matches(layer.text)}
            deepest = max(deepest, layer.depth) if own - found else deepest
            found |= own
        inner = _unescaped(layer)
        for child, spans, depth in itertools.chain([(inner, set(), 0)] if inner else [], _decoded(layer)):
            deepest = max(deepest, depth) if spans - found else deepest
            found |= spans
            if child is not None and child.text not in layer.above:
                key = child.text, int(child.start[0]), int(child.end[-1])
                if key not in done:
                    done.add(key)
                    work.append(child)
    return found, deepest


def scan_text(text: str | None) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the deepest layer with a span of its own."""
    text = text or ""
    base = matches(text)
    if not ("%" in text or "\\" in text) and next(_runs(text), None) is None:
        return base, base, 0
    at = np.arange(len(text), dtype=np.int64)
    found, deepest = _closure(Layer(text, at, at + 1, frozenset(), 0))
    return base, sorted(found | set(base)), deepest if found - set(base) else 0


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, depth of each row."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "depth"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                base, spans, depth = scan_text(text.as_py())
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), depth))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, depth long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def redacted(text: str | None) -> str | None:
    """The text with every run of overlapping spans replaced by [kind] of the first."""
    if text is None:
        return None
    _, spans, _ = scan_text(text)
    out, last, at = [], 0, 0
    while at < len(spans):
        start, kind, end = spans[at]
        while at < len(spans) and spans[at][0] < end:
            end, at = max(end, spans[at][2]), at + 1
        out += [text[last:start], f"[{KINDS[kind]}]"]
        last = end
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets taken out of text and, where there is one, n_chars of the new text."""
    where = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(x.as_py()) for x in b.column(where)]
            columns = list(b.columns)
            columns[where] = pa.array(texts, b.schema.field(where).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_arrow(docs, run, docs.schema)
