"""HTML to leaf blocks: runs of text between block-level tags, with the path of tags above each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Tags that stand inside a line, tags whose insides all stand in the line, tags without an end, tags
#: that hold no text but code or another page, tags that may stand in a head.
INLINE = frozenset("a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font i img ins kbd label mark math meter object output picture progress q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr".split())
IN_LINE_WHOLE = ("math", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "iframe", "noframes", "noembed")
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A start tag of the value's set ends an open element of the key.
_ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
_ENDED_BY = {tag: tuple(k for k, v in _ENDS.items() if tag in v) for tag in frozenset().union(*_ENDS.values())}
#: Elements an implied end doesn't reach through.
_SCOPE = frozenset("article aside body div dl footer form header main nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+|/)(?:"[^"]*"|'[^']*'|[^'">])*|)(?:>|\Z)"""
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_a-zA-Z]+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in (*RAW, "title")}
#: A path has all elements up to this depth together; of deeper ones these many outermost and innermost.
OUTERMOST, INNERMOST = 24, 40


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]
    block_below: int


_names: dict[tuple[str, str], tuple[str, ...]] = {}


def _named(tag: str, attributes: str) -> tuple[str, ...]:
    """Path tokens of an element: its tag, the parts of its class, id and role, and a token where an attribute hides it."""
    key = tag, attributes
    if (got := _names.get(key)) is None:
        out, hidden = [tag], False
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
            if name == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            elif name == "hidden" or name == "aria-hidden":
                hidden |= name == "hidden" or value.lower() == "true"
            else:
                out += ["." + x.lower() for x in _NAME.findall(html.unescape(value))[:12]]
        got = tuple(dict.fromkeys(out + ["!hidden"] * hidden))
        if len(_names) > 20_000:
            _names.clear()
        _names[key] = got
    return got


@dataclass
class _Leaf:
    parts: list[str] = field(default_factory=list)
    path: tuple[str, ...] = ()
    linked: int = 0


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with white space as single spaces and references decoded.

    Comments, the head, the title and RAW elements have no blocks; everything else has, also what a form, a button
    or noscript holds or an attribute hides: whether that is main text is for the labeller. Unclosed elements end where HTML
    ends them or at the end; stray end tags count for nothing. The time grows with the length of the page, at any depth.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}  # places on the stack by tag
    scopes: list[int] = []
    leaf = _Leaf()
    at = 0

    def flush() -> None:
        nonlocal leaf
        if leaf.parts:
            text = " ".join(html.unescape("".join(leaf.parts)).split())
            if text:
                out.append(Block(text, leaf.path, leaf.linked))
            leaf = _Leaf()

    def say(piece: str) -> None:
        if not piece or where.get("head"):
            return
        if not leaf.path and not piece.isspace():
            above = stack if len(stack) <= OUTERMOST + INNERMOST else stack[:OUTERMOST] + stack[-INNERMOST:]
            leaf.path = tuple(n for e in above for n in e.names)
        leaf.parts.append(piece)
        if where.get("a"):
            leaf.linked += len(piece)

    def pop(to: int) -> None:
        while len(stack) > to:
            where[stack.pop().tag].pop()
        while scopes and scopes[-1] >= to:
            scopes.pop()

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[0][1] in "!?":
            continue
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        inside = tag in INLINE or any(where.get(t) for t in IN_LINE_WHOLE)
        if not inside:
            flush()
        if end:
            if (places := where.get(tag)) and (tag not in INLINE or places[-1] > stack[-1].block_below):
                pop(places[-1])
            continue
        if tag in RAW or tag == "title" and not where.get("svg"):
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if (heads := where.get("head")) and tag not in IN_HEAD and tag != "head":
            pop(heads[-1])
        if not inside:
            ended = max((where[t][-1] for t in _ENDED_BY.get(tag, ()) if where.get(t)), default=-1)
            if ended > (scopes[-1] if scopes else -1):
                pop(ended)
        if tag in VOID or tag == "a" and where.get("a"):
            continue
        below = len(stack) if tag not in INLINE else stack[-1].block_below if stack else -1
        where.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(_Open(tag, _named(tag, attributes), below))
    say(page[at:])
    flush()
    return out
