"""Listing pages: events that a page declares as JSON-LD, then links of the page's own site that look like entries.

Python reads the structure of a page, a batch of pages at a time; what the values mean (names, dates, money) is column
expressions. A NULL or empty page has no entries; a URL is told once a page; the page's own order is kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import dates, money
from ledgerlark.functions import strings as S

_LD = re.compile(r"<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
_ANCHOR = re.compile(r"<a\b[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.IGNORECASE | re.DOTALL)
#: Types of an event, and link texts that name nothing.
EVENT_TYPES = ("event", "hackathonevent", "businessevent", "educationevent")
NO_TITLES = ("view", "details", "detail", "register", "apply", "more", "read", "click", "here", "event", "page")
FIELDS = ("name", "url", "organizer", "organizer_url", "description", "mode", "venue", "city", "state", "country", "starts", "ends", "deadline", "price")


def declared_events(html: str) -> Iterator[dict]:
    """Events of the page's JSON-LD blocks, those of lists by their items; blocks that don't parse are none."""
    for block in _LD.findall(html):
        try:
            data = json.loads(block.strip())
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if not isinstance(item, dict):
                continue
            listed = item.get("itemListElement")
            if isinstance(listed, list) and listed:
                nodes = [e["item"] if isinstance(e, dict) and isinstance(e.get("item"), dict) else e for e in listed]
                yield from (n for n in nodes if isinstance(n, dict) and str(n.get("@type", "")).lower().endswith("event"))
            elif str(item.get("@type", "")).lower() in EVENT_TYPES:
                yield item


def _text(v: object) -> str | None:
    return None if v is None or isinstance(v, (dict, list)) else str(v)


def event_fields(event: dict) -> dict[str, str | None]:
    """What an event says, as it is written."""

    def part(of: dict, name: str) -> dict:
        v = of.get(name)
        v = v[0] if isinstance(v, list) and v else v
        return v if isinstance(v, dict) else {}

    where, who = part(event, "location"), part(event, "organizer")
    address = part(where, "address")
    said = str(event.get("eventAttendanceMode") or "").lower()
    values = {
        "name": event.get("name") or event.get("headline"), "url": event.get("url"), "organizer": who.get("name"), "organizer_url": who.get("url"), "description": event.get("description"),
        "mode": "online" if "online" in said else "offline" if where else None, "venue": where.get("name") or address.get("streetAddress"), "city": address.get("addressLocality"),
        "state": address.get("addressRegion"), "country": address.get("addressCountry"), "starts": event.get("startDate"), "ends": event.get("endDate"), "deadline": event.get("validThrough"), "price": part(event, "offers").get("price"),
    }
    return {k: _text(v) for k, v in values.items()}


def entry_links(html: str, url: str, path: str) -> Iterator[tuple[str, str]]:
    """(absolute address, markup of the text) of links within the page's own site whose path has the pattern, each address once."""

    def site(of: str) -> str:
        return of.lower().replace("www.", "", 1)

    own, seen, fits = site(urlparse(url).netloc), set(), re.compile(path)
    for m in _ANCHOR.finditer(html):
        if m[1].startswith(("mailto:", "tel:", "javascript:", "#")):
            continue
        try:
            to = urljoin(url, m[1]).split("#", 1)[0]
            at = urlparse(to)
        except ValueError:
            continue
        if at.scheme in ("http", "https") and site(at.netloc) == own and fits.search(at.path) and to not in seen:
            seen.add(to)
            yield to, m[2]


def title_from_url(url: Column) -> Column:
    """A title from the last part of a URL's path, if it has two words that are no numbers; years stay."""
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+)$", 1)
    words = F.filter(F.split(F.regexp_replace(tail, r"(?i)\.(html?|php|aspx)$", ""), "[-_]+|%20"), lambda w: (w != "") & (~w.rlike(r"^\d+$") | w.rlike(r"^(19|20)\d\d$")))
    shown = F.transform(words, lambda w: F.when((F.length(w) <= 5) & w.rlike(r"\p{L}") & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    return F.when(F.size(F.filter(words, lambda w: ~w.rlike(r"^\d+$"))) >= 2, F.array_join(shown, " "))


def listed(pages: DataFrame, key: str, url: str, html: str, path: str) -> DataFrame:
    """key, place, method (json_ld or link_discovery) and FIELDS as written, of every entry of a page."""
    names = [key, "place", "method", *FIELDS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, address, page in zip(f[key], f[url], f[html], strict=True):
                page, address = page or "", address or ""
                found = [("json_ld", event_fields(e)) for e in declared_events(page)]
                found = [(m, e | {"url": e["url"] or address}) for m, e in found if e["name"]]
                found += [("link_discovery", {"url": to, "name": text}) for to, text in entry_links(page, address, path)]
                rows += [(k, n, m, *(e.get(c) for c in FIELDS)) for n, (m, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInPandas(run, f"{key} {kind}, place long, method string, " + ", ".join(f"{c} string" for c in FIELDS))


def listing_records(pages: DataFrame, key: str, url: str, html: str, path: str) -> DataFrame:
    """Entries as records: a link's name is its text if that has two words, else a title from its address, else NULL."""
    raw = listed(pages, key, url, html, path)
    link = F.col("method") == "link_discovery"
    text = S.clean_text(F.regexp_replace("name", r"(?s)<[^>]*>", " "), 200)
    usable = F.when(F.size(F.split(text, " ")) >= 2, F.when(~F.lower(text).isin(*NO_TITLES), text))
    start = dates.parse_datetime(F.col("starts"))
    return raw.select(
        key, "place", "method", F.when(link, F.coalesce(usable, title_from_url(F.col("url")))).otherwise(S.clean_text(F.col("name"))).alias("name"), S.clean_text(F.col("url")).alias("url"),
        *(S.clean_text(F.col(c)).alias(c) for c in ("organizer", "organizer_url")), S.strip_html(F.col("description"), 800).alias("description"), *(S.clean_text(F.col(c)).alias(c) for c in ("mode", "venue", "city", "state", "country")),
        start.alias("event_start"), dates.parse_datetime(F.col("ends")).alias("event_end"), dates.parse_datetime(F.col("deadline")).alias("registration_deadline"), money.parse_money(F.col("price")).alias("prize_pool"),
        F.when(link, "DISCOVERED").otherwise("ANNOUNCED").alias("status"), F.year(start).alias("year"),
    )
