"""Records from HTML, JSON-LD, feeds and sitemaps, as expressions where those suffice, else by Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LD = r'(?is)<script[^>]*type\s*=\s*["\x27]?application/ld\+json["\x27]?[^>]*>(.*?)</script>'


def json_ld(html: Column) -> Column:
    """JSON-LD blocks of a page that parse, as an array of strings."""
    found = F.transform(F.regexp_extract_all(html, F.lit(_LD), F.lit(1)), F.trim)
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def json_ld_of_type(html: Column, kind: str) -> Column:
    return F.filter(json_ld(html), lambda x: F.lower(F.get_json_object(x, "$.@type")) == kind.lower())


def find_key_list(data: object, keys: tuple[str, ...]) -> list | None:
    """The first list of objects under one of the keys, depth first."""
    if isinstance(data, dict):
        for k in keys:
            v = data.get(k)
            if isinstance(v, list) and any(isinstance(x, dict) for x in v):
                return v
        data = list(data.values())
    if isinstance(data, list):
        for v in data:
            if isinstance(v, (dict, list)) and (got := find_key_list(v, keys)) is not None:
                return got
    return None


def nested_list(payload: Column, *keys: str) -> Column:
    """find_key_list() of a JSON string as a JSON string; NULL without one."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                got = find_key_list(json.loads(x), keys) if x else None
            except ValueError:
                return None
            return None if got is None else json.dumps(got, sort_keys=True)

        return s.map(one)

    return run(payload)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._end()
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end(self) -> None:
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def table_rows(html: str) -> list[dict[str, str]]:
    """Rows of all tables by the keys of their first row."""
    p = _Tables()
    p.feed(html)
    p.close()
    out = []
    for t in p.tables:
        rows = [r for r in t if any(r)]
        if len(rows) > 1:
            keys = [re.sub(r"[^a-z0-9]+", "_", h.lower()).strip("_") for h in rows[0]]
            out += [{k: v for k, v in zip(keys, r, strict=False) if k} for r in rows[1:]]
    return out


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, row number and cells (a map by header) of every table row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, r) for k, page in zip(b[key], b[html], strict=True) for n, r in enumerate(table_rows(page or ""))]
            yield pd.DataFrame(rows, columns=[key, "row", "cells"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"{key} {kind}, row long, cells map<string,string>")


def links(html: Column) -> Column:
    """(href, text) of a page's links."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href\s*=\s*["\x27]([^"\x27]+)["\x27][^>]*>(.*?)</a>'), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, r'(?is)href\s*=\s*["\x27]([^"\x27]+)', 1).alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")).alias("text"),
        ),
    )


def role_links(html: Column, words: str = "placement|training|contact|about|team|leadership|administration") -> Column:
    """Links whose address or text speaks of people or contact."""
    return F.filter(links(html), lambda x: F.lower(F.concat_ws(" ", x["href"], x["text"])).rlike(words))


def sitemap_urls(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))


def feed_items(xml: Column) -> Column:
    """(title, link, date) of RSS items and Atom entries."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))

    def part(x: Column, pattern: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, pattern, 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", ""))

    return F.transform(
        items,
        lambda x: F.struct(
            part(x, r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
            F.coalesce(F.nullif(part(x, r"(?is)<link[^>]*>(.*?)</link>"), F.lit("")), F.regexp_extract(x, r'(?is)<link[^>]*href="([^"]+)"', 1)).alias("link"),
            F.coalesce(F.nullif(part(x, r"(?is)<pubDate[^>]*>(.*?)</pubDate>"), F.lit("")), part(x, r"(?is)<(?:updated|published)[^>]*>(.*?)<")).alias("date"),
        ),
    )


def contacts(text: Column) -> dict[str, Column]:
    """E-mail addresses, phone numbers and profile links that stand in a text."""
    return {
        "emails": F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0)), F.lower)),
        "phones": F.array_distinct(F.regexp_extract_all(text, F.lit(r"\+?[0-9][0-9 ()-]{7,}[0-9]"), F.lit(0))),
        "profiles": F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://(?:[a-z]+\.)?linkedin\.com/in/[A-Za-z0-9_-]+"), F.lit(0))),
    }


def name_from_url(url: Column) -> Column:
    """A title from the last part of a URL's path."""
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+)$", 1)
    words = F.filter(F.split(F.lower(tail), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin("index", "html", "htm", "php", "home", "www"))
    return F.nullif(F.initcap(F.array_join(words, " ")), F.lit(""))


def ats_slug(url: Column) -> Column:
    """The account in the address of a hosted job board."""
    out = F.lit(None).cast("string")
    for pattern in (r"boards\.greenhouse\.io/([A-Za-z0-9_-]+)", r"jobs\.lever\.co/([A-Za-z0-9_-]+)", r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)", r"([A-Za-z0-9-]+)\.recruitee\.com", r"apply\.workable\.com/([A-Za-z0-9_-]+)"):
        out = F.coalesce(out, F.nullif(F.lower(F.regexp_extract(url, pattern, 1)), F.lit("")))
    return out


def spreadsheet_rows(xml: Column) -> Column:
    """Rows of a SpreadsheetML sheet as arrays of cells; ss:Index leaves empty cells before it."""
    rows = F.regexp_extract_all(xml, F.lit(r"(?is)<Row[^>]*>(.*?)</Row>"), F.lit(1))

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<Cell[^>]*?(?:/>|>.*?</Cell>)"), F.lit(0))

        def put(done: Column, cell: Column) -> Column:
            at = F.regexp_extract(cell, r'(?i)ss:Index="(\d+)"', 1).try_cast("int")
            gap = F.greatest(F.coalesce(at - 1, F.lit(0)) - F.size(done), F.lit(0))
            text = F.trim(F.regexp_replace(F.regexp_extract(cell, r"(?is)<Data[^>]*>(.*?)</Data>", 1), r"[\r\n]+", " "))
            for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                text = F.replace(text, F.lit(name), F.lit(char))
            return F.concat(done, F.array_repeat(F.lit(""), gap), F.array(text))

        return F.aggregate(found, F.array().cast("array<string>"), put)

    return F.filter(F.transform(rows, cells), lambda r: F.exists(r, lambda c: c != ""))
