"""Likeness of strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.strings import host


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-case words, two spaces before each word and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def overlap(x: Column, y: Column) -> Column:
    """Jaccard similarity of two lists without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def matching_share(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio() of texts that aren't empty; it leaves out frequent characters from 200 on, so those go to it."""
    if a == b:
        return 1.0
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    same, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        a_from, a_to, b_from, b_to = parts.pop()
        size, at, i = 0, 0, a_from
        while i + size < a_to:  # the longest run, the first in a, and there the first in b
            if b.find(a[i : i + size + 1], b_from, b_to) >= 0:
                size, at = size + 1, i
            else:
                i += 1
        if size:
            j = b.find(a[at : at + size], b_from, b_to)
            same += size
            parts += [(a_from, at, b_from, j), (at + size, a_to, j + size, b_to)]
    return 2.0 * same / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a.fillna(""), b.fillna(""), strict=True)
    return pd.Series([matching_share(x, y) if x and y else 0.0 for x, y in pairs], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Share of matching runs (Ratcliff and Obershelp); Spark has no such function, so an Arrow UDF."""
    return _ratio(a, b)


def posting_similarity(company_a: Column, title_a: Column, url_a: Column, company_b: Column, title_b: Column, url_b: Column) -> Column:
    """Edit similarity of company, title and host; at most 0.5 where the hosts differ."""

    def line(company: Column, title: Column, url: Column) -> Column:
        words = (F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", " ")) for c in (company, title))
        return F.trim(F.concat_ws(" ", *words, F.coalesce(host(url), F.lit(""))))

    raw = levenshtein_similarity(line(company_a, title_a, url_a), line(company_b, title_b, url_b))
    return F.when(host(url_a) != host(url_b), F.least(raw, F.lit(0.5))).otherwise(raw)
