"""Delimited text in and out: sniffed separators, mapped headers, spreadsheets' quirks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.strings import formula_guard

#: Headers that mean a field of a lead.
ALIASES = {
    "company_name": ("company", "company_name", "organisation", "organization", "employer"),
    "job_title": ("job_title", "title", "role", "position", "designation"),
    "job_url": ("job_url", "url", "link", "apply_link", "job_link"),
    "location_type": ("work_mode", "location_type", "workplace_type"),
    "employment_type": ("job_type", "employment_type"),
    "salary_min": ("salary_min", "min_salary", "minimum_salary"),
    "salary_max": ("salary_max", "max_salary", "maximum_salary"),
    "salary_currency": ("currency", "salary_currency"),
    "hr_name": ("hr_name", "contact_name", "recruiter_name", "recruiter"),
    "hr_email": ("hr_email", "email", "contact_email"),
    "hr_mobile": ("hr_mobile", "phone", "mobile", "contact_number"),
    "location": ("location", "city", "place"),
}


def header_key(name: str) -> str:
    return re.sub(r"[\s_-]+", "_", re.sub(r"[.:]+$", "", name.replace("﻿", "").strip().lower()))


def match_header(name: str, aliases: Mapping[str, Sequence[str]] = ALIASES) -> str | None:
    """The field of a header: an alias, else one whose alias of over three letters stands in it."""
    key = header_key(name)
    for field, names in aliases.items():
        if key in names:
            return field
    for field, names in aliases.items():
        if any(len(n) > 3 and n in key for n in names):
            return field
    return None


def sniff(first_line: str) -> str:
    return "\t" if first_line.count("\t") > first_line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as strings; ragged rows are padded, quotes may span lines; blank rows go."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = sniff(first[0][0]) if first else ","
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", encoding="UTF-8")
    return df.where(~all_blank(df.columns))


def all_blank(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "")
    return out


def mapped(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Columns by the field their header means; of several for one field the first; unknown ones go."""
    found: dict[str, str] = {}
    for c in df.columns:
        field = match_header(c, aliases)
        if field and field not in found:
            found[field] = c
    return df.select(*(F.col(f"`{c}`").alias(f) for f, c in found.items()))


def is_header_echo(columns: Mapping[str, Column], aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """Rows that repeat the header: at least two values, all of them header names."""
    names = sorted({n for group in aliases.values() for n in group})
    keys = F.filter(F.array(*(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_") for c in columns.values())), lambda x: x.isNotNull() & (x != ""))
    return (F.size(keys) >= 2) & F.forall(keys, lambda k: k.isin(*names))


def csv_line(*columns: Column) -> Column:
    """One line with every cell quoted, line breaks as spaces and formulas guarded."""

    def cell(c: Column) -> Column:
        text = formula_guard(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return F.concat_ws(",", *(cell(c) for c in columns))


def csv_line_plain(*columns: Column) -> Column:
    """One line with cells quoted where they must be."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *(cell(c) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*(formula_guard(F.col(c).cast("string")).alias(c) for c in df.columns)).write.csv(path, header=True, quoteAll=True, escape='"', lineSep="\n")


def stage_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """Raw records once for each domain, source and checksum."""
    from ledgerlark.operators.merging import insert_ignore

    return insert_ignore(old, new, ["domain", "source", "checksum"])


def append_snapshot(metrics: DataFrame, path: str, taken_at: Column) -> None:
    """Append (domain, metrics JSON, taken_at) rows."""
    metrics.withColumn("taken_at", taken_at).write.mode("append").partitionBy("domain").parquet(path)


def latest_snapshots(spark: SparkSession, path: str, domain: str, n: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("domain") == domain).orderBy(F.desc("taken_at")).limit(n)
