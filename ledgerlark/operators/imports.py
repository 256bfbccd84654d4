"""Import of lead rows: which known lead each row is, by a ladder of keys, within the file and against the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import strings as S
from ledgerlark.functions.similarity import trigrams
from ledgerlark.operators import simjoin
from ledgerlark.operators.matching import SAME
from ledgerlark.operators.ranking import best_per


def contact_keys(email: Column, mobile: Column) -> Column:
    """All forms under which an opt-out of a contact may be stored."""
    raw, d = F.lower(F.trim(mobile)), S.digits(mobile)
    local = F.right(F.regexp_replace(d, "^0+", ""), F.lit(10))
    ten = F.length(local) == 10
    forms = F.array(F.lower(F.trim(email)), raw, F.nullif(d, F.lit("")), F.when(ten, local), F.when(ten, F.concat(F.lit("+91"), local)))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def suppressed(rows: DataFrame, key: str, email: str, mobile: str, optouts: DataFrame, contact: str) -> DataFrame:
    """rows with suppressed: whether any form of the contact has opted out."""
    forms = rows.select(F.col(key).alias("_k"), F.explode(contact_keys(F.col(email), F.col(mobile))).alias("_c"))
    hit = forms.join(optouts.select(F.lower(F.trim(F.col(contact))).alias("_c")).distinct(), "_c", "left_semi").select("_k").distinct()
    return rows.join(hit, F.col(key) == F.col("_k"), "left").withColumn("suppressed", F.col("_k").isNotNull()).drop("_k")


def with_keys(df: DataFrame, *names: str) -> DataFrame:
    """Columns of the ladder for rows with company, title and url, or those named.

    They come out of a generator, so that filters on them don't have them told again at the scan.
    """
    keys = {
        "fingerprint": S.fingerprint(F.col("company"), F.col("title"), F.col("url")),
        "company_key": S.company_key(F.col("company")),
        "url_key": S.url_key(F.col("url")),
        "host_key": S.host(F.col("url")),
    }
    return df.select("*", F.inline(F.array(F.struct(*(keys[n].alias(n) for n in names or keys)))))


def near_titles(new: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """company_key, host_key and title of new (which has the keys) with _near: the newest lead of that company and host with a title of like trigrams.

    Titles are compared once each, however many rows and leads have them, and only those that share a rare trigram.
    """
    block = ["company_key", "host_key"]
    told = F.struct(*block, "title")
    with_title = (F.col("company_key") != "") & F.col("host_key").isNotNull() & F.col("title").isNotNull()
    newest = best_per(with_keys(known, *block).where(with_title), [*block, "title"], [F.col("seen").desc_nulls_last(), F.col("lead_id")]).select(told.alias("of"), "seen", "lead_id")
    mine, theirs = (df.select("of", "of.company_key", "of.host_key", F.sort_array(trigrams(F.col("of.title"))).alias("grams")) for df in (new.where(with_title).select(told.alias("of")).distinct(), newest))
    near = simjoin.sets_between(mine, theirs, "of", "grams", block, least).join(newest, F.col("_b") == F.col("of"))
    return best_per(near, "_a", [F.col("seen").desc_nulls_last(), F.col("lead_id")]).select("_a.*", F.col("lead_id").alias("_near"))


def resolve(rows: DataFrame, leads: DataFrame, least: float = SAME) -> DataFrame:
    """rows with outcome and target: lead_id, fingerprint, url, fuzzy, in_file, created or invalid.

    rows have row (its number in the file), lead_id, company, title and url; leads have lead_id, company, title,
    url and seen. Every step takes only what the steps above left, and of several leads the newest. A row
    whose fingerprint came earlier in the file merges into that row's lead. `least` is above 0.
    """
    new, known = with_keys(rows.repartition("row")), leads.repartition("lead_id")  # keys cost time that the bytes of a small file don't tell
    new = new.withColumn("valid", (F.col("company_key") != "") | (F.coalesce(F.col("url_key"), F.lit("")) != ""))
    first = Window.partitionBy("fingerprint").orderBy("row")
    new = new.withColumn("_first", F.min("row").over(first))

    def newest(keys: list[str], name: str) -> DataFrame:
        best = best_per(with_keys(known, *keys).where(F.col(keys[0]) != ""), keys, [F.col("seen").desc_nulls_last(), F.col("lead_id")])
        return best.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.col("lead_id").alias(f"_{name}"))

    def hit(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        other = newest(keys, name)
        on = F.col(keys[0]) == F.col(f"_{name}_{keys[0]}")
        for k in keys[1:]:
            on = on & (F.col(k) == F.col(f"_{name}_{k}"))
        return df.join(other, on, "left").drop(*(f"_{name}_{k}" for k in keys))

    got = new.join(known.select(F.col("lead_id").alias("_by_id")).distinct(), F.col("lead_id") == F.col("_by_id"), "left")
    got = hit(hit(got, ["fingerprint"], "by_print"), ["url_key", "company_key"], "by_url")
    got = got.join(near_titles(with_keys(rows.repartition("row"), "company_key", "host_key"), known, least), ["company_key", "host_key", "title"], "left")
    got = got.withColumn("_near", F.when(F.col("valid") & F.col("row").isNotNull(), F.col("_near")))
    outcome = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("_first") < F.col("row"), "in_file")
        .when(F.col("_by_id").isNotNull(), "lead_id")
        .when(F.col("_by_print").isNotNull(), "fingerprint")
        .when(F.col("_by_url").isNotNull(), "url")
        .when(F.col("_near").isNotNull(), "fuzzy")
        .otherwise("created")
    )
    target = F.coalesce("_by_id", "_by_print", "_by_url", "_near")
    return got.select(*rows.columns, outcome.alias("outcome"), F.when(F.col("valid"), target).alias("target"), F.col("_first").alias("first_row"))


def tally(resolved: DataFrame) -> DataFrame:
    """Counts of an import: created, merged, merged_fuzzy, skipped."""
    o = F.col("outcome")
    return resolved.agg(
        F.count("*").alias("total_rows"),
        F.count_if(o == "created").alias("created"),
        F.count_if(o.isin("lead_id", "fingerprint", "url", "in_file")).alias("merged"),
        F.count_if(o == "fuzzy").alias("merged_fuzzy"),
        F.count_if(o == "invalid").alias("skipped"),
    )
