"""People: names from profiles, addresses from names, mailbox verdicts, provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.similarity import ratio
from ledgerlark.functions.strings import present

#: How addresses are made from names, the most common way first.
ADDRESS_FORMS = ("{f}.{l}", "{f}{l}", "{i}{l}", "{f}", "{f}_{l}", "{l}.{f}", "{f}.{j}", "{l}")
#: What a mail server's refusal says if it will not change, and if it may.
HARD_BOUNCE = r"(?i)user unknown|no such user|does not exist|mailbox unavailable|recipient rejected|5\.1\.1"
TRANSIENT = r"(?i)timeout|timed out|connection|greylist|try again|blocked|blacklist|spamhaus|rate limit|4\.\d\.\d"


def profile_name(slug: Column) -> Column:
    """A name from a profile's address: words up to the first number or id, four at most."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(slug, r"\?.*$", ""), "^/+|/+$", "")), "[-_]+"), lambda p: p != "")
    ends = F.transform(parts, lambda p: p.rlike(r"^\d{2,}$|^(?=.*\d)[0-9a-f]{6,}$|[^\x00-\x7f]"))
    stop = F.array_position(ends, True)
    kept = F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts)
    return F.initcap(F.array_join(F.slice(kept, 1, 4), " "))


def person_similarity(a: Column, b: Column) -> Column:
    """Likeness of two names whatever the order of their words."""

    def key(c: Column) -> Column:
        words = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
        return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")

    return ratio(key(a), key(b))


def company_in_text(company: Column, text: Column) -> Column:
    """Whether a company, or a long word of its name, stands in a text."""
    body = F.lower(F.coalesce(text, F.lit("")))
    short = F.regexp_replace(F.regexp_replace(F.lower(company), r"\b(pvt|private|ltd|limited|inc|technologies|tech|solutions|india)\b", ""), r"^[ .,-]+|[ .,-]+$", "")
    words = F.regexp_extract_all(F.lower(company), F.lit("[a-z]{4,}"), F.lit(0))
    return F.coalesce((body != "") & ((F.length(short) >= 3) & F.contains(body, short) | F.exists(words, lambda w: F.contains(body, w))), F.lit(False))


def address_candidates(name: Column, domain: Column) -> Column:
    """Addresses that a name may have at a domain, likely ones first."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim(name)), "[^a-z ]", ""), " +"), lambda w: w != "")
    first, last = F.get(words, 0), F.when(F.size(words) > 1, F.element_at(words, -1))
    site = F.regexp_replace(F.lower(F.trim(domain)), "^@", "")
    parts = {"{f}": first, "{l}": last, "{i}": F.left(first, F.lit(1)), "{j}": F.left(last, F.lit(1))}

    def made(form: str) -> Column:
        out = F.lit(form)
        for mark, value in parts.items():
            if mark in form:
                out = F.replace(out, F.lit(mark), value)
        return F.when(F.length(out) >= 2, F.concat(out, F.lit("@"), site))

    return F.array_distinct(F.array_compact(F.array(*(made(f) for f in ADDRESS_FORMS))))


def mailbox_verdict(result: Column) -> Column:
    """valid, catch_all, invalid, disposable or unknown from a checker's JSON; our own network trouble is no bounce."""

    def at(path: str) -> Column:
        return F.get_json_object(result, path)

    reach, said = F.lower(F.coalesce(at("$.is_reachable"), F.lit("unknown"))), F.coalesce(at("$.smtp.error.message"), at("$.smtp.error"), F.lit(""))
    disposable, role = (F.coalesce(at(f"$.misc.{k}") == "true", F.lit(False)) for k in ("is_disposable", "is_role_account"))
    return (
        F.when(said.rlike(HARD_BOUNCE) & ~said.rlike(TRANSIENT), "invalid")
        .when(reach.isin("true", "safe"), "valid")
        .when(reach == "risky", "catch_all")
        .when(reach.isin("false", "invalid"), F.when(disposable, "disposable").otherwise("invalid"))
        .when((reach == "unknown") & disposable, "disposable")
        .when((reach == "unknown") & role, "catch_all")
        .otherwise("unknown")
    )


def provenance(old: Column, fields: Mapping[str, Column], source: Column, verified: Column, at: Column) -> Column:
    """Map of field to (source, verified, at): entries there are stay, fields with a value get one."""
    entries = F.array(*(F.when(present(c), F.struct(F.lit(n).alias("key"), F.struct(source.alias("source"), verified.alias("verified"), at.alias("at")).alias("value"))) for n, c in fields.items()))
    new = F.map_from_entries(F.array_compact(entries))
    return F.when(old.isNull(), new).otherwise(F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k))))
