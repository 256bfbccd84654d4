"""Writes as snapshot rewrites: the old and the new rows in, the next snapshot out.

Parquet has no MERGE, so each operator is a full outer join on the key (or an anti join), and the
caller writes the result to a new path. Incoming rows of a key are first reduced to one, the winner by an
explicit order, so the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.strings import blank
from ledgerlark.operators.ranking import best_per


def one_per_key(df: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """One row of each key: of the newest stamp, then by all columns."""
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys and c != newest]
    return best_per(df, keys, ([F.col(newest).desc_nulls_last()] if newest else []) + (rest or [F.lit(0)]))


def _on(keys: Sequence[str], a: str = "t", b: str = "s") -> Column:
    out = F.col(f"{a}.{keys[0]}").eqNullSafe(F.col(f"{b}.{keys[0]}"))
    for k in keys[1:]:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """old, and the rows of new whose key it doesn't have."""
    fresh = one_per_key(new, keys, newest).alias("s").join(old.select(*keys).distinct().alias("t"), _on(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], newest: str | None = None) -> DataFrame:
    """old and new by key; a column of both is what its rule says (over t.x and s.x), else the incoming value where there is one.

    Rows of one side only stay as they are.
    """
    own = old.withColumn("_t", F.lit(True)).alias("t")
    theirs = one_per_key(new, keys, newest).withColumn("_s", F.lit(True)).alias("s")
    out = []
    for c in old.columns:
        t, s = F.col(f"t.{c}"), F.col(f"s.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        both = t if c in keys else rules.get(c, F.coalesce(s, t) if c in new.columns else t)
        out.append(F.when(F.col("_t").isNull(), s).when(F.col("_s").isNull(), t).otherwise(both).alias(c))
    return own.join(theirs, _on(keys), "full_outer").select(*out)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """Incoming rows replace those of their key, NULLs included."""
    return merge(old, new, keys, {c: F.col(f"s.{c}") for c in old.columns if c in new.columns}, newest)


def fill_blank(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """Incoming values only where the old one is NULL or blank."""
    rules = {}
    for c in old.columns:
        if c in new.columns:
            t = F.col(f"t.{c}")
            missing = blank(t) if old.schema[c].dataType.typeName() == "string" else t.isNull()
            rules[c] = F.when(missing, F.col(f"s.{c}")).otherwise(t)
    return merge(old, new, keys, rules, newest)


def newest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str, protected: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Values of the later stamp where they aren't NULL; protected ones stay once set, lists are united."""
    later = F.coalesce(F.col(f"s.{stamp}") >= F.col(f"t.{stamp}"), F.col(f"t.{stamp}").isNull())
    rules = {}
    for c in old.columns:
        t, s = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c in protected:
            rules[c] = F.coalesce(t, s)
        elif c in lists:
            rules[c] = F.array_distinct(F.concat(F.coalesce(t, F.array().cast(old.schema[c].dataType)), F.coalesce(s, F.array().cast(old.schema[c].dataType))))
        elif c == stamp:
            rules[c] = F.greatest(t, s)
        else:
            rules[c] = F.when(later, F.coalesce(s, t)).otherwise(F.coalesce(t, s))
    return merge(old, new, keys, rules, stamp)


def history(old: DataFrame, new: DataFrame, keys: Sequence[str], flags: Sequence[str] = (), newest: str | None = None) -> DataFrame:
    """Nothing is lost: incoming values where there are any, flags that were ever true stay."""
    rules = {c: F.coalesce(F.col(f"s.{c}"), F.lit(False)) | F.coalesce(F.col(f"t.{c}"), F.lit(False)) for c in flags}
    return merge(old, new, keys, rules, newest)


def confident(old: DataFrame, new: DataFrame, keys: Sequence[str], confidence: str, locators: Sequence[str], maps: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Locators change only if blank or if the incoming confidence is higher; maps take incoming entries, lists unite."""
    more = F.coalesce(F.col(f"s.{confidence}") > F.col(f"t.{confidence}"), F.col(f"t.{confidence}").isNull())
    rules: dict[str, Column] = {confidence: F.greatest(F.col(f"t.{confidence}"), F.col(f"s.{confidence}"))}
    for c in locators:
        rules[c] = F.when(blank(F.col(f"t.{c}")) | more, F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}"))
    for c in maps:
        rules[c] = right_wins(F.col(f"t.{c}"), F.col(f"s.{c}"))
    for c in lists:
        empty = F.array().cast(old.schema[c].dataType)
        rules[c] = F.array_distinct(F.concat(F.coalesce(F.col(f"t.{c}"), empty), F.coalesce(F.col(f"s.{c}"), empty)))
    return merge(old, new, keys, rules, confidence)


def right_wins(a: Column, b: Column) -> Column:
    """Two maps as one, the second's values where both have a key."""
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))


def claim_first(claims: DataFrame, key: str, user: str, stamp: str, taken: DataFrame | None = None) -> DataFrame:
    """Every claim with its outcome: claimed for the first of a key, already_claimed for others and for keys taken before."""
    first = claims.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(stamp, user)).alias("_first"))
    out = claims.join(first, F.col(key) == F.col("_k"))
    if taken is not None:
        out = out.join(taken.select(F.col(key).alias("_t")).distinct(), F.col(key) == F.col("_t"), "left")
    else:
        out = out.withColumn("_t", F.lit(None).cast(claims.schema[key].dataType))
    won = F.col("_t").isNull() & (F.col("_first") == F.struct(stamp, user))
    return out.withColumn("outcome", F.when(won, "claimed").otherwise("already_claimed")).drop("_k", "_t", "_first")


def merge_duplicates(parents: DataFrame, links: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the duplicates, and children that point to the kept ones. links: duplicate, kept."""
    rest = parents.join(links.select(F.col("duplicate").alias(key)), key, "left_anti")
    out = {}
    for name, (child, parent) in children.items():
        moved = child.join(links, F.col(parent) == F.col("duplicate"), "left")
        out[name] = moved.withColumn(parent, F.coalesce("kept", parent)).select(*child.columns)
    return rest, out


def anonymise(df: DataFrame, matches: Column, personal: Sequence[str], stamp: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Personal columns NULL where the row matches; the row stays, stamp says when."""
    hit = F.coalesce(matches, F.lit(False))
    out = df.withColumns({c: F.when(~hit, F.col(c)) for c in personal})
    return out.withColumn(stamp, F.when(hit, as_of).otherwise(F.col(stamp) if stamp in df.columns else F.lit(None).cast("timestamp"))) if stamp else out


def reclassified(df: DataFrame, column: str, new: Column) -> DataFrame:
    """df with the column as it should be and changed: whether it was something else."""
    return df.withColumn("changed", ~F.col(column).eqNullSafe(new)).withColumn(column, new)
