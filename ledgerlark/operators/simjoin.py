"""Similarity joins without all pairs: what is alike shares a rare token or a piece, so an equality join finds it.

Rows with the same block and value are one class first, with their least key as representative, so copies meet
nothing. Sets are joined on the rarest tokens of each: two sets of Jaccard similarity t share one
of the first n - ceil(t * n) + 1 in any common order, and their lengths and the places of that token bound what they
can still share. Strings at edit similarity t differ by k = (1 - t) * length edits at most, so of k + 1 pieces of the
shorter one at least one stands unchanged in the longer one, near its place. Texts with a share of matching runs of t
have a common subsequence of t times their mean length: both come to it by leaving out a few characters. Every candidate is then
compared in full. NULL blocks and NULL values are like nothing; ties among representatives don't matter, as a
pair is told once with the lesser key on the left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.similarity import levenshtein_similarity, overlap


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{a}.{n}") == F.col(f"{b}.{n}"))
    return out


def classes(df: DataFrame, key: str, value: str, block: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(heads, members): one row of each block and value with its least key, and every row's representative.

    Keys that are NULL are left out. value must be comparable; an array is taken as it stands.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, value, *block)
    heads = rows.groupBy(*block, value).agg(F.min(key).alias(key))
    same = F.col(f"t.{value}").eqNullSafe(F.col(f"h.{value}"))
    for b in block:
        same = same & F.col(f"t.{b}").eqNullSafe(F.col(f"h.{b}"))
    members = rows.alias("t").join(heads.alias("h"), same).select(F.col(f"t.{key}").alias(key), F.col(f"h.{key}").alias("representative"))
    for c in (value, *block):
        heads = heads.where(F.col(c).isNotNull())
    return heads, members


def by_rarity(heads: DataFrame, key: str, tokens: str, block: Sequence[str]) -> DataFrame:
    """key, block and `ordered`: the tokens from the rarest to the most common one over all heads, ties by token."""
    each = heads.select(key, *block, F.explode(tokens).alias("_token"))
    usual = each.groupBy("_token").agg(F.count("*").alias("_n"))
    told = each.join(usual, "_token").groupBy(key, *block).agg(F.sort_array(F.collect_list(F.struct("_n", "_token"))).alias("_all"))
    return told.select(key, *block, F.col("_all._token").alias("ordered"))


def set_candidates(heads: DataFrame, key: str, tokens: str, block: Sequence[str], least: float) -> DataFrame:
    """_a, _b: pairs of heads that share one of their rarest tokens where it still could be enough."""
    rows = by_rarity(heads, key, tokens, block)
    n = F.size("ordered")
    first = F.slice("ordered", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)
    index = rows.select(key, *block, n.alias("n"), F.posexplode(first).alias("at", "token"))
    shared = F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    a_first = F.struct("a.n", f"a.{key}") < F.struct("b.n", f"b.{key}")  # a is the smaller one
    near = index.alias("a").join(index.alias("b"), _same("a", "b", [*block, "token"]) & a_first & (F.col("a.n") >= F.col("b.n") * least - 1e-9))
    near = near.where(F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= shared)
    return near.select(F.col(f"a.{key}").alias("_a"), F.col(f"b.{key}").alias("_b")).distinct()


def similar_sets(heads: DataFrame, key: str, tokens: str, block: Sequence[str], least: float) -> DataFrame:
    """left, right and similarity of heads whose token lists (without repeats) have a Jaccard similarity of `least` or more.

    Empty sets are like nothing.
    """
    pairs = set_candidates(heads, key, tokens, block, least)
    sets = heads.select(F.col(key).alias("_key"), F.col(tokens).alias("_set"))
    pairs = pairs.join(sets.select(F.col("_key").alias("_a"), F.col("_set").alias("_x")), "_a").join(sets.select(F.col("_key").alias("_b"), F.col("_set").alias("_y")), "_b")
    out = pairs.select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), overlap(F.col("_x"), F.col("_y")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def sets_between(new: DataFrame, known: DataFrame, key: str, tokens: str, block: Sequence[str], least: float) -> DataFrame:
    """_a, _b: keys of new and of known whose token lists (without repeats) have a Jaccard similarity of `least` (above 0) or more.

    Both have the key, the tokens and the block's columns. Pairs meet as in set_candidates(), in one order of the tokens of both sides.
    """
    sides = [df.select(F.struct(F.lit(i).alias("side"), F.col(key).alias("of")).alias("_row"), F.col(tokens).alias("_set"), *block).where(F.size("_set") > 0) for i, df in enumerate((new, known))]
    rows = by_rarity(sides[0].unionAll(sides[1]), "_row", "_set", block)
    n = F.size("ordered")
    first = F.slice("ordered", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)
    index = rows.select("_row", *block, n.alias("n"), F.posexplode(first).alias("at", "token"))
    shared = F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    sizes = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9) & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= shared)
    near = index.where("_row.side = 0").alias("a").join(index.where("_row.side = 1").alias("b"), _same("a", "b", [*block, "token"]) & sizes)
    near = near.select(F.col("a._row").alias("_x"), F.col("b._row").alias("_y")).distinct()
    x, y = (df.select(F.col("_row").alias(f"_{s}"), F.col("_set").alias(f"_{s}_set")) for s, df in zip("xy", sides, strict=True))
    return near.join(x, "_x").join(y, "_y").where(overlap(F.col("_x_set"), F.col("_y_set")) >= least).select(F.col("_x.of").alias("_a"), F.col("_y.of").alias("_b"))


def _edits(length: str, least: float) -> str:
    """The most edits that leave strings of which the longer one has this length alike."""
    return f"cast(floor((1 - {least}D) * ({length}) + 1e-6D) as int)"


def _piece(m: str, k: str, i: str) -> tuple[str, str]:
    """Start (from 0) and length of piece i of k + 1 of a string of length m, the longer pieces last."""
    return f"({i} * ({m} div ({k} + 1)) + greatest(0, {i} - ({k} + 1 - {m} % ({k} + 1))))", f"({m} div ({k} + 1) + if({i} >= {k} + 1 - {m} % ({k} + 1), 1, 0))"


def _pieces(text: str, least: float) -> Column:
    """What a string offers as the shorter one: its pieces for every number of edits that a longer one may bring."""
    start, size = _piece("n", "k", "i")
    each = f"transform(sequence(0, k), i -> named_struct('m', n, 'k', k, 'i', i, 'piece', substring({text}, int({start}) + 1, int({size}))))"
    counts = f"array_distinct(transform(sequence(n, cast(floor(n / {least}D + 1e-6D) as int)), l -> {_edits('l', least)}))"
    return F.expr(f"flatten(transform({counts}, k -> {each}))")


def _probes(text: str, least: float) -> Column:
    """What a string looks for as the longer one: parts where a piece of a shorter one could stand."""
    start, size = _piece("m", "k", "i")
    low = f"greatest(0, {start} - i, {start} + (n - m) - (k - i))"
    high = f"least(n - {size}, {start} + i, {start} + (n - m) + (k - i))"
    parts = f"if({high} < {low}, array(), transform(sequence(int({low}), int({high})), p -> named_struct('m', m, 'k', k, 'i', i, 'piece', substring({text}, p + 1, int({size})))))"
    every = f"flatten(transform(sequence(n - k, n), m -> flatten(transform(sequence(0, k), i -> {parts}))))"
    return F.expr(f"array_distinct(flatten(transform(array({_edits('n', least)}), k -> {every})))")


def string_candidates(heads: DataFrame, key: str, text: str, block: Sequence[str], least: float) -> DataFrame:
    """_a, _b and their texts _x, _y: pairs of heads of which the longer one has a piece of the shorter one near its place.

    They stay few while the pieces are words of some letters, so for `least` well above 0.5; below that a piece can be
    empty, which is right but finds all pairs of a block and length.
    """
    rows = heads.select(key, *block, text, F.length(text).alias("n"))
    names = [*block, "m", "k", "i", "piece"]
    small = rows.select(key, *block, text, "n", F.inline(_pieces(text, least)))
    large = rows.select(key, *block, text, "n", F.inline(_probes(text, least)))
    smaller = F.struct("a.n", f"a.{key}") < F.struct("b.n", f"b.{key}")
    near = small.alias("a").join(large.alias("b"), _same("a", "b", names) & smaller)
    return near.select(F.col(f"a.{key}").alias("_a"), F.col(f"b.{key}").alias("_b"), F.col(f"a.{text}").alias("_x"), F.col(f"b.{text}").alias("_y")).distinct()


def similar_strings(heads: DataFrame, key: str, text: str, block: Sequence[str], least: float) -> DataFrame:
    """left, right and similarity of heads whose texts have an edit similarity of `least` or more."""
    pairs = string_candidates(heads, key, text, block, least)
    out = pairs.select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), levenshtein_similarity(F.col("_x"), F.col("_y")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


#: The most ways (about) to leave out characters of a text; where there are more, the texts of a block and two lengths are compared pair by pair.
MOST_WAYS = 512


def subsequence_candidates(heads: DataFrame, key: str, text: str, block: Sequence[str], least: float) -> DataFrame:
    """_a, _b: heads of a block whose different texts can have a ratio() of `least` (above 0) or more, either way round.

    Such texts of n and m characters have a common subsequence of least * (n + m) / 2. What all texts of a block begin and
    end with is part of it. Of the rest, each offers all subsequences of that length, once for each length
    that the block has. For pairs of lengths with too many of them it offers none, and only the edits tell them apart.
    """
    back, n = F.reverse(text), F.length(text)
    alike = "size(filter(sequence(0, least(length({0}), length({1}))), i -> left({0}, i) = left({1}, i))) - 1"
    of_block = heads.groupBy(*block).agg(F.min(text).alias("x"), F.max(text).alias("y"), F.min(back).alias("v"), F.max(back).alias("w"), F.min(n).alias("short"), F.collect_set(n).alias("lengths"))
    of_block = of_block.withColumn("first", F.expr(alike.format("x", "y"))).withColumn("last", F.least(F.expr(alike.format("v", "w")), F.expr("short - first")))
    of_block = of_block.select(*block, "first", (F.col("first") + F.col("last")).alias("told"), "lengths")
    common = f"cast(ceil(({{0}} + {{1}}) * {least}D / 2 - 1e-9D) as int)"
    rows = heads.select(key, *block, F.col(text).alias("text"), n.alias("n")).join(of_block, list(block)).withColumn("m", F.explode("lengths"))
    rows = rows.withColumn("kept", F.expr(f"greatest(0, {common.format('n', 'm')} - told)")).where(f"{common.format('n', 'm')} <= least(n, m)")
    many = f"pow(n - told, n - told - kept) > {MOST_WAYS} or pow(m - told, m - told - kept) > {MOST_WAYS}"
    shorter = "aggregate(array_repeat(0, n - told - kept), array(substring(text, first + 1, n - told)), (all, _) -> array_distinct(flatten(transform(all, s -> transform(sequence(1, length(s)), i -> concat(left(s, i - 1), substring(s, i + 1)))))))"
    rows = rows.select(key, *block, "text", "n", F.expr("least(n, m)").alias("lo"), F.expr("greatest(n, m)").alias("hi"), F.expr(many).alias("many"), F.explode(F.expr(f"if({many}, array(''), {shorter})")).alias("piece"))
    names = [*block, "lo", "hi", "many", "piece"]
    index = rows.withColumn("hash", F.xxhash64(*names))  # the first key of the join, so that it sorts by a number
    fits = (F.col("a.text") < F.col("b.text")) & (F.col("a.n") + F.col("b.n") == F.col("a.lo") + F.col("a.hi"))
    near = index.alias("a").join(index.alias("b"), _same("a", "b", ["hash", *names]) & fits)
    near = near.where(~F.col("a.many") | (F.levenshtein("a.text", "b.text") <= F.col("a.n") + F.col("b.n") - 2 * F.expr(common.format("a.n", "b.n"))))
    return near.select(F.col(f"a.{key}").alias("_a"), F.col(f"b.{key}").alias("_b")).distinct()


def row_pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Links of representatives as pairs of rows, and the pairs of rows of one class (similarity 1)."""
    a, b = (members.select(F.col(key).alias(f"_{s}"), F.col("representative").alias(s)) for s in ("left", "right"))
    between = links.join(a, "left").join(b, "right").select(F.least("_left", "_right").alias("left"), F.greatest("_left", "_right").alias("right"), "similarity")
    within = members.alias("a").join(members.alias("b"), (F.col("a.representative") == F.col("b.representative")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return between.unionAll(within.select(F.col(f"a.{key}"), F.col(f"b.{key}"), F.lit(1.0)))


def link_counts(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key, representative and links: how many other classes are like the row's."""
    ends = links.select(F.explode(F.array("left", "right")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    return members.join(ends, "representative", "left").select(key, "representative", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
