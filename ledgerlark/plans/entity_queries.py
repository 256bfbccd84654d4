"""Fuzzy matches and entity resolution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import similarity as L
from ledgerlark.functions import strings as S
from ledgerlark.operators import matching, simjoin
from ledgerlark.plans.registry import query
from ledgerlark.tables import table


@query("""
SELECT a.p_partkey AS "left", b.p_partkey AS "right", round(1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.6
""")
def fuzzy_levenshtein_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.edit_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_size"], least=0.6).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH t AS (SELECT p_partkey, p_brand, p_size, list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM part),
p AS (SELECT a.p_partkey AS l, b.p_partkey AS r, len(list_intersect(a.g, b.g))::DOUBLE AS x, (len(a.g) + len(b.g))::DOUBLE AS s FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT l AS "left", r AS "right", round(x / (s - x), 6) AS similarity FROM p WHERE x / (s - x) >= 0.3
""")
def fuzzy_trigram_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.trigram_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_size"], 0.3).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS w FROM conversations),
h AS (SELECT role, w, min({'c': conv_id, 't': turn}) AS head FROM t GROUP BY 1, 2),
p AS (SELECT a.head AS x, b.head AS y, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS s FROM h a JOIN h b ON a.role = b.role AND a.head <> b.head),
l AS (SELECT x, count(*) AS links FROM p WHERE n::DOUBLE / (s - n) >= 0.8 GROUP BY 1)
SELECT conv_id, turn, head.c AS head_conv, head.t AS head_turn, coalesce(links, 0) AS links FROM t JOIN h ON h.role = t.role AND h.w = t.w LEFT JOIN l ON l.x = h.head
""")
def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a role with the same words, and how many other sets of words are like theirs."""
    words = F.sort_array(F.array_distinct(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("row"), F.coalesce("role", F.lit("")).alias("role"), words.alias("words"))
    heads, members = simjoin.classes(rows, "row", "words", ["role"])
    got = simjoin.link_counts(simjoin.similar_sets(heads, "row", "words", ["role"], 0.8), members, "row")
    return got.select("row.conv_id", "row.turn", F.col("representative.conv_id").alias("head_conv"), F.col("representative.turn").alias("head_turn"), "links")


@query("""
WITH k AS (SELECT p_partkey, p_brand, p_size, p_name, p_retailprice FROM part), c AS (
 SELECT a.p_partkey, b.p_partkey AS m, round(1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS s, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice DESC, b.p_partkey) AS r
 FROM k a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM k) WHERE rn <= 200) b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
 WHERE 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.6)
SELECT k.p_partkey, m AS "match", s AS similarity FROM k LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON c.p_partkey = k.p_partkey
""")
def newest_match_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    got = matching.first_match(parts, parts, "p_partkey", "p_name", ["p_brand"], "p_retailprice", per=200, least=0.6)
    return got.select("p_partkey", "match", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT a.page_id, CASE WHEN ha <> hb THEN least(s, 0.5) ELSE s END AS similarity FROM (
 SELECT a.page_id, a.h AS ha, b.h AS hb, round(1.0 - levenshtein('acme dev ' || a.h, 'acme dev ' || b.h)::DOUBLE / greatest(length('acme dev ' || a.h), length('acme dev ' || b.h)), 6) AS s
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS h FROM pages) a JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS h FROM pages) b ON b.page_id = a.page_id + 1) a
""")
def posting_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    both = pages.join(pages.select((F.col("page_id") - 1).alias("before"), F.col("url").alias("url_b")), F.col("page_id") == F.col("before"))
    score = L.posting_similarity(F.lit("ACME"), F.lit("Dev"), F.col("url"), F.lit("Acme"), F.lit("dev"), F.col("url_b"))
    return both.select("page_id", F.round(score, 6).alias("similarity"))


@query()
def difflib_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ratio_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_size"], 0.7)


def _links_and_members(keys: DataFrame, key: str, blocks: Sequence[Sequence[str]], rule: Callable[[str, str], tuple[Column, Column]]) -> DataFrame:
    """Links between representatives (kind link) and every row under its representative (kind member, no confidence)."""
    links, members = matching.linked(keys, key, [c for c in keys.columns if c != key], blocks, rule)
    rows = members.select(F.lit("member").alias("kind"), F.col("representative").alias("left"), F.col(key).alias("right"), F.lit(None).cast("double").alias("confidence"))
    return links.select(F.lit("link").alias("kind"), "left", "right", "confidence").unionAll(rows)


@query()
def same_college_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = c.select(
        "c_custkey", F.lit("").alias("code_key"), F.lit(None).cast("string").alias("site"), F.col("c_nationkey").cast("string").alias("state_key"), S.ascii_key(F.col("c_name")).alias("name_key"),
        F.col("c_mktsegment").alias("city_key"), (F.col("c_custkey") % 7).cast("string").alias("district_key"),
    )
    return _links_and_members(keys, "c_custkey", matching.COLLEGE_BLOCKS, matching.same_college)


@query()
def same_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = o.select(
        "o_orderkey", F.lit("").alias("url_key"), F.concat(F.lit("event"), (F.col("o_custkey") % 50).cast("string")).alias("name_key"), S.ascii_key(F.col("o_orderpriority")).alias("organizer_key"),
        F.col("o_orderstatus").alias("city_key"), F.lit(None).cast("string").alias("site"), F.year("o_orderdate").alias("year"),
    )
    return _links_and_members(keys, "o_orderkey", matching.EVENT_BLOCKS, matching.same_event)
