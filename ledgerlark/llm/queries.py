"""The opN_ queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import block_lstm, filter_audit, fingerprints, minhash, mixing, packing, pfor, quality_rules, rulefit, secrets, source_divergence, toxicity, virtual_slots
from ledgerlark.llm.common import WORD, bound_batches, table

#: Tokenizer of the queries; the operators take any path.
TOKENIZER = "word_bpe_49k.json"
END = 2


def _remainder(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def _in_bounded_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def _judged(scores: DataFrame, held_out: Column, *more: str) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *more)


def op1_rulefit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rulefit.fit(docs, table(spark, sf_dir, "labels"), _remainder(4) != 2)
    return _judged(rulefit.score_documents(docs, model), _remainder(4) == 2, *rulefit.STATISTICS)


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "quota")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op5_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END)


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), packing.Pack(end=END))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    return _judged(toxicity.score_documents(docs, model), _remainder(3) == 1, "evidence")


def op9_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op10_block_lstm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_lstm.extract(table(spark, sf_dir, "pages"))


def op11_adjacent_swap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_group_tile_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is bytes: sizes near equal. The map decides, so a grown number of shards has no answer for a doc_id alone."""
    got = virtual_slots.place(table(spark, sf_dir, "documents"), shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _in_bounded_batches(f)
    for f in (
        op1_rulefit_quality,
        op2_sainte_lague_mix,
        op3_secret_scan,
        op4_probminhash_classes,
        op5_pfor_token_files,
        op6_prefix_fingerprints,
        op7_cost_balanced_packing,
        op8_toxicity_neighbours,
        op9_repetition_coverage,
        op10_block_lstm_text,
        op11_adjacent_swap_audit,
        op12_group_tile_divergence,
        op13_virtual_slot_shards,
    )
}


def _rules_sql(limits: quality_rules.Limits) -> str:
    """The repetition rules for DuckDB, with window functions over words and lines."""

    def gram(n: int) -> str:
        return " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER w" for k in range(1, n)])

    sizes = sorted(limits.grams)
    grams = ", ".join(f"{gram(n)} AS g{n}" for n in (3, *sizes))
    marks = ", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS f{n}" for n in sizes)
    cover = ", ".join(f"max(f{n}::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    chars = ", ".join(f"sum(c{n} * length(word)) AS x{n}" for n in sizes)
    over = " OR ".join(f"100 * x{n} > {share} * word_chars" for n, share in sorted(limits.grams.items()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM d),
v AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (SELECT doc_id, i, word, {grams} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, word, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS f3, {marks} FROM g),
c AS (SELECT doc_id, word, max(f3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, {cover} FROM f),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(c3) AS n_repeat_words, {chars} FROM c GROUP BY 1),
p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
q AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM p),
r AS (SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM q WHERE regexp_matches(line, '{WORD}')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE dup), 0) AS dup_line_chars FROM r GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(x{sizes[0]}, 0)::BIGINT AS dup_gram_chars, coalesce({over}, false) AS over
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words AS base_failed FROM a)
SELECT * EXCLUDE (over), NOT base_failed AND NOT over AND 100 * n_dup_lines <= {limits.lines} * n_lines AND 100 * dup_line_chars <= {limits.line_chars} * word_chars AND 100 * n_symbols <= {limits.symbols} * n_words AS kept FROM b
"""


#: The audit without a walk: every order of the letters, every step, sums over masks.
AUDIT_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
  coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::INT AS earlier FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o)),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (mask & (earlier | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

_LETTERS = "".join(map(chr, range(65, 91)))

DIVERGENCE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
x AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

#: The other operators learn, hash or decode; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_repetition_coverage": _rules_sql(quality_rules.Limits()),
    "op11_adjacent_swap_audit": AUDIT_SQL,
    "op12_group_tile_divergence": DIVERGENCE_SQL,
}
