"""Sources over whole tables: entries of listing pages, and a table written as workbooks and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.registry import query
from ledgerlark.sources import listing, sheets
from ledgerlark.tables import table
from ledgerlark.workspace import scratch


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract_all(html, '(?is)<a\b[^>]*?href=["''][^"'']+["''][^>]*>.*?</a>') AS found FROM pages),
l AS (SELECT page_id, root, unnest(found) AS a, generate_subscripts(found, 1) AS i FROM p),
h AS (SELECT page_id, i, root || regexp_extract(a, '(?is)href=["'']([^"''#]+)', 1) AS url, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1),
w AS (SELECT *, list_filter(regexp_split_to_array(regexp_extract(url, '/([^/]+)$', 1), '[-_]+|%20'), lambda x: x <> '' AND (NOT regexp_full_match(x, '\d+') OR regexp_full_match(x, '(19|20)\d\d'))) AS parts FROM f)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, 'link_discovery' AS method, url,
 CASE WHEN contains(text, ' ') THEN text WHEN len(list_filter(parts, lambda x: NOT regexp_full_match(x, '\d+'))) >= 2
  THEN list_aggregate(list_transform(parts, lambda x: CASE WHEN length(x) <= 5 AND regexp_matches(x, '\pL') AND x = upper(x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), 'string_agg', ' ') END AS name FROM w
""")
def listing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = listing.listing_records(table(spark, sf_dir, "pages"), "page_id", "url", "html", "/")
    return got.select("page_id", "place", "method", "url", "name")


@query("SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text, length(text) % 3 = 0 AS ok FROM conversations")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a row of a workbook, and back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.length("text") % 3 == 0).alias("ok"))
    path = scratch(spark, "workbooks")
    sheets.write_workbooks(turns, path)
    return sheets.read_workbooks(spark, path, turns.schema)
