"""Queries of the text operators, by name; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..sources.tables import table
from . import leaks, pieces, pii, quality, skeleton, tokens


def _of(function: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(*(table(ship(spark), sf_dir, n) for n in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _of(skeleton.found, "topics", "tag_registry"),
    "p1_consistent": _of(skeleton.consistent, "topics"),
    "p2_found": _of(pii.found, "posts", "given_names"),
    "p2_redacted": _of(pii.redacted, "posts", "given_names"),
    "p3_found": _of(pieces.found, "posts", "kv_store_doc_status"),
    "p3_pieces": _of(pieces.pieces, "posts", "kv_store_doc_status"),
    "p3_files": lambda spark, sf_dir: pieces.rejoined(ship(spark), table(spark, sf_dir, "documents")),
    "p6_ids": _of(tokens.encoded, "documents"),
    "p6_decoded": _of(tokens.decoded, "documents"),
    "p7_found": _of(leaks.found, "documents", "benchmark"),
    "p7_leaks": _of(leaks.leaks, "documents", "benchmark"),
    "p8_found": _of(quality.found, "documents", "common_words"),
    "p8_kinds": _of(quality.kinds, "documents", "common_words"),
    "p8_statistics": _of(quality.statistics, "documents", "common_words"),
}

_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY TRY_CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST) AS rn FROM {1}) WHERE rn = 1"

#: Results that SQL can give too, by another way.
SQL: dict[str, str] = {
    "p3_found": f"""
SELECT 'plain_text' AS field_name, CAST(id AS VARCHAR) AS item_key, CASE WHEN list_max(list_transform(regexp_split_to_array(plain_text, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}。！？]'), lambda x: length(x))) > 2000 THEN 'inside' ELSE 'boundary' END AS cut_kind
FROM ({_NEWEST.format('id', 'posts')}) WHERE length(plain_text) > 2000
UNION ALL
SELECT 'chunks_list', doc_id, CASE WHEN max(n) > 12 THEN 'inside' ELSE 'boundary' END FROM (
  SELECT doc_id, g, count(*) AS n FROM (
    SELECT doc_id, sum(CASE WHEN chunk IS NOT NULL AND before IS NOT NULL AND part > 0 AND before = base || CASE WHEN part > 1 THEN '-p' || (part - 1) ELSE '' END THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (
      SELECT doc_id, pos, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY pos) AS before, regexp_extract(chunk, '^(.*)-p[1-9][0-9]*$', 1) AS base, COALESCE(TRY_CAST(regexp_extract(chunk, '-p([1-9][0-9]*)$', 1) AS BIGINT), 0) AS part FROM (
        SELECT doc_id, unnest(range(1, len(chunks_list) + 1)) AS pos, unnest(chunks_list) AS chunk FROM ({_NEWEST.format('doc_id', 'kv_store_doc_status')}) WHERE len(chunks_list) > 12))) GROUP BY 1, 2) GROUP BY 1, 2""",
    "p3_files": "SELECT l AS item_key, CAST(strlen(x) AS BIGINT) AS bytes, true AS within, md5(x) AS digest FROM (SELECT l, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS x FROM (SELECT doc_id, text, 'x' || hex(COALESCE(lang, '')) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1) WHERE strlen(x) > 4000",
    "p6_decoded": "SELECT doc_id, COALESCE(text, '') AS text FROM documents",
    "p7_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
gi AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i WHERE len(w) > 12)),
gd AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) > 12))
SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)""",
    "p8_statistics": rf"""
WITH c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, list_filter(string_split_regex(text, '\r?\n'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS l FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count, length(array_to_string(w, '')) / NULLIF(len(w), 0) AS mean_word_length,
  length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / NULLIF(length(regexp_replace(text, '\s', '', 'g')), 0) AS symbol_ratio,
  len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?…。！？]$'))) / NULLIF(len(l), 0) AS punctuated_lines,
  len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: list_contains(common, x))) / NULLIF(len(w), 0) AS common_share FROM d, c""",
}
