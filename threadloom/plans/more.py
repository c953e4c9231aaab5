"""Queries of scalar functions, retrieval and streams, and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import text as X
from ..operators import cluster
from ..operators import graph as G
from ..operators import kg as K
from ..operators import retrieve as V
from ..session import materialize, ship
from ..sources.tables import table
from .forum import over
from .graph import Graph

QUESTION = "why does the signal box jam when the queue is full"
TERMS = ("save file", "save", "signal box", "cache", "brake curve")


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(ship(spark), sf_dir, name))


def _graph(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Graph(spark, sf_dir).fixed())


def _nearest(e: DataFrame) -> DataFrame:
    return V.top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "html_text": _on("posts", lambda t: t.select("id", X.html_text("cooked").alias("text"))),
    "sanitize": _on("posts", lambda t: t.select("id", X.sanitized(F.col("plain_text")).alias("text"))),
    "elide_blobs": _on("posts", lambda t: t.select("id", X.blobs_elided(F.col("plain_text")).alias("text"))),
    "doc_hash_ids": _on("posts", lambda t: t.select("id", X.document_id(F.col("plain_text")).alias("doc_id"))),
    "blocklist_hits": _on("posts", lambda t: t.select("id", F.array_join(X.blocklist_hits(F.col("plain_text"), TERMS), ",").alias("hits"))),
    "first_sentence": _on("posts", lambda t: t.select("id", X.first_sentence(F.col("plain_text")).alias("sentence"))),
    "markdown_cell": _on("posts", lambda t: t.select("id", X.markdown_cell(F.col("plain_text")).alias("cell"))),
    "truncate": _on("posts", lambda t: t.select("id", X.truncated(F.col("plain_text"), 30, "…").alias("label"))),
    "month_bins": _on("topics", lambda t: t.select("id", X.month_bin(F.col("created_at").try_cast("timestamp_ntz")).cast("int").alias("bin"), X.quarter_of_bin(X.month_bin(F.col("created_at").try_cast("timestamp_ntz"))).alias("quarter"))),
    "display_names": _on("posts", lambda t: t.select("username").distinct().select("username", X.display_name(F.col("username")).alias("name"))),
    "graph_signature": _graph(lambda g: G.signature(g.nodes, g.edges)),
    "naive_topk": _on("embeddings", _nearest),
    "kmeans_buckets": _on("embeddings", lambda t: V.k_means(t, "vec_id", "embedding")),
    "keyword_buckets": _graph(lambda g: cluster.keyword_buckets(g.edges, materialize(G.keyword_counts(g.edges), "keywords"))),
    "local_context": _graph(lambda g: V.local_context(g.nodes, g.edges, g.relations, QUESTION)),
    "global_context": _graph(lambda g: V.global_context(g.nodes, g.edges, g.relations, QUESTION)),
    "hybrid_context": _graph(lambda g: V.hybrid_context(g.nodes, g.edges, g.relations, QUESTION)),
    "mix_context": _graph(lambda g: V.mix_context(g.nodes, g.edges, g.relations, K.token_chunks(K.topic_documents(g.c), "topic_id", "document", 1200, 100), QUESTION)),
    "stream_upsert": lambda spark, sf_dir: streaming.upsert_topics(ship(spark), f"{sf_dir}/topics.parquet").select("id", "title", "views", "fetched_at"),
    "stream_tumbling": lambda spark, sf_dir: streaming.tumbling(ship(spark), f"{sf_dir}/events.parquet"),
}

_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffe}\x{ffff}]"
_WORDS = "(" + "|".join(sorted(TERMS, key=lambda t: (-len(t), t))) + ")"
_MONTH = "greatest(0, (year(ts) - 2018) * 12 + month(ts) - 1)"
_STRIPPED = f"regexp_replace(plain_text, '^{_BLANK}+|{_BLANK}+$', '', 'g')"

SQL: dict[str, str] = {
    "sanitize": f"SELECT id, regexp_replace(plain_text, '{_CONTROL}', '', 'g') AS text FROM posts",
    "elide_blobs": "SELECT id, CASE WHEN plain_text IS NOT NULL THEN array_to_string(list_transform(string_split_regex(plain_text, '[A-Za-z0-9+/=]{200,}'), lambda g, i: g || CASE WHEN i <= len(regexp_extract_all(plain_text, '[A-Za-z0-9+/=]{200,}')) THEN '<' || length(regexp_extract_all(plain_text, '[A-Za-z0-9+/=]{200,}')[i]) || '-char encoded blob elided>' ELSE '' END), '') END AS text FROM posts",
    "doc_hash_ids": f"SELECT id, 'doc-' || md5(regexp_replace(regexp_replace(plain_text, '{_CONTROL}', '', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS doc_id FROM posts",
    "blocklist_hits": rf"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(plain_text), '\b{_WORDS}\b', 1))), ',') AS hits FROM posts",
    "first_sentence": rf"SELECT id, CASE WHEN length(s) > 160 THEN left(s, 160) || '…' ELSE s END AS sentence FROM (SELECT id, CASE WHEN regexp_extract(w, '(?s)^(.*?[.!?])(?:\s|$)', 1) = '' THEN w ELSE regexp_extract(w, '(?s)^(.*?[.!?])(?:\s|$)', 1) END AS s FROM (SELECT id, {_STRIPPED} AS w FROM posts))",
    "markdown_cell": r"SELECT id, replace(replace(replace(COALESCE(plain_text, ''), '|', '\|'), chr(13), ''), chr(10), ' ') AS cell FROM posts",
    "truncate": "SELECT id, CASE WHEN length(plain_text) > 30 THEN left(plain_text, 30) || '…' ELSE plain_text END AS label FROM posts",
    "month_bins": f"SELECT id, CAST(CASE WHEN ts IS NOT NULL THEN {_MONTH} ELSE 0 END AS INTEGER) AS bin, CASE WHEN ts IS NOT NULL THEN (m // 12 + 2018) || '-Q' || ((m % 12) // 3 + 1) ELSE '2018-Q1' END AS quarter FROM (SELECT *, CAST({_MONTH} AS BIGINT) AS m FROM (SELECT id, TRY_CAST(created_at AS TIMESTAMP) AS ts FROM topics))",
    "display_names": r"SELECT username, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(username, '[0-9]+$', ''), '[_.\-]+', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') AS name FROM (SELECT DISTINCT username FROM posts)",
    "naive_topk": "SELECT query_id, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, floor(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE score >= 0.2) WHERE rank <= 20",
    "stream_upsert": over("SELECT id, title, views, fetched_at FROM t0"),
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
}
