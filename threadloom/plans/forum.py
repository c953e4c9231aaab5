"""Queries over the forum's relations and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as R
from ..operators.views import Corpus
from ..session import ship

TERM, PAIR, CURSOR = "signal", ("bridge", "cache"), "2024-06-01 00:00:00"
TITLE, USER, LABEL, CATEGORY = "Naïve question about the Gakigobiba route editor", "harbour_desk_bot", "noisy-shader-cache", "Bug Yard"


def _of(f: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Corpus(ship(spark), sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topics_view": _of(lambda c: c.topics),
    "posts_view": _of(lambda c: c.posts_text),
    "category_parents_view": _of(lambda c: c.category_parents),
    "topic_tags_view": _of(lambda c: c.topic_tags),
    "topic_summary_view": _of(lambda c: c.topic_summary),
    "topic_participants_view": _of(lambda c: c.topic_participants),
    "topic_threads_view": _of(lambda c: c.topic_threads),
    "user_activity_view": _of(lambda c: c.user_activity),
    "tags_distribution": _of(R.tags_distribution),
    "users_top": _of(R.users_top),
    "categories_breakdown": _of(R.categories_breakdown),
    "activity_monthly": _of(R.activity_monthly),
    "unanswered": _of(R.unanswered),
    "search_snippet": _of(lambda c: R.search(c, TERM)),
    "response_time_by_category": _of(R.response_time_by_category),
    "top_responder_share": _of(R.top_responder_share),
    "topic_velocity": _of(R.topic_velocity),
    "theme_frequency": _of(R.theme_frequency),
    "theme_crosstab": _of(R.theme_crosstab),
    "gap_phrases": _of(R.gap_phrases),
    "engaged_open": _of(R.engaged_open),
    "recent_topics": _of(R.recent),
    "co_mention": _of(lambda c: R.co_mention(c, *PAIR)),
    "entity_thread": _of(lambda c: R.thread_of_topic(c, TITLE)),
    "entity_user_posts": _of(lambda c: R.posts_of_user(c, USER)),
    "entity_tag_topics": _of(lambda c: R.topics_of_tag(c, LABEL)),
    "entity_category_topics": _of(lambda c: R.topics_of_category(c, CATEGORY)),
    "delta_topics": _of(lambda c: R.delta_topics(c, CURSOR)),
    "missing_posts_anti": _of(R.missing_posts),
    "category_coverage": _of(R.category_coverage),
    "version_coverage": _of(R.version_coverage),
    "structure_profile": _of(R.structure_profile),
    "participation_rollup": _of(R.top_answers_share_rollup),
}


def _order(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in columns)


_B = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: The relations, for every query to select from.
RELATIONS = rf"""
t0 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, views DESC NULLS LAST, like_count DESC NULLS LAST, posts_count DESC NULLS LAST, reply_count DESC NULLS LAST, bumped_at DESC NULLS LAST, last_posted_at DESC NULLS LAST) AS rn FROM topics) WHERE rn = 1 AND id IS NOT NULL),
p0 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, like_count DESC NULLS LAST, reads DESC NULLS LAST, reply_count DESC NULLS LAST, quote_count DESC NULLS LAST, plain_text DESC NULLS LAST) AS rn FROM posts) WHERE rn = 1 AND id IS NOT NULL),
cp AS (SELECT id AS parent_id, name AS parent_name, unnest(subcategory_ids) AS child_id FROM categories WHERE len(subcategory_ids) > 0),
vt AS (SELECT t0.id, title, slug, category_id, category_name AS category_raw, COALESCE(cp.parent_name, category_name) AS category, cp.parent_name AS parent_category, TRY_CAST(created_at AS TIMESTAMP) AS created_at, TRY_CAST(last_posted_at AS TIMESTAMP) AS last_posted_at, TRY_CAST(bumped_at AS TIMESTAMP) AS bumped_at, views, like_count, posts_count, reply_count, pinned, closed, archived FROM t0 LEFT JOIN cp ON category_id = child_id),
vp AS (SELECT p0.topic_id, vt.title AS topic_title, vt.category_id, vt.category, vt.parent_category, p0.id AS post_id, post_number, username, display_name, TRY_CAST(p0.created_at AS TIMESTAMP) AS created_at, TRY_CAST(p0.updated_at AS TIMESTAMP) AS updated_at, plain_text, p0.like_count, p0.reply_count, reply_to_post_number, quote_count, reads FROM p0 JOIN vt ON p0.topic_id = vt.id),
g0 AS (SELECT id AS topic_id, title AS topic_title, unnest(tags) AS tag FROM t0),
g1 AS (SELECT topic_id, topic_title, tag, COALESCE(tag LIKE '{{%' AND json_valid(tag), false) AS is_obj FROM g0),
g2 AS (SELECT topic_id, topic_title, is_obj,
  CASE WHEN is_obj THEN TRY_CAST(json_extract_string(tag, '$.id') AS BIGINT) END AS tag_id,
  regexp_replace(CASE WHEN is_obj THEN json_extract_string(tag, '$.name') ELSE tag END, '^{_B}+|{_B}+$', '', 'g') AS tag_name,
  regexp_replace(CASE WHEN is_obj THEN json_extract_string(tag, '$.slug') ELSE tag END, '^{_B}+|{_B}+$', '', 'g') AS tag_slug FROM g1),
vg AS (SELECT topic_id, topic_title, tag_id, tag_name, tag_slug, CASE WHEN NOT is_obj THEN NULLIF(tag_name, '') WHEN tag_slug <> '' AND NOT regexp_matches(tag_slug, '^[0-9]+-tag$') THEN tag_slug ELSE NULLIF(tag_name, '') END AS tag_label FROM g2),
op AS (SELECT topic_id, max(username) AS creator FROM vp WHERE post_number = 1 GROUP BY 1),
ans AS (SELECT v.topic_id, v.post_id, v.post_number, v.username, v.created_at FROM vp v JOIN op USING (topic_id) WHERE v.post_number > 1 AND v.username <> 'system' AND v.username <> op.creator),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY post_number, post_id) AS rn FROM ans) WHERE rn = 1),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC NULLS LAST, post_number DESC, post_id DESC) AS rn FROM ans) WHERE rn = 1),
cnt AS (SELECT topic_id, count(DISTINCT username) AS unique_responders FROM ans GROUP BY 1),
vth AS (SELECT vt.id AS topic_id, title, category, vt.created_at, views, posts_count, op.creator, fst.username AS first_responder, fst.created_at AS first_response_at, (epoch_us(fst.created_at) - epoch_us(vt.created_at)) / 1e6 AS response_seconds, lst.username AS last_responder, lst.created_at AS last_response_at, unique_responders
  FROM vt LEFT JOIN op ON op.topic_id = vt.id LEFT JOIN fst ON fst.topic_id = vt.id LEFT JOIN lst ON lst.topic_id = vt.id LEFT JOIN cnt ON cnt.topic_id = vt.id),
vpa AS (SELECT topic_id, topic_title, category, username, CASE WHEN post_number = 1 THEN 'creator' WHEN username = 'system' THEN 'system' ELSE 'responder' END AS role, count(*) AS posts_in_topic, min(created_at) AS first_post_at, max(created_at) AS last_post_at, CAST(sum(like_count) AS BIGINT) AS likes_received FROM vp GROUP BY 1, 2, 3, 4, 5)
"""


def over(select: str, more: str = "") -> str:
    """SQL of a query over the relations."""
    return f"WITH {RELATIONS}{', ' + more if more else ''} {select}"


def _round(x: str, digits: int = 1) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {float(10**digits)}"


def _contains(text: str) -> str:
    return f"contains(lower(plain_text), '{text.lower()}')"


_THEMED = "th AS (SELECT topic_id, category, theme FROM vp, (VALUES " + ", ".join(f"('{t}')" for t in R.THEMES) + ") AS v(theme) WHERE contains(lower(plain_text), theme))"

SQL: dict[str, str] = {
    "topics_view": over("SELECT * FROM vt"),
    "posts_view": over("SELECT * FROM vp"),
    "category_parents_view": over("SELECT * FROM cp"),
    "topic_tags_view": over("SELECT * FROM vg"),
    "topic_summary_view": over("SELECT vt.*, f.first_poster, COALESCE(l.tags, '') AS tags FROM vt LEFT JOIN (SELECT topic_id, max(username) AS first_poster FROM vp WHERE post_number = 1 GROUP BY 1) f ON f.topic_id = vt.id LEFT JOIN (SELECT topic_id, string_agg(tag_label, ', ' ORDER BY tag_label) AS tags FROM (SELECT DISTINCT topic_id, tag_label FROM vg WHERE tag_label IS NOT NULL) GROUP BY 1) l ON l.topic_id = vt.id"),
    "topic_participants_view": over("SELECT * FROM vpa"),
    "topic_threads_view": over("SELECT * FROM vth"),
    "user_activity_view": over("SELECT username, count(*) AS total_posts, count(DISTINCT topic_id) AS topics_participated, CAST(sum(CASE WHEN post_number = 1 THEN 1 ELSE 0 END) AS BIGINT) AS topics_created, CAST(sum(CASE WHEN post_number > 1 THEN 1 ELSE 0 END) AS BIGINT) AS replies_written, count(DISTINCT CASE WHEN post_number > 1 THEN topic_id END) AS topics_helped, CAST(sum(like_count) AS BIGINT) AS likes_received, CAST(sum(reads) AS BIGINT) AS total_reads, min(created_at) AS first_seen, max(created_at) AS last_seen FROM vp WHERE username <> 'system' GROUP BY 1"),
    "tags_distribution": over("SELECT tag_label, count(*) AS topics FROM vg GROUP BY 1 ORDER BY topics DESC, tag_label NULLS LAST LIMIT 30"),
    "users_top": over("SELECT username, count(*) AS posts, CAST(sum(like_count) AS BIGINT) AS likes, CAST(sum(reads) AS BIGINT) AS reads, count(DISTINCT topic_id) AS topics FROM vp GROUP BY 1 ORDER BY posts DESC, username NULLS LAST LIMIT 30"),
    "categories_breakdown": over(f"SELECT category, count(*) AS topics, CAST(sum(posts_count) AS BIGINT) AS posts, CAST(sum(views) AS BIGINT) AS views, CAST(sum(like_count) AS BIGINT) AS likes, {_round('avg(posts_count)')} AS avg_posts FROM vt GROUP BY 1"),
    "activity_monthly": over("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS posts, count(DISTINCT username) AS authors, count(DISTINCT topic_id) AS topics FROM vp GROUP BY 1"),
    "unanswered": over("SELECT id, title, category, CAST(created_at AS DATE) AS created, views FROM vt WHERE posts_count <= 1 AND NOT closed AND NOT archived ORDER BY views DESC NULLS LAST, id LIMIT 30"),
    "search_snippet": over(f"SELECT topic_id, post_id, username, CAST(created_at AS DATE) AS posted, substring(plain_text, greatest(1, position('{TERM}' IN lower(plain_text)) - 60), 150) || CASE WHEN length(plain_text) > 150 THEN '...' ELSE '' END AS snippet FROM vp WHERE {_contains(TERM)} ORDER BY posted DESC NULLS LAST, post_id LIMIT 30"),
    "response_time_by_category": over(f"SELECT category, count(*) AS answered, {_round('median(response_seconds / 3600)', 2)} AS median_hours, {_round('min(response_seconds / 3600)', 2)} AS min_hours, {_round('max(response_seconds / 3600)', 2)} AS max_hours FROM vth WHERE response_seconds IS NOT NULL GROUP BY 1"),
    "top_responder_share": over(f"SELECT category, username, replies, total, {_round('replies * 100e0 / total')} AS share, replies * 100e0 / total >= 30 AS dominant FROM (SELECT category, username, replies, CAST(sum(replies) OVER (PARTITION BY category) AS BIGINT) AS total, row_number() OVER (PARTITION BY category ORDER BY replies DESC, username) AS rn FROM (SELECT category, username, count(*) AS replies FROM vp WHERE post_number > 1 AND username <> 'system' GROUP BY 1, 2)) WHERE rn = 1"),
    "topic_velocity": over("SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, count(*) AS topics, CAST(sum(posts_count) AS BIGINT) AS posts, CAST(sum(views) AS BIGINT) AS views FROM vt GROUP BY 1"),
    "theme_frequency": over("SELECT theme, count(DISTINCT topic_id) AS topics, count(*) AS posts FROM th GROUP BY 1", _THEMED),
    "theme_crosstab": over("SELECT category, theme, count(*) AS posts FROM th GROUP BY 1, 2", _THEMED),
    "gap_phrases": over("SELECT topic_id, post_id, username, left(plain_text, 180) AS excerpt FROM vp WHERE " + " OR ".join(_contains(p) for p in R.PHRASES)),
    "engaged_open": over("SELECT id, title, category, posts_count, views FROM vt WHERE posts_count >= 5 AND NOT closed ORDER BY posts_count DESC, views DESC NULLS LAST, id LIMIT 30"),
    "recent_topics": over("SELECT id, title, category, bumped_at FROM vt WHERE bumped_at >= TIMESTAMP '2025-06-01 00:00:00' - INTERVAL 30 DAY"),
    "co_mention": over(f"SELECT topic_id, post_id, username FROM vp WHERE {_contains(PAIR[0])} AND {_contains(PAIR[1])}"),
    "entity_thread": over(f"SELECT topic_id, post_number, username, created_at FROM vp WHERE topic_title = '{TITLE}'"),
    "entity_user_posts": over(f"SELECT topic_id, topic_title, post_id, post_number FROM vp WHERE username = '{USER}'"),
    "entity_tag_topics": over(f"SELECT id, title, category, views FROM vt WHERE id IN (SELECT topic_id FROM vg WHERE tag_label = '{LABEL}')"),
    "entity_category_topics": over(f"SELECT id, title, views, posts_count FROM vt WHERE category = '{CATEGORY}'"),
    "delta_topics": over(f"SELECT id, title, bumped_at, last_posted_at FROM vt WHERE bumped_at > TIMESTAMP '{CURSOR}' OR last_posted_at > TIMESTAMP '{CURSOR}'"),
    "missing_posts_anti": over("SELECT a.topic_id, a.post_number FROM (SELECT id AS topic_id, unnest(range(1, posts_count + 1)) AS post_number FROM vt WHERE posts_count >= 1) a WHERE NOT EXISTS (SELECT 1 FROM vp WHERE vp.topic_id = a.topic_id AND vp.post_number = a.post_number)"),
    "category_coverage": over("SELECT COALESCE(category_name, 'Unknown') AS category, count(*) AS topics FROM t0 GROUP BY 1"),
    "version_coverage": over("SELECT version, count(*) AS topics FROM (SELECT DISTINCT topic_id, regexp_replace(tag_label, '[.․]', '-', 'g') AS version FROM vg WHERE regexp_matches(tag_label, '^20[0-9][0-9][-.․][0-9][0-9]$')) GROUP BY 1"),
    "structure_profile": over("SELECT 'topics' AS thing, count(*) AS n FROM t0 UNION ALL SELECT 'posts', count(*) FROM vp UNION ALL SELECT 'categories', count(DISTINCT category_name) FROM t0 UNION ALL SELECT 'tags', count(DISTINCT tag_label) FROM vg UNION ALL SELECT 'users', count(DISTINCT username) FROM vp"),
    "participation_rollup": over("SELECT category, role, CAST(sum(posts_in_topic) AS BIGINT) AS posts, CAST(grouping(category) * 2 + grouping(role) AS BIGINT) AS level FROM vpa GROUP BY ROLLUP (category, role)"),
}
