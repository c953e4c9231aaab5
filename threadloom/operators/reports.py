"""Canned queries and the report pack over the forum's relations.

Every top-k report orders ties by a unique key and takes its limit as a parameter. Averages are rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import Corpus

LIMIT = 30


def half_up(x: Column, digits: int = 1) -> Column:
    """x rounded half up, by floor alone, so that every engine agrees."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def tags_distribution(c: Corpus) -> DataFrame:
    """Topics of each label; tags without one count under null."""
    return c.topic_tags.groupBy("tag_label").agg(F.count("*").alias("topics")).orderBy(F.desc("topics"), F.asc_nulls_last("tag_label")).limit(LIMIT)


def users_top(c: Corpus) -> DataFrame:
    found = c.posts.groupBy("username").agg(F.count("*").alias("posts"), F.sum("like_count").alias("likes"), F.sum("reads").alias("reads"), F.count_distinct("topic_id").alias("topics"))
    return found.orderBy(F.desc("posts"), F.asc_nulls_last("username")).limit(LIMIT)


def categories_breakdown(c: Corpus) -> DataFrame:
    return c.topics.groupBy("category").agg(
        F.count("*").alias("topics"), F.sum("posts_count").alias("posts"), F.sum("views").alias("views"), F.sum("like_count").alias("likes"), half_up(F.avg("posts_count")).alias("avg_posts")
    )


def activity_monthly(c: Corpus) -> DataFrame:
    return c.posts.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("posts"), F.count_distinct("username").alias("authors"), F.count_distinct("topic_id").alias("topics"))


def unanswered(c: Corpus) -> DataFrame:
    """Open topics with no answer, those most seen first."""
    return c.topics.where("posts_count <= 1 AND NOT closed AND NOT archived").select("id", "title", "category", F.to_date("created_at").alias("created"), "views").orderBy(F.desc_nulls_last("views"), "id").limit(LIMIT)


def search(c: Corpus, term: str) -> DataFrame:
    """Posts that hold a term, case ignored and taken literally, with 150 characters from 60 before its first place on."""
    text, low = F.col("plain_text"), F.lower("plain_text")
    at = F.position(F.lit(term.lower()), low)
    start = F.greatest(F.lit(1), at - 60)
    snippet = F.concat(F.substr(text, start, F.lit(150)), F.when(F.length(text) > 150, "...").otherwise(""))
    return c.posts_text.where(low.contains(term.lower())).select("topic_id", "post_id", "username", F.to_date("created_at").alias("posted"), snippet.alias("snippet")).orderBy(F.desc_nulls_last("posted"), "post_id").limit(LIMIT)


def response_time_by_category(c: Corpus) -> DataFrame:
    hours = F.col("response_seconds") / 3600
    found = c.topic_threads.where("response_seconds IS NOT NULL").groupBy("category")
    return found.agg(F.count("*").alias("answered"), half_up(F.median(hours), 2).alias("median_hours"), half_up(F.min(hours), 2).alias("min_hours"), half_up(F.max(hours), 2).alias("max_hours"))


def top_responder_share(c: Corpus) -> DataFrame:
    """Of each category who answers most, and whether that is three tenths of all answers or more."""
    answers = c.posts.where("post_number > 1 AND username <> 'system'").groupBy("category", "username").agg(F.count("*").alias("replies"))
    best = F.min(F.struct((-F.col("replies")).alias("minus"), "username")).alias("b")
    ranked = answers.groupBy("category").agg(F.sum("replies").alias("total"), best).select("category", "b.username", (-F.col("b.minus")).alias("replies"), "total")
    share = F.col("replies") * 100.0 / F.col("total")
    return ranked.select("category", "username", "replies", "total", half_up(share).alias("share"), (share >= 30).alias("dominant"))


def topic_velocity(c: Corpus) -> DataFrame:
    return c.topics.groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("topics"), F.sum("posts_count").alias("posts"), F.sum("views").alias("views"))


THEMES = ("crash", "slow", "save file", "update", "help", "signal", "bridge", "mod loader", "cache", "manual")


def _themed(c: Corpus) -> DataFrame:
    """Posts by each theme they hold; one pass over the texts, the themes are a fixed list."""
    low = F.lower("plain_text")
    held = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in THEMES]))
    return c.posts_text.select("topic_id", "category", F.explode(held).alias("theme"))


def theme_frequency(c: Corpus) -> DataFrame:
    return _themed(c).groupBy("theme").agg(F.count_distinct("topic_id").alias("topics"), F.count("*").alias("posts"))


def theme_crosstab(c: Corpus) -> DataFrame:
    return _themed(c).groupBy("category", "theme").agg(F.count("*").alias("posts"))


PHRASES = ("no idea", "could explain", "not what i see", "keeps failing", "please tell us", "got nowhere", "has anyone", "why the")


def gap_phrases(c: Corpus) -> DataFrame:
    """Posts that admit a gap, by any of the phrases."""
    low = F.lower("plain_text")
    hit = F.lit(False)
    for p in PHRASES:
        hit = hit | low.contains(p)
    return c.posts_text.where(hit).select("topic_id", "post_id", "username", F.left("plain_text", F.lit(180)).alias("excerpt"))


def engaged_open(c: Corpus) -> DataFrame:
    return c.topics.where("posts_count >= 5 AND NOT closed").select("id", "title", "category", "posts_count", "views").orderBy(F.desc("posts_count"), F.desc_nulls_last("views"), "id").limit(LIMIT)


def recent(c: Corpus, now: str = "2025-06-01 00:00:00", days: int = 30) -> DataFrame:
    """Topics bumped in the days before a moment, which a caller names so that the answer is the same tomorrow."""
    return c.topics.where(F.col("bumped_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))).select("id", "title", "category", "bumped_at")


def co_mention(c: Corpus, a: str, b: str) -> DataFrame:
    low = F.lower("plain_text")
    return c.posts_text.where(low.contains(a.lower()) & low.contains(b.lower())).select("topic_id", "post_id", "username")


def thread_of_topic(c: Corpus, topic: str) -> DataFrame:
    return c.posts.where(F.col("topic_title") == topic).select("topic_id", "post_number", "username", "created_at")


def posts_of_user(c: Corpus, username: str) -> DataFrame:
    return c.posts.where(F.col("username") == username).select("topic_id", "topic_title", "post_id", "post_number")


def topics_of_tag(c: Corpus, label: str) -> DataFrame:
    tagged = c.topic_tags.where(F.col("tag_label") == label).select(F.col("topic_id").alias("id")).distinct()
    return c.topics.join(tagged, "id", "left_semi").select("id", "title", "category", "views")


def topics_of_category(c: Corpus, category: str) -> DataFrame:
    return c.topics.where(F.col("category") == category).select("id", "title", "views", "posts_count")


def delta_topics(c: Corpus, cursor: str) -> DataFrame:
    """Topics bumped or posted to since a cursor."""
    since = F.lit(cursor).cast("timestamp_ntz")
    return c.topics.where((F.col("bumped_at") > since) | (F.col("last_posted_at") > since)).select("id", "title", "bumped_at", "last_posted_at")


def missing_posts(c: Corpus) -> DataFrame:
    """Post numbers that a topic's count promises and that no stored post has."""
    promised = c.topics.where("posts_count >= 1").select(F.col("id").alias("topic_id"), F.explode(F.sequence(F.lit(1).cast("long"), "posts_count")).alias("post_number"))
    return promised.join(c.posts.select("topic_id", "post_number"), ["topic_id", "post_number"], "left_anti")


def category_coverage(c: Corpus) -> DataFrame:
    return c.topics_raw.groupBy(F.coalesce("category_name", F.lit("Unknown")).alias("category")).agg(F.count("*").alias("topics"))


VERSION = r"^20[0-9][0-9][-.․][0-9][0-9]$"


def version_coverage(c: Corpus) -> DataFrame:
    """Topics of each version label, whichever mark separates it."""
    versions = c.topic_tags.where(F.col("tag_label").rlike(VERSION)).select("topic_id", F.regexp_replace("tag_label", "[.․]", "-").alias("version")).distinct()
    return versions.groupBy("version").agg(F.count("*").alias("topics"))


def structure_profile(c: Corpus) -> DataFrame:
    """How many of each structural thing there are."""
    parts = [
        ("topics", c.topics_raw.agg(F.count("*"))), ("posts", c.posts.agg(F.count("*"))), ("categories", c.topics_raw.agg(F.count_distinct("category_name"))),
        ("tags", c.topic_tags.agg(F.count_distinct("tag_label"))), ("users", c.posts.agg(F.count_distinct("username"))),
    ]
    found = None
    for name, df in parts:
        row = df.toDF("n").select(F.lit(name).alias("thing"), F.col("n").cast("long").alias("n"))
        found = row if found is None else found.unionByName(row)
    return found


def top_answers_share_rollup(c: Corpus) -> DataFrame:
    """Posts by category and role, with totals of either and of both."""
    return c.topic_participants.rollup("category", "role").agg(F.sum("posts_in_topic").alias("posts"), F.grouping_id().alias("level"))
