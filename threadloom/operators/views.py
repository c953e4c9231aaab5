"""The forum's relations, from its stored tables.

Tables hold a row per crawl; each relation is over the latest row of each topic and post. Frames are lazy and narrow:
`posts` has no texts, so that counting neither reads, shuffles nor sorts them; `posts_text` is the same with plain_text.
Null keys form no topic or post; ties are broken by the counters, then by every other short column, last by the text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import tag_fields
from ..sources.tables import table

TOPIC_ORDER = ("fetched_at", "views", "like_count", "posts_count", "reply_count", "bumped_at", "last_posted_at")
POST_ORDER = ("updated_at", "like_count", "reads", "reply_count", "quote_count")
#: The columns that break what ties are left, so that versions that differ in any of them have one order.
POST_TIES = ("topic_id", "post_number", "username", "created_at", "display_name", "reply_to_post_number")


def moment(text: Column) -> Column:
    """A stored time without its offset; null if it is none."""
    return text.try_cast("timestamp_ntz")


def newest(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The latest row of each key."""
    place = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(place)).where("_rn = 1").drop("_rn")


class Corpus:
    """The relations of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def as_of(self, moment: str) -> Corpus:
        """The corpus as it was at a moment (ISO text): without the topics and posts made since."""
        return _Earlier(self.spark, self.sf_dir, moment)

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("categories")

    @cached_property
    def category_parents(self) -> DataFrame:
        """parent_id, parent_name, child_id: the inversion of subcategory_ids."""
        some = self.categories.where("size(subcategory_ids) > 0")
        return some.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), F.explode("subcategory_ids").alias("child_id"))

    @cached_property
    def topics_raw(self) -> DataFrame:
        return newest(self.table("topics"), "id", TOPIC_ORDER).where("id IS NOT NULL")

    @cached_property
    def topics(self) -> DataFrame:
        """17 columns; a subcategory's topic counts under its parent."""
        t = self.topics_raw.alias("t").join(self.category_parents.alias("c"), F.col("t.category_id") == F.col("c.child_id"), "left")
        return t.select(
            "t.id", "t.title", "t.slug", "t.category_id", F.col("t.category_name").alias("category_raw"), F.coalesce("c.parent_name", "t.category_name").alias("category"), F.col("c.parent_name").alias("parent_category"),
            *[moment(F.col(f"t.{c}")).alias(c) for c in ("created_at", "last_posted_at", "bumped_at")], "t.views", "t.like_count", "t.posts_count", "t.reply_count", "t.pinned", "t.closed", "t.archived",
        )

    def _posts(self, *texts: str) -> DataFrame:
        """Each post with what its topic says, and these of its texts."""
        p = newest(self.table("posts"), "id", POST_ORDER + POST_TIES + texts).where("id IS NOT NULL").alias("p")
        t = self.topics.select(F.col("id").alias("topic_id"), F.col("title").alias("topic_title"), "category_id", "category", "parent_category").alias("t")
        return p.join(t, "topic_id").select(
            "topic_id", "t.topic_title", "t.category_id", "t.category", "t.parent_category", F.col("p.id").alias("post_id"), "p.post_number", "p.username", "p.display_name",
            moment(F.col("p.created_at")).alias("created_at"), moment(F.col("p.updated_at")).alias("updated_at"), *[f"p.{c}" for c in texts], "p.like_count", "p.reply_count", "p.reply_to_post_number", "p.quote_count", "p.reads",
        )

    @cached_property
    def posts(self) -> DataFrame:
        """16 columns: each post without its text."""
        return self._posts()

    @cached_property
    def posts_text(self) -> DataFrame:
        """17 columns: each post with its plain_text."""
        return self._posts("plain_text")

    @cached_property
    def topic_tags(self) -> DataFrame:
        """A row for each element of a topic's tags; null elements have null fields."""
        t = self.topics_raw.select(F.col("id").alias("topic_id"), F.col("title").alias("topic_title"), F.explode("tags").alias("tag"))
        return t.select("topic_id", "topic_title", tag_fields(F.col("tag")).alias("f")).select("topic_id", "topic_title", "f.*")

    @cached_property
    def topic_summary(self) -> DataFrame:
        """topics with the first poster and the labels in order, joined; '' without any."""
        first = self.posts.where("post_number = 1").groupBy("topic_id").agg(F.max("username").alias("first_poster"))
        labels = self.topic_tags.where("tag_label IS NOT NULL").groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_set("tag_label")), ", ").alias("tags"))
        t = self.topics.withColumnRenamed("id", "topic_id")
        return t.join(first, "topic_id", "left").join(labels, "topic_id", "left").withColumn("tags", F.coalesce("tags", F.lit(""))).withColumnRenamed("topic_id", "id")

    @cached_property
    def topic_participants(self) -> DataFrame:
        """Who took part in a topic and how: creator, responder or system; a creator who answers has two rows."""
        role = F.when(F.col("post_number") == 1, "creator").when(F.col("username") == "system", "system").otherwise("responder")
        return (
            self.posts.groupBy("topic_id", "topic_title", "category", "username", role.alias("role"))
            .agg(F.count("*").alias("posts_in_topic"), F.min("created_at").alias("first_post_at"), F.max("created_at").alias("last_post_at"), F.sum("like_count").alias("likes_received"))
        )

    @cached_property
    def topic_threads(self) -> DataFrame:
        """Who answered a topic first and last; answers are by others than its creator and the system.

        One aggregate finds the creators, another the answers. The first answer has the least post number, the last the
        greatest time; a topic without a first post has no answers, one without answers nulls.
        """
        p = self.posts.select("topic_id", "post_id", "post_number", "username", "created_at")
        creators = p.where("post_number = 1").groupBy("topic_id").agg(F.max("username").alias("creator"))
        answers = p.where("post_number > 1 AND username <> 'system'").join(creators, "topic_id").where("username <> creator")
        found = answers.groupBy("topic_id").agg(
            F.min(F.struct("post_number", "post_id", "username", "created_at")).alias("first"),
            F.max(F.struct("created_at", "post_number", "post_id", "username")).alias("last"),
            F.count_distinct("username").alias("unique_responders"),
        )
        t = self.topics.select(F.col("id").alias("topic_id"), "title", "category", F.col("created_at").alias("topic_at"), "views", "posts_count")
        return t.join(creators, "topic_id", "left").join(found, "topic_id", "left").select(
            "topic_id", "title", "category", F.col("topic_at").alias("created_at"), "views", "posts_count", "creator", F.col("first.username").alias("first_responder"), F.col("first.created_at").alias("first_response_at"),
            (F.timestamp_diff("MICROSECOND", F.col("topic_at"), F.col("first.created_at")) / 1e6).alias("response_seconds"), F.col("last.username").alias("last_responder"), F.col("last.created_at").alias("last_response_at"), "unique_responders",
        )

    @cached_property
    def user_activity(self) -> DataFrame:
        """What each user but the system did."""
        is_first = F.col("post_number") == 1
        return (
            self.posts.where("username <> 'system'")
            .groupBy("username")
            .agg(
                F.count("*").alias("total_posts"), F.count_distinct("topic_id").alias("topics_participated"), F.sum(F.when(is_first, 1).otherwise(0)).alias("topics_created"), F.sum(F.when(F.col("post_number") > 1, 1).otherwise(0)).alias("replies_written"),
                F.count_distinct(F.when(F.col("post_number") > 1, F.col("topic_id"))).alias("topics_helped"), F.sum("like_count").alias("likes_received"), F.sum("reads").alias("total_reads"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
            )
        )

    def register(self) -> list[str]:
        """All relations as temporary views of the session, for ad-hoc SQL; returns their names."""
        names = ["topics", "posts", "categories", "category_parents", "topic_tags", "topic_summary", "topic_participants", "topic_threads", "user_activity"]
        for name in names:
            getattr(self, "posts_text" if name == "posts" else name).createOrReplaceTempView(name)
        return names


class _Earlier(Corpus):
    def __init__(self, spark: SparkSession, sf_dir: str, moment: str) -> None:
        super().__init__(spark, sf_dir)
        self.moment = moment

    def table(self, name: str) -> DataFrame:
        df = super().table(name)
        return df.where(F.col("created_at") < self.moment) if name in ("topics", "posts") else df
