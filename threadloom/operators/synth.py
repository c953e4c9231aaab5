"""A forum made up from a seed: users, topics and posts of any size, each row from hashes of its own number.

Rows don't depend on each other's order or on the number of partitions, so the same seed gives the same forum on any
cluster. Activity of users follows a power law, half of the topics fall within three days of a release, a tenth have no
reply, and most replies answer the first post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: users, topics and mean replies of a topic by scale.
SCALES = {"tiny": (10, 30, 3), "small": (30, 150, 4), "medium": (80, 500, 4), "large": (200, 2000, 5)}
CORE, OPTIONAL = ("Help", "Ideas", "Reports"), ("Showcase", "Guides", "Events", "Off Topic")
SUBJECTS, STATES = ("gate", "lantern", "ferry", "orchard", "kiln", "compass"), ("sticks", "glows", "vanishes", "repeats", "slows down")
ADJECTIVES, NOUNS = ("amber", "quiet", "brisk", "pale", "stout", "keen"), ("heron", "otter", "badger", "finch", "marten", "newt")
START, DAYS, RELEASES = "2024-01-01", 365, (40, 130, 220, 310)


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A number from 0 to 1 that depends on seed, salt and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) / float(1 << 30)


def chosen(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def users(spark: SparkSession, scale: str = "tiny", seed: int = 42) -> DataFrame:
    """user_id, username, role, weight; the first is the admin, the second a moderator."""
    i = F.col("id")
    name = F.concat(chosen(ADJECTIVES, uniform(seed, "adjective", i)), F.lit("_"), chosen(NOUNS, uniform(seed, "noun", i)), i.cast("string"))
    weight = F.pow(1 - uniform(seed, "weight", i), F.lit(-1 / 1.16))
    return spark.range(SCALES[scale][0]).select(i.alias("user_id"), name.alias("username"), F.when(i == 0, "admin").when(i == 1, "moderator").otherwise("member").alias("role"), weight.alias("weight"))


def _author(n: int, u: Column) -> Column:
    """A user number, low ones far more often."""
    return F.least(F.floor(F.pow(u, F.lit(2.5)) * n), F.lit(n - 1)).cast("long")


def topics(spark: SparkSession, scale: str = "tiny", seed: int = 42) -> DataFrame:
    """topic_id, title, category, tags, author, created_at, replies."""
    n_users, n, mean = SCALES[scale]
    i = F.col("id")
    u = lambda salt: uniform(seed, salt, i)
    release = F.element_at(F.array(*map(F.lit, RELEASES)), (F.floor(u("release") * len(RELEASES)) + 1).cast("int"))
    day = F.when(u("near") < 0.5, release + u("offset") * 6 - 3).otherwise(u("day") * DAYS)
    category = F.when(u("core") < 0.75, chosen(CORE, u("category"))).otherwise(chosen(OPTIONAL, u("category")))
    title = F.concat(F.lit("The "), chosen(SUBJECTS, u("subject")), F.lit(" "), chosen(STATES, u("state")))
    tags = F.array_distinct(F.transform(F.sequence(F.lit(1), (F.floor(u("tags") * 4) + 1).cast("int")), lambda k: F.concat(chosen(SUBJECTS, uniform(seed, "tag", i, k)), F.lit("-"), chosen(STATES[:2], uniform(seed, "axis", i, k)))))
    replies = F.when(u("silent") < 0.1, 0).otherwise(F.floor(-F.log(1 - u("replies") * 0.999) * mean) + 1)
    at = F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(secs=F.round(day * 86400).cast("decimal(18,6)"))
    return spark.range(n).select(i.alias("topic_id"), title.alias("title"), category.alias("category"), tags.alias("tags"), _author(n_users, u("author")).alias("author"), at.alias("created_at"), replies.cast("int").alias("replies"))


def posts(spark: SparkSession, scale: str = "tiny", seed: int = 42) -> DataFrame:
    """topic_id, post_number, author, created_at, reply_to, quotes, solved; replies come 5 minutes to 10 days after the first post."""
    n_users = SCALES[scale][0]
    t = topics(spark, scale, seed).select("topic_id", "category", "author", "created_at", "replies", F.explode(F.sequence(F.lit(1), F.col("replies") + 1)).alias("post_number"))
    k = (F.col("topic_id"), F.col("post_number"))
    u = lambda salt: uniform(seed, salt, *k)
    first = F.col("post_number") == 1
    delay = 5 + (F.col("post_number") - 1 + u("delay")) / (F.col("replies") + 1) * (14400 - 5)
    at = F.when(first, F.col("created_at")).otherwise(F.col("created_at") + F.make_dt_interval(mins=F.floor(delay).cast("int")))
    return t.select(
        "topic_id", "post_number", F.when(first, F.col("author")).otherwise(_author(n_users, u("who"))).alias("author"), at.alias("created_at"),
        F.when(~first, F.when(u("to") < 0.8, 1).otherwise(F.greatest(F.lit(1), F.floor(u("which") * F.col("post_number"))))).cast("int").alias("reply_to"),
        (~first & (u("quote") < 0.2)).alias("quotes"), (~first & (F.col("post_number") == F.col("replies") + 1) & (F.col("category") == "Help") & (u("solved") < 0.15)).alias("solved"),
    )


def extension(spark: SparkSession, scale: str = "tiny", seed: int = 42, new: int = 10) -> tuple[DataFrame, DataFrame]:
    """(topics, posts) that a forum gets after its end: `new` topics of the next 1 to 30 days, and replies to topics of before, the later ones more often."""
    n_users, n, _ = SCALES[scale]
    i, end = F.col("id"), F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(days=F.lit(DAYS))
    u = lambda salt: uniform(seed, "more " + salt, i)
    at = end + F.make_dt_interval(mins=F.floor(1440 * (1 + u("day") * 29)).cast("int"))
    title = F.concat(F.lit("The "), chosen(SUBJECTS, u("subject")), F.lit(" "), chosen(STATES, u("state")), F.lit(" again"))
    t = spark.range(n, n + new).select(i.alias("topic_id"), title.alias("title"), chosen(CORE, u("category")).alias("category"), _author(n_users, u("author")).alias("author"), at.alias("created_at"))
    last = topics(spark, scale, seed).select("topic_id", (F.col("replies") + 1).alias("last"))
    replies = spark.range(new).select(F.floor(F.sqrt(u("which")) * n).alias("topic_id"), _author(n_users, u("who")).alias("author"), at.alias("created_at"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("created_at", "author"))
    p = replies.join(last, "topic_id").select("topic_id", (F.col("last") + place).alias("post_number"), "author", "created_at")
    first = t.select("topic_id", F.lit(1).alias("post_number"), "author", "created_at")
    return t, first.unionByName(p.withColumn("post_number", F.col("post_number").cast("int")))
