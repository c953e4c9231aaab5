"""What an explorer asks of the graph: tables, panels, windows of time, contexts of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import adjacency, degrees
from .kg import topic_name
from .views import Corpus

#: Rows of a table at most.
TABLE = 500


def node_table(nodes: DataFrame, edges: DataFrame, term: str = "", limit: int = TABLE) -> DataFrame:
    """Nodes whose name, type or description holds a term, case ignored, those of most edges first."""
    d = degrees(nodes, edges).join(nodes.select("name", "description"), "name")
    low = term.lower()
    hit = F.lower("name").contains(low) | F.lower("entity_type").contains(low) | F.lower(F.coalesce("description", F.lit(""))).contains(low)
    return d.where(hit).orderBy(F.desc("degree"), "name").select("name", "entity_type", "degree", X.truncated(F.col("description"), 240).alias("description")).limit(limit)


def connections(nodes: DataFrame, edges: DataFrame, name: str, limit: int = TABLE) -> DataFrame:
    """A node's neighbours with the first keyword and the weight of the edge to each, the heaviest first."""
    e = edges.where((F.col("a") == name) | (F.col("b") == name))
    first = F.trim(F.get(F.split(F.replace(F.col("keywords"), F.lit("<SEP>"), F.lit(",")), ","), 0))
    near = e.select(F.when(F.col("a") == name, F.col("b")).otherwise(F.col("a")).alias("name"), first.alias("phrase"), "weight")
    return near.join(nodes.select("name", "entity_type"), "name").orderBy(F.desc("weight"), "name").limit(limit)


def within(times: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Edges (a, b, first, last) that a window of month bins touches; edges without a time and open ends pass."""
    after = F.lit(True) if low is None else F.col("last").isNull() | (F.col("last") >= low)
    before = F.lit(True) if high is None else F.col("first").isNull() | (F.col("first") <= high)
    return times.where(after & before)


def search_context(nodes: DataFrame, edges: DataFrame, term: str, kinds: tuple[str, ...]) -> DataFrame:
    """name, role: nodes of some types that hold a term (`match`), and their neighbours of those types that don't (`context`)."""
    some = nodes.where(F.col("entity_type").isin(*kinds)).select("name")
    match = some.where(F.lower("name").contains(term.lower()))
    near = adjacency(edges).join(match.withColumnRenamed("name", "x"), "x", "left_semi").select(F.col("y").alias("name")).distinct()
    context = near.join(some, "name", "left_semi").join(match, "name", "left_anti")
    return match.select("name", F.lit("match").alias("role")).unionByName(context.select("name", F.lit("context").alias("role")))


def topic_index(c: Corpus, longest: int = 4000) -> DataFrame:
    """topic_id, title, created_at, excerpt, posts: what a preview shows; blank posts are left out, long ones cut, a missing time is that of the first post."""
    p = c.posts_text.where("trim(plain_text) <> ''").select("topic_id", "post_number", "post_id", "created_at", "username", X.truncated(F.col("plain_text"), longest).alias("text"))
    shown = p.groupBy("topic_id").agg(F.min(F.struct("post_number", "post_id", "created_at", "text")).alias("f"), F.count("*").alias("posts"))
    t = c.topics_raw.select(F.col("id").alias("topic_id"), topic_name().alias("title"), F.col("created_at").try_cast("timestamp_ntz").alias("at"))
    return t.join(shown, "topic_id", "left").select("topic_id", "title", F.coalesce("at", "f.created_at").alias("created_at"), X.truncated(F.col("f.text"), 240).alias("excerpt"), F.coalesce("posts", F.lit(0)).alias("posts"))


def first_mentions(df: DataFrame, key: str, listed: str, mark: str) -> DataFrame:
    """key, value, place: the values of a marked list, each once, by where it first stands."""
    parts = df.select(key, F.posexplode(F.split(listed, mark)).alias("place", "v")).select(key, "place", F.trim("v").alias("value")).where("value <> ''")
    return parts.groupBy(key, "value").agg(F.min("place").alias("place"))


def highlighted(paths: DataFrame) -> DataFrame:
    """name, path_no of the nodes on some paths (path_no, nodes); a node on several is the first one's."""
    return paths.select("path_no", F.explode("nodes").alias("name")).groupBy("name").agg(F.min("path_no").alias("path_no"))


def chunk_names(chunks: DataFrame) -> DataFrame:
    """source_id of each chunk (topic_id, chunk_no, ...): the first has the topic's own, the others `-p1`, `-p2`, …"""
    tid = F.concat(F.lit("topic-"), F.col("topic_id").cast("string"))
    return chunks.withColumn("source_id", F.when(F.col("chunk_no") == 0, tid).otherwise(F.concat(tid, F.lit("-p"), F.col("chunk_no").cast("string"))))
