"""A forum corpus as a folder: topic documents, categories and graph files.

    topics/<id>.json        one topic an object, its posts and tags nested
    categories.json         {"categories": [...]}; may be missing
    index.json              a short row for each topic
    graph/*.graphml         nodes and edges with keyed data

Schemas are given, not inferred, so a field that a file lacks is null and mixed tags stay as they are. Files that hold no
JSON object give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_text

POST = "struct<id: bigint, post_number: bigint, username: string, display_name: string, created_at: string, updated_at: string, cooked: string, plain_text: string, like_count: bigint, reply_count: bigint, reply_to_post_number: bigint, quote_count: bigint, reads: bigint>"
TOPIC = (
    "id bigint, title string, slug string, category_id bigint, category_name string, created_at string, last_posted_at string, bumped_at string, views bigint, like_count bigint, posts_count bigint, reply_count bigint, "
    f"pinned boolean, closed boolean, archived boolean, fetched_at string, tags array<string>, posts array<{POST}>, _bad string"
)
CATEGORY = "struct<id: bigint, name: string, slug: string, description: string, topic_count: bigint, post_count: bigint, color: string, parent_category_id: bigint, subcategory_ids: array<bigint>>"
#: Columns of the index of a corpus.
INDEX = ("id", "title", "category_id", "category_name", "created_at", "last_posted_at", "bumped_at", "posts_count", "views", "like_count", "tags")


class NoCorpus(FileNotFoundError):
    """The folder holds no topics."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each topic file; raises NoCorpus where there is none. Tags keep their JSON text."""
    if not _exists(spark, f"{folder}/topics/*.json"):
        raise NoCorpus(f"no topics in {folder}")
    read = spark.read.schema(TOPIC).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/topics")
    return read.where("_bad IS NULL AND id IS NOT NULL").drop("_bad")


def topics(docs: DataFrame) -> DataFrame:
    """The topics table."""
    return docs.drop("posts")


def posts(docs: DataFrame) -> DataFrame:
    """The posts table; topics without posts give no row. A post without plain text has that of its markup."""
    p = docs.select(F.col("id").alias("topic_id"), F.explode("posts").alias("p")).where("p IS NOT NULL").select("topic_id", "p.*")
    return p.withColumn("plain_text", F.coalesce("plain_text", html_text("cooked")))


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """The categories table, empty where the file is missing."""
    if not _exists(spark, f"{folder}/categories.json"):
        fields = T._parse_datatype_string(CATEGORY)
        return spark.createDataFrame([], fields)
    read = spark.read.schema(f"categories array<{CATEGORY}>").option("multiLine", True).json(f"{folder}/categories.json")
    return read.select(F.explode("categories").alias("c")).select("c.*")


def index(docs: DataFrame) -> DataFrame:
    """The short row of each topic."""
    return docs.select(*INDEX).orderBy("id")


def write_topics(docs: DataFrame, folder: str) -> None:
    """Topic documents as parquet, one version a topic: what is written replaces what was there."""
    docs.write.mode("overwrite").parquet(folder)


_DATA = "array<struct<_key: string, _VALUE: string>>"



def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML: data by the names its keys declare; a node without a type is UNKNOWN, an edge without weight has 1."""
    keys = {(r["_for"], r["_attr.name"]): r["_id"] for r in spark.read.format("xml").option("rowTag", "key").schema("`_id` string, `_for` string, `_attr.name` string").load(path).collect()}
    get = lambda kind, name, default=None: F.coalesce(F.get(F.transform(F.filter("data", lambda d: d["_key"] == keys.get((kind, name), "")), lambda d: d["_VALUE"]), 0), F.lit(default))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {_DATA}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {_DATA}").load(path)
    n = nodes.select(F.col("_id").alias("name"), get("node", "entity_type", "UNKNOWN").alias("entity_type"), get("node", "description").alias("description"), get("node", "source_id").alias("source_id"))
    e = edges.select(
        F.least("_source", "_target").alias("a"), F.greatest("_source", "_target").alias("b"), get("edge", "weight", "1").try_cast("double").alias("weight"),
        get("edge", "keywords").alias("keywords"), get("edge", "description").alias("description"), get("edge", "source_id").alias("source_id"),
    )
    return n, e


def key_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and fields of a JSON file that is one object of objects; value is the fields' schema."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"))
    return read.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def chunk_topics(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id, topic: the topic of each chunk, directly where its document is `topic-<id>`, else by the document's file."""
    by_file = docs.select(F.col("key").alias("full_doc_id"), F.regexp_extract("file_path", r"topic-([0-9]+)", 1).alias("by_file"))
    direct = F.nullif(F.regexp_extract("full_doc_id", r"^topic-([0-9]+)", 1), F.lit(""))
    return chunks.join(by_file, "full_doc_id", "left").select(F.col("key").alias("chunk_id"), F.coalesce(direct, F.nullif("by_file", F.lit(""))).try_cast("bigint").alias("topic_id"))
