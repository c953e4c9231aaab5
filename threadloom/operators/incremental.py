"""Keeping the graph's tables in step with the corpus: only what changed is retracted and seeded again.

State is a folder of versions, each with relations and a ledger of hashes; a pointer file names the current one. A run
writes relations first, the ledger next and the pointer last, so a run that dies leaves the version before it in force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kg import Extractor, payload_hashes, places, plan, relations, stale
from .views import Corpus

_RELATION = "src string, tgt string, description string, keywords string, weight double, source_id string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, state: str) -> str | None:
    """The version in force, or None before the first run."""
    fs, p = _fs(spark, f"{state}/CURRENT")
    if not fs.exists(p):
        return None
    return spark.read.text(f"{state}/CURRENT").first()[0]


def _point(spark: SparkSession, state: str, version: str) -> None:
    fs, new = _fs(spark, f"{state}/CURRENT.new")
    out = fs.create(new, True)
    out.writeBytes(version)
    out.close()
    _, at = _fs(spark, f"{state}/CURRENT")
    fs.delete(at, False)
    fs.rename(new, at)


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """topic_id, hash of what the version in force was made from."""
    v = current(spark, state)
    return spark.read.parquet(f"{state}/{v}/ledger") if v else spark.createDataFrame([], "topic_id long, hash string")


def recorded(spark: SparkSession, state: str) -> DataFrame:
    """The relations of the version in force."""
    v = current(spark, state)
    return spark.read.parquet(f"{state}/{v}/relations") if v else spark.createDataFrame([], _RELATION)


def sync(corpus: Corpus, state: str, extract: Extractor | None = places) -> DataFrame:
    """Brings the state up to the corpus; returns topic_id, action of every topic (GONE for those that left).

    Topics with an unchanged hash keep their recorded relations; those of all others are replaced. Nothing is written
    when nothing changed.
    """
    spark = corpus.spark
    hashes, old = payload_hashes(corpus), ledger(spark, state)
    actions = plan(hashes, old).unionByName(old.join(hashes, "topic_id", "left_anti").select("topic_id", F.lit("GONE").alias("action")))
    if actions.where("action <> 'SKIP'").isEmpty():
        return actions
    version = uuid.uuid4().hex
    keep = actions.where("action = 'SKIP'").select(F.concat(F.lit("topic-"), F.col("topic_id").cast("string")).alias("source_id"))
    kept = recorded(spark, state).join(keep, "source_id", "left_semi")
    fresh = relations(corpus, extract).join(keep, "source_id", "left_anti")
    kept.select("src", "tgt", "description", "keywords", "weight", "source_id").unionByName(fresh).write.parquet(f"{state}/{version}/relations")
    actions.write.parquet(f"{state}/{version}/actions")
    hashes.write.parquet(f"{state}/{version}/ledger")
    _point(spark, state, version)
    return spark.read.parquet(f"{state}/{version}/actions")


def retracted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, tgt) that a sync dropped."""
    return stale(before, after)
