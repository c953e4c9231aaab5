"""Structured Streaming: upserts of topics and windows over events.

State and progress live in a checkpoint folder that the caller names, or in the shared one; a batch is written before the
stream's progress is, so that a restart repeats it and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import TOPIC_ORDER, newest
from ..session import shared_path


def _stream(spark: SparkSession, source: str) -> DataFrame:
    """A stream of the parquet files of a folder, or of a single file."""
    schema = spark.read.parquet(source).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def upsert_topics(spark: SparkSession, source: str, at: str | None = None) -> DataFrame:
    """The latest crawl of each topic from a folder or file of crawls, read as a stream to its present end.

    Each batch is reduced to the latest row of each topic and written as a version of its own, named by the batch; the
    state is the latest of all versions. A whole topic replaces the one before it.
    """
    at = at or shared_path(spark, "topics")

    def write(batch: DataFrame, number: int) -> None:
        newest(batch, "id", TOPIC_ORDER).write.mode("overwrite").parquet(f"{at}/versions/batch={number}")

    _stream(spark, source).writeStream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return newest(spark.read.parquet(f"{at}/versions").drop("batch"), "id", TOPIC_ORDER)


def tumbling(spark: SparkSession, source: str, width: str = "1 hour", late: str = "1 day", at: str | None = None) -> DataFrame:
    """window_start, event_type, events, value: events in windows of their own time, counted as a stream to its present end."""
    at = at or shared_path(spark, "events")
    events = _stream(spark, source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = events.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    rows = counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "cents")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/windows/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = spark.read.parquet(f"{at}/windows")
    last = found.groupBy("window_start", "event_type").agg(F.max_by(F.struct("events", "cents"), "batch").alias("r"))
    return last.select("window_start", "event_type", "r.events", "r.cents")
