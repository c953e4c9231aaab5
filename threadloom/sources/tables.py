"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table name of the folder sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by their exact names, whatever others there are and however those are spelt."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def latest(df: DataFrame, key: str, order: str, tie: list[str]) -> DataFrame:
    """Of each key the row with the greatest order (null least); of equal ones the row with the greatest hash of the columns tie.

    Only keys that occur more than once are looked up, by (order, hash) alone, so that the wide columns are not aggregated;
    the adaptive planner broadcasts that table if it is small and else merges. Rows that agree in order and in tie stay, all of them.
    """
    rank = F.struct(F.col(order).alias("o"), F.xxhash64(*tie).alias("h"))
    best = df.groupBy(F.col(key).alias("_k")).agg(F.max(rank).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    joined = df.join(best, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.where(F.col("_n").isNull() | rank.eqNullSafe(F.col("_best"))).drop("_k", "_best", "_n")
