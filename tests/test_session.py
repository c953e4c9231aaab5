import pytest
from pyspark.sql import functions as F

from threadloom import session as S
from threadloom.sources import tables


def test_numbers_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 5000, 1, 7).withColumn("k", (F.col("id") * 7919 % 13))
        got = [(r.k, r.id) for r in S.numbered(df, F.desc("k"), F.asc("id")).orderBy("number").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(((i * 7919 % 13, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert S.numbered(spark.range(0), F.col("id")).count() == 0


def test_written_tables(spark):
    df = S.materialize(spark.range(5), "x")
    assert df.count() == 5 and f"threadloom/{spark.sparkContext.applicationId}/x-" in df.inputFiles()[0]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        S._shared_dir(Session())


def test_latest_and_columns(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c"), (None, 1, "d"), (None, 3, "e")], "id long, at int, x string")
    got = sorted((r.id, r.x) for r in tables.latest(df, "id", "at", ["x"]).collect() if r.id)
    assert got == [(1, "b"), (1, "b"), (2, "c")]
    assert [r.x for r in tables.latest(df, "id", "at", ["x"]).where("id IS NULL").collect()] == ["e"]
    odd = spark.createDataFrame([(1, 2)], "id int, ID int")
    assert tables.columns(odd, "id").first().id == 1 and tables.columns(odd, "ID").first()[0] == 2
