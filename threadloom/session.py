"""Session set-up and the one way in which the library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings every plan of this library is written for.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "threadloom", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that their Python workers can import it from anywhere."""
    sc = spark.sparkContext
    if not getattr(sc, "_threadloom_shipped", False):
        root, at = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="threadloom-")) / "threadloom.zip"
        atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))
        sc._threadloom_shipped = True
    return spark


def _shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="threadloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, below one of the application, which is removed when the application ends."""
    sc = spark.sparkContext
    folder = f"{_shared_dir(spark)}/threadloom/{sc.applicationId}"
    if getattr(sc, "_threadloom_folder", None) != folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._threadloom_folder = folder
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df with the place of each row, from 1, in a total order. No task sees more than a range of the rows.

    Rows are parted into ranges, sorted and counted within them; a running sum of the counts, a row a range, does the rest.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranges.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), "numbered")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))
    return rows.join(starts, "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: later jobs neither recompute it nor depend on any executor."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
