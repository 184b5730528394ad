"""Spark session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "casebook", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="casebook-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Intermediate tables that this process has made.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table, readable by every executor."""
    _MADE.append(f"{shared_dir(spark)}/casebook/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once no result that reads them is needed; how many there were."""
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder, and read it back.

    It is computed once, survives the loss of executors, and its size on disk lets
    Spark decide whether a join may broadcast it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
