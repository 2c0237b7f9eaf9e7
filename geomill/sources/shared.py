"""Tables that a job writes and reads again, in the folder that all executors share.

The folder is ``spark.checkpoint.dir``; only where that is unset and all tasks run in this
process is a local temp folder taken. A written table ends lineage: a lost executor costs
a task, not the chain before it.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} have no other folder in common")
    return f"file://{tempfile.gettempdir()}/geomill-shared"


def place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path's file system and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, deleted when the driver's JVM ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = place(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that was written once."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = place(spark, path)
    fs.delete(at, True)
