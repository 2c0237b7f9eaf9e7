"""Intermediate tables in the folder that all executors share.

A job that reuses an expensive result writes it here as Parquet and reads it
back: lineage ends at a committed table, so a lost executor costs one task, not
the whole chain, and no second pass over the texts is needed. The folder is
``spark.checkpoint.dir``; only where that is unset and all tasks run in this process
(tests on one machine) a folder of the local temp directory takes its place. On a
cluster without that setting this is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_tables: list[str] = []


def root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} have no other folder in common")
    return f"file://{tempfile.gettempdir()}/geomill-scratch"


def integer_ids(df: DataFrame, id_col: str) -> None:
    """An error unless the ids are integers."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids in {id_col} have to be integers, not {kind}")


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before; it is deleted when the driver's JVM ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    _tables.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once, return the table read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """The path of a new file in the shared folder."""
    path = f"{new_path(spark, name)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    for part in parts:
        for at in range(0, len(part), 4 << 20):
            out.write(bytearray(part[at : at + (4 << 20)]))
    out.close()
    return path


def local_file(spark: SparkSession, path: str) -> Callable[[], str]:
    """A function that gives a worker a local path of a file: its own if the shared folder is mounted, or else a copy by Spark."""
    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        return lambda: local
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]
    return lambda: SparkFiles.get(name)


def tables() -> list[str]:
    """The paths given out so far and not released."""
    return list(_tables)


def release(spark: SparkSession, paths: list[str], *unless: DataFrame) -> None:
    """Delete these scratch tables, but for those that ``unless`` still reads."""
    needed = "\n".join("\n".join(df.inputFiles()) for df in unless)
    for path in paths:
        if path in _tables and path.rpartition("/")[2] not in needed:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            _tables.remove(path)
