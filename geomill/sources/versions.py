"""Several tables that change in lockstep: one commit for all, readers pinned to a version.

Under a root, ``data/<table>/<commit>`` holds what each commit wrote, and
``versions/<number>.json`` names, for each table of that version, its schema and the
folders that make it up. A commit writes all its folders first; the version comes into
being by one rename, which fails if that number is there already. A job that is killed
before leaves folders that no version names, so readers still see the old version of
every table; a reader that has a version keeps it whatever is committed later. What
moves through the driver is the manifest: a path for each commit that is still in use.

Defined cases: a table that a commit doesn't name stays as it is; an appended table may
bring new columns, which are null in older rows; committing no row makes a version all
the same; a table that a version hasn't got is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from geomill.sources import shared


class Conflict(RuntimeError):
    """Another job has committed since the version that this one started from."""


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = shared.place(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions there are, in order."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{root}/versions") if n.endswith(".json")]


def latest(spark: SparkSession, root: str) -> int:
    """The newest version; 0 before the first commit."""
    return max(numbers(spark, root), default=0)


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    if version == 0:
        return {}
    return json.loads(spark.read.text(f"{root}/versions/{version:012d}.json", wholetext=True).first()["value"])


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table at a version, by default the newest."""
    version = latest(spark, root) if version is None else version
    entry = manifest(spark, root, version).get(table)
    if entry is None:
        raise LookupError(f"version {version} of {root} has no table {table}")
    return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*[f"{root}/{p}" for p in entry["paths"]])


def _merged(old: dict | None, new: StructType, path: str) -> dict:
    if old is None:
        return {"schema": new.jsonValue(), "paths": [path]}
    known = StructType.fromJson(old["schema"])
    for f in new:
        if f.name in known.names and known[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} is {known[f.name].dataType.simpleString()} in the table and {f.dataType.simpleString()} in what is appended")
    fields = [*known, *[f for f in new if f.name not in known.names]]
    return {"schema": StructType(fields).jsonValue(), "paths": [*old["paths"], path]}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], append: bool = False, base: int | None = None) -> int:
    """Writes all tables, then makes the next version of them at once; its number.

    base: the version that the tables were made from (the newest, if not given). If another
    job commits in between, nothing changes and ``Conflict`` is raised.
    """
    base = latest(spark, root) if base is None else base
    after = dict(manifest(spark, root, base))
    own = uuid.uuid4().hex
    for name, df in tables.items():
        after[name] = _merged(after.get(name) if append else None, df.schema, f"data/{name}/{own}")
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{root}/data/{name}/{own}")
    _publish(spark, root, base + 1, json.dumps(after))
    return base + 1


def _publish(spark: SparkSession, root: str, version: int, text: str) -> None:
    fs, folder = shared.place(spark, f"{root}/versions")
    fs.mkdirs(folder)
    _, draft = shared.place(spark, f"{root}/versions/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = shared.place(spark, f"{root}/versions/{version:012d}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, none)  # fails if the version is there
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"version {version} of {root} was committed by another job") from None
        raise


def tidy(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all but the newest ``keep`` versions, and the folders that these don't name; their paths. No job may be writing, and no reader hold an older version."""
    all_ = numbers(spark, root)
    used = {p for v in all_[-keep:] for entry in manifest(spark, root, v).values() for p in entry["paths"]}
    for v in all_[:-keep]:
        shared.delete(spark, f"{root}/versions/{v:012d}.json")
    gone = [p for t in _names(spark, f"{root}/data") for c in _names(spark, f"{root}/data/{t}") if (p := f"data/{t}/{c}") not in used]
    for p in gone:
        shared.delete(spark, f"{root}/{p}")
    return gone
