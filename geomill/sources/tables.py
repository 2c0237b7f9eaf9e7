"""Tables by path."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Files beside a table that aren't rows of it.
NOT_ROWS = r"(\.keys|_checkpoint)\.parquet$"


def load(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet, CSV (all columns text) or JSON lines, by the name's ending; the projection and the filter reach the scan."""
    kind = path.rstrip("/*").rpartition(".")[2].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"no table format is known for .{kind} files: {path}")
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def load_all(spark: SparkSession, paths: list[str], output: str | None = None) -> DataFrame:
    """One scan of several Parquet tables, with ``source_path``, without companions and the job's own output."""
    df = spark.read.option("mergeSchema", True).parquet(*[p for p in paths if p != output]).withColumn("source_path", F.input_file_name())
    return df.where(~F.regexp_like("source_path", F.lit(NOT_ROWS)))


def save(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), level: int = 3, dictionary: bool = True) -> None:
    """By the name's ending; Parquet with zstd at a level, its columns by dictionary or not. Embeddings go to a table of their own, ``<path>.embeddings``."""
    kind = path.rpartition(".")[2].lower()
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    elif kind == "parquet":
        from geomill.operators.maintain import decouple

        base = df
        options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.enable.dictionary": str(dictionary).lower()}
        if "embedding" in df.columns:
            _, vectors, _ = decouple(df)
            base = df.drop("embedding")
            vectors.write.mode(mode).options(**options).option("parquet.enable.dictionary", "false").parquet(path + ".embeddings")
        base.write.mode(mode).options(**options).partitionBy(*partition_by).parquet(path)
    else:
        raise ValueError(f"no table format is known for .{kind} files: {path}")


def scan_cells(rows: DataFrame, active: DataFrame, cell: str = "H3_Cell") -> DataFrame:
    """The rows of active cells: a semi-join that Spark broadcasts, and pushes into partitions, when the cells are few."""
    return rows.join(active.select(cell).where(F.col(cell).isNotNull()).distinct(), cell, "left_semi").select(rows.columns)


def batches(rows: DataFrame, size: int = 10_000):  # noqa: ANN201
    """Lists of at most size rows, fetched partition by partition."""
    from itertools import batched

    yield from map(list, batched(rows.toLocalIterator(prefetchPartitions=True), size))


def raster(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of an Esri ASCII grid: the cells as rows; ``raster_header`` has its place."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\r?\n").alias("lines"))
    body = F.filter("lines", lambda line: (F.trim(line) != "") & ~F.regexp_like(line, F.lit(r"^\s*[A-Za-z]")))
    rows = lines.select(F.posexplode(body).alias("row", "line"))
    return rows.select("row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v")).select("row", "col", F.col("v").try_cast("double").alias("value"))


def raster_header(spark: SparkSession, path: str) -> dict[str, float]:
    """The header fields of an Esri ASCII grid, lower-cased."""
    head = spark.read.text(path).where(F.regexp_like("value", F.lit(r"^\s*[A-Za-z]"))).limit(16).collect()
    return {k.lower(): float(v) for k, v in (r.value.split()[:2] for r in head)}


def polygons(spark: SparkSession, path: str, name: str = "NAME", continent: str = "CONTINENT") -> DataFrame:
    """name, continent, ring (the outer one) and rings (with the holes) of a GeoJSON feature collection: polygons, and each part of multipolygons. Property names are compared without case."""
    shape = "features array<struct<properties map<string, string>, geometry struct<type string, coordinates string>>>"
    ring = "array<array<array<double>>>"
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    prop = lambda n: F.element_at(F.map_filter(F.transform_keys("f.properties", lambda k, _: F.upper(k)), lambda k, _: k == n.upper()), n.upper())
    shapes = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", ring))).otherwise(F.from_json("f.geometry.coordinates", f"array<{ring}>"))
    return f.select(prop(name).alias("name"), prop(continent).alias("continent"), F.explode(shapes).alias("p")).select("name", "continent", F.col("p")[0].alias("ring"), F.col("p").alias("rings"))


def polygon_boxes(shapes: DataFrame) -> DataFrame:
    """name, south, north, west, east and WKT of each polygon, holes included."""
    lat, lon = F.transform("ring", lambda p: p[1]), F.transform("ring", lambda p: p[0])
    text = lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    wkt = F.concat(F.lit("POLYGON("), F.array_join(F.transform(F.col("rings") if "rings" in shapes.columns else F.array("ring"), text), ", "), F.lit(")"))
    return shapes.select("name", F.array_min(lat).alias("south"), F.array_max(lat).alias("north"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), wkt.alias("wkt"))


def with_clusters(photos: DataFrame, sidecar: DataFrame, lead: str = "photos") -> DataFrame:
    """photos with cluster columns by key, all photos kept; with lead='sidecar' all sidecar rows kept."""
    from geomill.operators.maintain import with_key

    p, s = with_key(photos), with_key(sidecar)
    more = [c for c in s.columns if c == "photo_key" or c not in p.columns]
    if lead == "sidecar":
        extra = [c for c in p.columns if c == "photo_key" or c not in s.columns]
        return s.join(p.select(extra), "photo_key", "left")
    rest = [c for c in more if c != "photo_key"]
    # of several rows of a key one whole row
    one = s.select(more).groupBy("photo_key").agg(F.min(F.struct(*rest)).alias("__row")).select("photo_key", "__row.*") if rest else s.select("photo_key").distinct()
    return p.join(one, "photo_key", "left")


def sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a query over SQLite files, each of which is read in its task: caches of verdicts and the like."""
    names = [f.name for f in StructType.fromDDL(schema)]
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def rows(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column(0):
                with closing(sqlite3.connect(":memory:")) as base:
                    base.deserialize(content.as_py())
                    found = base.execute(query)
                    while part := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def logged_boxes(spark: SparkSession, path: str) -> DataFrame:
    """west, south, east, north of ``lon,lat,lon,lat`` lines; NUL bytes go, other lines fall out."""
    parts = F.split(F.translate("value", "\x00", ""), ",")
    number: list[Column] = [F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return spark.read.text(path).where(F.size(parts) == 4).select(*number).dropna()


def point_metadata(lines: DataFrame, path_col: str, value_cols: list[str]) -> DataFrame:
    """point_id (eight digits in a path) and its values; of several the row with the largest row_number holds."""
    pid = F.regexp_extract(path_col, r"(\d{8})", 1)
    return lines.withColumn("point_id", pid).where("point_id <> ''").groupBy("point_id").agg(*[F.max_by(c, "row_number").alias(c) for c in value_cols])


def image_index(files: DataFrame) -> DataFrame:
    """key, path: of each way to name an image file (name, stem, folder/name, folder/stem) the first path."""
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    names = F.array(name, stem, F.concat_ws("/", folder, name), F.concat_ws("/", folder, stem))
    return files.select(F.explode(F.array_distinct(names)).alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"))


def resolve_images(photos: DataFrame, index: DataFrame) -> DataFrame:
    """photos with ``image_path`` by platform and id, by id, or by the last part of the address; else null. One join: the candidates as rows."""
    from geomill.functions import keys

    pid = F.lower(keys.clean_photo_id(F.col("Photo_ID")))
    last = F.lower(F.element_at(F.split(F.substring_index("Image_URL", "?", 1), "/"), -1))
    wanted = F.array(F.concat_ws("/", F.lower("Platform"), pid), pid, last, F.regexp_replace(last, r"\.[^.]*$", ""))
    asked = photos.select("photo_key", F.posexplode(wanted).alias("pos", "key")).where("key is not null and key <> ''")
    found = asked.join(index, "key").groupBy("photo_key").agg(F.min_by("path", "pos").alias("image_path"))
    return photos.join(found, "photo_key", "left")
