"""From heterogeneous records to photo rows, and into the photo table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import keys, times
from geomill.sources import shared, versions

CANONICAL = ("Photo_ID", "Platform", "Latitude", "Longitude", "Image_URL", "Captured_At", "License", "photo_key")


def rename_aliases(df: DataFrame) -> DataFrame:
    """Columns under our names; of several aliases of one name the first listed in the table wins."""
    have = {c.lower(): c for c in reversed(df.columns)}
    renames = {}
    for ours, others in keys.ALIASES.items():
        if ours not in df.columns:
            found = next((have[a] for a in others if a in have and have[a] not in renames), None)
            if found:
                renames[found] = ours
    return df.withColumnsRenamed(renames)


# The columns that tell a street-view collection, and what its columns are to us.
STREET_VIEW = ("uuid", "source", "orig_id")
STREET_VIEW_NAMES = {"source": "Platform", "lat": "Latitude", "lon": "Longitude", "orig_id": "Photo_ID", "datetime_local": "Captured_At", "url": "Image_URL"}


def by_shape(df: DataFrame, path: Column | None = None) -> DataFrame:
    """A source under our names, by its shape.

    A street-view collection (uuid, source, orig_id) has its own columns, whatever others of
    our names it carries. Rows of a file, or a platform, called iwildcam are of that platform.
    All else goes by aliases; a platform that is missing is that of the file's name.
    """
    if set(STREET_VIEW) <= set(df.columns):
        renames = {k: v for k, v in STREET_VIEW_NAMES.items() if k in df.columns}
        return df.drop(*renames.values()).withColumnsRenamed(renames)
    df = rename_aliases(df)
    own = F.col("Platform").cast("string") if "Platform" in df.columns else F.lit(None).cast("string")
    camera = F.lower(F.trim(own)) == "iwildcam"
    if path is not None:
        camera = F.coalesce(camera, F.lit(False)) | F.lower(path).contains("iwildcam")
    return df.withColumn("Platform", F.when(camera, "iwildcam").otherwise(own))


def normalize(df: DataFrame, path: Column | None = None) -> DataFrame:
    """The canonical columns of a source: platform (its own, or what the file's name tells), address, licence, key, coordinates as numbers."""
    df = by_shape(df, path)
    has = lambda c: c in df.columns
    text = lambda c: F.col(c).cast("string") if has(c) else F.lit(None).cast("string")
    named = keys.platform_of_path(path) if path is not None else F.lit(None).cast("string")
    platform = F.lower(F.trim(F.when(keys.blank(text("Platform")), named).otherwise(text("Platform"))))
    out = df.select(text("Photo_ID").alias("Photo_ID"), platform.alias("Platform"), *[text(c).alias(c) for c in ("Latitude", "Longitude", "Image_URL", "Captured_At", "License")], *([df["H3_Cell"]] if has("H3_Cell") else []), *([df["embedding"]] if has("embedding") else []))
    p, i = F.col("Platform"), F.col("Photo_ID")
    return out.withColumns(
        {
            "Latitude": F.col("Latitude").try_cast("double"),
            "Longitude": F.col("Longitude").try_cast("double"),
            "Image_URL": keys.image_address(p, keys.clean_photo_id(i), F.col("Image_URL")),
            "Captured_At": times.standard_timestamp(F.col("Captured_At")),
            "License": keys.without_null_words(keys.decode_flickr_license(p, keys.default_license(p, F.col("License")))),
            "Photo_ID": keys.clean_photo_id(i),
            "photo_key": keys.photo_key(p, i),
        }
    )


def with_local_pictures(photos: DataFrame, files: DataFrame, folder: Column) -> DataFrame:
    """photos of an offline copy with ``Image_URL`` by what lies on disk (files: path).

    The listed location beside the table, or in its ``train`` folder, if that file is there;
    else the address, beside the table unless it has a scheme; else the location, there or not.
    """
    at = keys.local_address(F.col("Image_Location"), folder)
    name = F.element_at(F.split(F.col("Image_Location"), "/"), -1)
    tried = F.array(at, F.concat_ws("/", folder, F.lit("train"), name))
    asked = photos.select("photo_key", F.posexplode(tried).alias("__pos", "path")).where("path is not null")
    found = asked.join(files.select("path").distinct(), "path").groupBy("photo_key").agg(F.min_by("path", "__pos").alias("__file"))
    remote = keys.local_address(F.col("Image_URL"), folder) if "Image_URL" in photos.columns else F.lit(None).cast("string")
    address = F.coalesce(F.col("__file"), F.nullif(remote, F.lit("")), at, F.lit(""))
    return photos.join(found, "photo_key", "left").withColumn("Image_URL", address).drop("__file")


def joined_by_uuid(a: DataFrame, b: DataFrame, columns: tuple[str, ...], uuid: str = "uuid") -> DataFrame:
    """What two tables of one collection say of each picture that both have: only these columns are read."""
    of = lambda df: df.select(uuid, *[c for c in columns if c in df.columns])
    return of(a).join(of(b), uuid)


def resume(todo: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], key: str = "photo_key") -> DataFrame:
    """All results of a long job that may have been stopped: rows whose key has none yet are processed and added to the table at path.

    Each call is one committed append: a stopped one leaves nothing, and the next begins where
    the last ended. ``finish`` removes the table when its results are kept elsewhere.
    """
    spark = todo.sparkSession
    done = _saved(spark, path)
    rest = todo if done is None else only_new(todo, done, key)
    process(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def resume_in_lockstep(todo: DataFrame, root: str, process: Callable[[DataFrame], DataFrame], key: str = "photo_key", vector: str = "embedding") -> int:
    """Like ``resume``, with the results in three tables that are never out of step: metadata, embeddings (key, vector) and keys; the version that has them.

    What a call processes is computed once and then split, so the tables have the same keys
    even if ``process`` wouldn't give the same rows again. They appear together in one commit
    (``versions``): a call that is killed, even between two of the tables, leaves the version
    before. A call with nothing left to do commits nothing.
    """
    spark = todo.sparkSession
    base = versions.latest(spark, root)
    rest = todo if base == 0 else only_new(todo, versions.read(spark, root, "keys", base), key)
    made = shared.written(process(rest), "processed")
    if base and made.isEmpty():
        return base
    tables = {"metadata": made.drop(vector), "embeddings": made.select(key, vector), "keys": made.select(key)}
    return versions.commit(spark, root, tables, append=True, base=base)


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None where nothing was committed yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if there else None


def finish(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def concat(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order: the deterministic form of dropping duplicates."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def only_new(df: DataFrame, seen: DataFrame, key: str = "photo_key") -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def replace_cells(old: DataFrame, new: DataFrame, cells: DataFrame | None = None, cell: str = "H3_Cell") -> DataFrame:
    """The table with the rows of the active cells replaced by new ones. Rows without a cell stay. Columns may be added."""
    active = (new if cells is None else cells).select(cell).where(F.col(cell).isNotNull()).distinct()
    kept = old.join(active, cell, "left_anti").select(old.columns)
    p = lambda df: df.withColumn("Platform", F.lower("Platform")) if "Platform" in df.columns else df
    keyed = lambda df: df if "photo_key" in df.columns else df.withColumn("photo_key", keys.photo_key(F.col("Platform"), F.col("Photo_ID")))
    return concat(keyed(p(kept)), keyed(p(new)))


#: The column, and so the folders, of coarse cells.
PART = "part"


def _named(part: Column) -> Column:
    """A folder's name: never to be taken for a number."""
    return F.concat(F.lit("c"), part.cast("string"))


def save_by_cells(rows: DataFrame, path: str, part: Column, mode: str = "errorifexists") -> None:
    """A table with a folder for each coarse cell, large ones in several files; rows without a cell have one of their own."""
    rows.withColumn(PART, _named(part)).hint("rebalance", PART).write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def load_by_cells(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``save_by_cells``: columns that only later rows have are null in others."""
    return spark.read.option("mergeSchema", True).parquet(path)


def upsert_by_cells(spark: SparkSession, path: str, new: DataFrame, part: Callable[[Column], Column], cells: DataFrame | None = None, cell: str = "H3_Cell") -> list[str]:
    """``replace_cells`` on a table in coarse cells, of which only those that hold active cells are read and written; their folders' names.

    part gives a cell's coarse cell (a parent of it). Spark's dynamic partition overwrite
    replaces these folders when the job commits and leaves the others' files alone; a
    coarse cell that has no row left loses its folder right after. An upsert that was
    stopped can simply be repeated. The names of folders touched go through the driver,
    as the table's listing does.
    """
    active = shared.written((new if cells is None else cells).select(cell).where(F.col(cell).isNotNull()).distinct(), "active")
    no_cell = not new.where(F.col(cell).isNull()).isEmpty()
    touched = [r[0] for r in active.select(_named(part(F.col(cell)))).distinct().collect()]
    inside = F.col(PART).isin(touched)
    old = load_by_cells(spark, path).where(inside | F.col(PART).isNull() if no_cell else inside)
    out = shared.written(replace_cells(old.drop(PART), new, active, cell), "upsert")
    save_by_cells(out, path, part(F.col(cell)), mode="overwrite")
    left = {r[0] for r in out.select(_named(part(F.col(cell)))).distinct().collect()}
    for name in touched:
        if name not in left:
            shared.delete(spark, f"{path}/{PART}={name}")
    return sorted(touched) + ["__HIVE_DEFAULT_PARTITION__"] * no_cell


def align_embeddings(photos: DataFrame, embeddings: DataFrame, size: int, key: str = "photo_key", vector: str = "embedding", order: str | None = None) -> DataFrame:
    """Each photo with its vector: of a key's several the first by ``order`` (without that column the smallest by content), zeros where there is none."""
    one = embeddings.groupBy(key).agg((F.min_by(vector, F.struct(order, vector)) if order else F.min(vector)).alias(vector))
    return photos.drop(vector).join(one, key, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), size)))


def derive_representation(embeddings: DataFrame, how: str, other: DataFrame | None = None, key: str = "photo_key", vector: str = "embedding") -> DataFrame:
    """Vectors of another representation: first or second half, the same, or two joined on the keys that both have."""
    from geomill.functions import vectors

    if how == "concat":
        assert other is not None
        b = other.select(key, F.col(vector).alias("__b"))
        return embeddings.join(b, key).withColumn(vector, F.concat(vector, "__b")).drop("__b")
    made = {"first_half": vectors.first_half, "second_half": vectors.second_half, "alias": lambda v: v, "duplicate": lambda v: F.concat(v, v)}[how]
    return embeddings.withColumn(vector, made(F.col(vector)))


def backfill(sources: list[DataFrame], wanted: DataFrame, key: str = "photo_key", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors found, keys still missing); of several sources the last that has a key wins."""
    ranked = concat(*[s.select(key, F.col(vector), F.lit(i).alias("__s")) for i, s in enumerate(sources)])
    best = ranked.groupBy(key).agg(F.max_by(vector, "__s").alias(vector))
    return best.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(best, key, "left_anti")


def update_values(df: DataFrame, lookup: DataFrame, key: list[str], column: str, only: Column | None = None, keep_own: bool = False) -> DataFrame:
    """df with a column overridden from a lookup (or, with keep_own, filled where null) when the key is there and ``only`` holds."""
    one = lookup.groupBy(*key).agg(F.min(column).alias("__new"))
    own = F.col(column)
    value = F.coalesce(own, F.col("__new")) if keep_own else F.coalesce(F.col("__new"), own)
    value = value if only is None else F.when(only, value).otherwise(own)
    return df.join(one, key, "left").withColumn(column, value).select(df.columns)
