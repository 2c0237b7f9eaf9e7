"""Table maintenance: key joins that keep companion tables in step. All are lazy; ``swap`` commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import keys
from geomill.sources import shared

# The columns that a cluster sidecar keeps.
SIDECAR = ("photo_key", "Platform", "Photo_ID", "embedding_idx", "cluster_id", "parent_cluster_id", "cluster_label", "cluster_description", "parent_cluster_label", "parent_cluster_description", "model_name", "representation_type", "precision")


def with_key(df: DataFrame) -> DataFrame:
    return df if "photo_key" in df.columns else df.withColumn("photo_key", keys.photo_key(F.col("Platform"), F.col("Photo_ID")))


def keep_keys(df: DataFrame, active: DataFrame) -> DataFrame:
    """The rows whose key is active: sidecars, embeddings and offline copies alike. Idempotent."""
    return with_key(df).join(with_key(active).select("photo_key").distinct(), "photo_key", "left_semi").select(df.columns)


def keep_relaxed(df: DataFrame, active: DataFrame) -> DataFrame:
    """The rows that are active under either name of a platform."""
    key = F.concat_ws("_", keys.relaxed_platform(F.col("Platform")), keys.clean_photo_id(F.col("Photo_ID")))
    return df.withColumn("__key", key).join(active.select(key.alias("__key")).distinct(), "__key", "left_semi").select(df.columns)


def drop_keys(df: DataFrame, gone: DataFrame) -> DataFrame:
    return with_key(df).join(with_key(gone).select("photo_key").distinct(), "photo_key", "left_anti").select(df.columns)


def prune_companion(vectors: DataFrame, index: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(vectors, index, removed) with active keys alone, of vectors numbered by embedding_idx and their key index.

    Where vectors and keys differ in number it can't be known which belongs to which: both
    stay as they are, and nothing is removed.
    """
    rows, names = vectors.count(), index.count()
    if rows != names:
        return vectors, index, 0
    kept = keep_keys(index, active)
    return vectors.join(kept.select("embedding_idx"), "embedding_idx", "left_semi").select(vectors.columns), kept, names - kept.count()


def sync(online: DataFrame, offline: DataFrame, companions: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(offline, companions) with the keys that are both offline and online."""
    kept = keep_keys(offline, online)
    return kept, {n: keep_keys(df, kept) for n, df in companions.items()}


def sync_summary(online: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, kept, removed of what ``sync`` would do; nothing is changed."""
    active = with_key(online).select("photo_key").distinct().withColumn("__on", F.lit(1))
    counts = [with_key(df).join(active, "photo_key", "left").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"), F.count("__on").alias("kept")) for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.withColumn("removed", F.col("rows") - F.col("kept"))


def purge(df: DataFrame, violating: DataFrame, platform: str = "mapillary") -> DataFrame:
    """df without a platform's listed photo ids."""
    ids = violating.select(keys.clean_photo_id(F.col("Photo_ID")).alias("__id")).distinct()
    hit = (F.lower("Platform") == platform) & (keys.clean_photo_id(F.col("Photo_ID")) == F.col("__id"))
    return df.join(ids, hit, "left_anti")


def purge_counts(df: DataFrame, violating: DataFrame, platform: str = "mapillary") -> DataFrame:
    ids = violating.select(keys.clean_photo_id(F.col("Photo_ID")).alias("__id")).distinct().withColumn("__hit", F.lit(1))
    hit = (F.lower("Platform") == platform) & (keys.clean_photo_id(F.col("Photo_ID")) == F.col("__id"))
    return df.join(ids, hit, "left").agg(F.count(F.lit(1)).alias("rows_in"), (F.count(F.lit(1)) - F.count("__hit")).alias("rows_out"), F.count("__hit").alias("purged"))


def purge_by_rules(df: DataFrame, rules: DataFrame, cell: Column, sequence: str | None = None) -> DataFrame:
    """df without what staged rules (cell, platform, expand_sequence) remove.

    platform ``all`` removes a cell, another name that platform's photos in it;
    expand_sequence removes every photo of a sequence that has one so removed.
    """
    r = rules.select(F.col("cell").alias("__cell"), F.lower("platform").alias("__platform"), F.coalesce("expand_sequence", F.lit(False)).alias("__expand")).distinct()
    hit = (F.col("__c") == F.col("__cell")) & ((F.col("__platform") == "all") | (F.col("__platform") == F.lower("Platform")))
    rows = df.withColumn("__c", cell)
    kept = rows.join(r, hit, "left_anti")
    if sequence is not None:
        bad = rows.join(r.where("__expand"), hit, "left_semi").where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("__s")).distinct()
        kept = kept.join(bad, F.col(sequence) == F.col("__s"), "left_anti")
    return kept.select(df.columns)


def sidecar_columns(df: DataFrame) -> DataFrame:
    """The canonical columns and those that speak of clusters, medoids or descriptions."""
    return df.select([c for c in df.columns if c in SIDECAR or "cluster" in c.lower() or "medoid" in c.lower() or c.lower().endswith("_description")])


def decouple(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, embeddings, sidecar) of a table that holds all."""
    keyed = with_key(wide)
    side = [c for c in keyed.columns if c not in ("embedding",) and (c in SIDECAR or "cluster" in c.lower() or "medoid" in c.lower())]
    base = [c for c in keyed.columns if c != "embedding" and (c not in side or c in ("photo_key", "Platform", "Photo_ID"))]
    return keyed.select(base), keyed.select("photo_key", "embedding").where("embedding is not null"), keyed.select(side)


def migrate_keys(embeddings: DataFrame, photos: DataFrame) -> DataFrame:
    """Embeddings with positional numbers under photo keys; unmatched ones under ``unknown_idx_<n>``."""
    one = with_key(photos).groupBy("embedding_idx").agg(F.min("photo_key").alias("photo_key"))
    return embeddings.drop("photo_key").join(one, "embedding_idx", "left").withColumn("photo_key", F.coalesce("photo_key", F.concat(F.lit("unknown_idx_"), F.col("embedding_idx").cast("string"))))


def rename_platform(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.replace(old, new, "Platform")


def restore_addresses(offline: DataFrame, online: DataFrame, platforms: tuple[str, ...] = ("flickr", "mapillary", "kartaview", "inaturalist")) -> DataFrame:
    """Offline rows of these platforms with their online address, where the key is online."""
    own = F.when(F.lower("Platform").isin(*platforms), F.col("photo_key"))
    one = with_key(online).groupBy(F.col("photo_key").alias("__k")).agg(F.min("Image_URL").alias("__url"))
    joined = with_key(offline).withColumn("__own", own).join(one, F.col("__own") == F.col("__k"), "left")
    return joined.withColumn("Image_URL", F.coalesce("__url", "Image_URL")).select(offline.columns)


def restored_table(offline: DataFrame, online: DataFrame, path: str, **choice: tuple[str, ...]) -> DataFrame:
    """``restore_addresses`` as a table at path, and what it did: platform, updated, kept.

    The table is written aside and takes its place only if it has as many rows as before;
    else it is removed, and that is an error.
    """
    spark = offline.sparkSession
    aside = f"{path}.restoring"
    restore_addresses(offline, online, **choice).write.mode("overwrite").parquet(aside)
    made = spark.read.parquet(aside)
    before, after = offline.count(), made.count()
    if before != after:
        shared.delete(spark, aside)
        raise ValueError(f"{before} rows went in and {after} came out: {path} stays as it was")
    own = with_key(offline).select("photo_key", "Platform", F.col("Image_URL").alias("__was"))
    counts = own.groupBy("photo_key", "Platform").agg(F.min("__was").alias("__was")).join(with_key(made).groupBy("photo_key", "Platform").agg(F.min("Image_URL").alias("__is")), ["photo_key", "Platform"])
    updated = (~F.col("__was").eqNullSafe(F.col("__is"))).cast("long")
    done = shared.written(counts.groupBy(F.lower("Platform").alias("platform")).agg(F.sum(updated).alias("updated"), F.sum(1 - updated).alias("kept")), "restored")
    fs, at = shared.place(spark, path)
    old = shared.place(spark, f"{path}.old")[1]
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(shared.place(spark, aside)[1], at)
    fs.delete(old, True)
    return done


def restore_licenses(df: DataFrame, licensed: DataFrame) -> DataFrame:
    one = licensed.groupBy("Platform", "Photo_ID").agg(F.min("License").alias("License"))
    return df.drop("License").join(one, ["Platform", "Photo_ID"], "left")


def latest(*tables: DataFrame, key: str = "sequence_id", at: str = "checked_at") -> DataFrame:
    """Upsert: of each key the row checked last; at equal times that of the later table."""
    marked = [t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)]
    all_ = marked[0]
    for t in marked[1:]:
        all_ = all_.unionByName(t, allowMissingColumns=True)
    columns = [c for c in all_.columns if c != "__t"]
    best = all_.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, "__t")).alias("row"))
    return best.select("row.*")


def audit_files(rows: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """Per group how many listed images exist, their share, and the first five missing."""
    have = files.select(F.col("path").alias("__p")).distinct().withColumn("__hit", F.lit(1))
    joined = rows.join(have, F.col("Image_Location") == F.col("__p"), "left")
    missing = F.slice(F.sort_array(F.collect_list("__m")), 1, 5)
    # the five smallest of each group are kept while counting, so no group is gathered whole
    ranked = joined.withColumn("__r", F.row_number().over(Window.partitionBy(group, F.col("__hit").isNull()).orderBy("Image_Location")))
    return ranked.withColumn("__m", F.when(F.col("__hit").isNull() & (F.col("__r") <= 5), F.col("Image_Location"))).groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count("__hit").alias("found"), (F.count("__hit") / F.count(F.lit(1))).alias("share"), missing.alias("missing"))


def unlisted_files(files: DataFrame, active: DataFrame) -> DataFrame:
    """Files whose stem is no active photo id: what may be deleted."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.join(active.select(keys.clean_photo_id(F.col("Photo_ID")).alias("__id")).distinct(), stem == F.col("__id"), "left_anti")


def swap(df: DataFrame, path: str) -> None:
    """Replace a table by a frame that may read it: written beside, then renamed."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    df.write.mode("overwrite").option("compression", "zstd").parquet(path + ".new")
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path + ".old"), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(path + ".old"))
    fs.rename(hadoop(path + ".new"), hadoop(path))
    fs.delete(hadoop(path + ".old"), True)
