"""Joins and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import grid, keys
from geomill.operators import cameras, ingest, maintain
from geomill.plans.views import PHOTOS_SQL, cell_sql, photos, table
from geomill.sources import shared, tables, versions


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d).withColumn("photo_key", keys.photo_key(F.col("Platform"), F.col("Photo_ID")))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """A sidecar: one row for two photos of three."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("cluster_id"))
    rows = keyed(spark, d).where(F.col("event_id") % 3 != 0).select("photo_key", "vec_id", "event_id").join(e, "vec_id")
    return rows.select("photo_key", "cluster_id", F.floor(F.col("cluster_id") / 3).cast("long").alias("parent_cluster_id"), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("cluster_label"))


KEYED = PHOTOS_SQL + ", keyed AS (SELECT *, Platform || '_' || Photo_ID AS photo_key FROM photos)"
CLUSTERS = KEYED + ", clusters AS (SELECT photo_key, CAST(label AS BIGINT) AS cluster_id, CAST(label // 3 AS BIGINT) AS parent_cluster_id, 'Cluster ' || label AS cluster_label FROM keyed JOIN embeddings USING (vec_id) WHERE event_id % 3 <> 0)"


def join_clusters(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_clusters(keyed(spark, d).select("photo_key", "event_id"), clusters(spark, d))


JOIN_CLUSTERS = CLUSTERS + " SELECT photo_key, event_id, cluster_id, parent_cluster_id, cluster_label FROM keyed LEFT JOIN clusters USING (photo_key)"


def join_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Each photo with its vector, zeros where it has none; as sums, to be compared."""
    p = keyed(spark, d).select("photo_key", "event_id", "vec_id")
    e = p.where(F.col("event_id") % 4 != 0).join(table(spark, d, "embeddings"), "vec_id").select("photo_key", "embedding")
    aligned = ingest.align_embeddings(p.select("photo_key", "event_id"), e, 64)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return aligned.select("event_id", F.size("embedding").alias("size"), F.round(total, 4).alias("total"))


JOIN_EMBEDDINGS = PHOTOS_SQL + " SELECT event_id, 64 AS size, CASE WHEN event_id % 4 <> 0 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) ELSE 0.0e0 END AS total FROM photos JOIN embeddings USING (vec_id)"


def upsert_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the active cells replaced by new ones."""
    p = photos(spark, d).select("Photo_ID", "Platform", grid.encode(F.col("Latitude"), F.col("Longitude"), 2).alias("H3_Cell"), "event_id")
    new = p.where(F.col("event_id") % 10 == 0).withColumn("Photo_ID", F.concat(F.lit("n"), "Photo_ID")).withColumn("License", F.lit("CC0"))
    return ingest.replace_cells(p, new)


_P2 = PHOTOS_SQL + f", p AS (SELECT Photo_ID, Platform, CASE WHEN Latitude IS NOT NULL THEN {cell_sql(2)} END AS H3_Cell, event_id FROM photos), n AS (SELECT 'n' || Photo_ID AS Photo_ID, Platform, H3_Cell, event_id FROM p WHERE event_id % 10 = 0)"
UPSERT_CELLS = _P2 + """
    SELECT Photo_ID, Platform, H3_Cell, event_id, Platform || '_' || Photo_ID AS photo_key, NULL AS License FROM p WHERE H3_Cell IS NULL OR H3_Cell NOT IN (SELECT H3_Cell FROM n WHERE H3_Cell IS NOT NULL)
    UNION ALL SELECT Photo_ID, Platform, H3_Cell, event_id, Platform || '_' || Photo_ID, 'CC0' FROM n"""


def _by_coarse_cell(c: Column) -> Column:
    return grid.parent(c, 0)


def upsert_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The photos as a table in coarse cells, into which the photos of some finer cells come anew; what it holds then."""
    p = photos(spark, d).select("Photo_ID", "Platform", grid.encode(F.col("Latitude"), F.col("Longitude"), 2).alias("H3_Cell"), "event_id")
    path = shared.new_path(spark, "photos") + "/table"
    ingest.save_by_cells(p.withColumn("photo_key", keys.photo_key(F.col("Platform"), F.col("Photo_ID"))), path, _by_coarse_cell(F.col("H3_Cell")))
    new = p.where(grid.parent(F.col("H3_Cell"), 0) % 4 == 1).where(F.col("event_id") % 10 < 3).withColumn("Photo_ID", F.concat(F.lit("n"), "Photo_ID")).withColumn("License", F.lit("CC0"))
    ingest.upsert_by_cells(spark, path, new, _by_coarse_cell)
    return ingest.load_by_cells(spark, path).drop(ingest.PART)


UPSERT_PARTITIONS = PHOTOS_SQL + f"""
    , p AS (SELECT Photo_ID, Platform, CASE WHEN Latitude IS NOT NULL THEN {cell_sql(2)} END AS H3_Cell, {cell_sql(0)} AS c0, event_id FROM photos),
    n AS (SELECT 'n' || Photo_ID AS Photo_ID, Platform, H3_Cell, event_id FROM p WHERE H3_Cell IS NOT NULL AND c0 % 4 = 1 AND event_id % 10 < 3)
    SELECT Photo_ID, Platform, H3_Cell, event_id, Platform || '_' || Photo_ID AS photo_key, NULL AS License FROM p WHERE H3_Cell IS NULL OR H3_Cell NOT IN (SELECT H3_Cell FROM n)
    UNION ALL SELECT Photo_ID, Platform, H3_Cell, event_id, Platform || '_' || Photo_ID, 'CC0' FROM n"""


def lockstep_tables(spark: SparkSession, d: str) -> DataFrame:
    """A download in two calls, each of which adds to metadata, embeddings and keys in one commit: what each table has for each photo, and in which version its key first is."""
    root = shared.new_path(spark, "download")
    todo = photos(spark, d).select(keys.photo_key(F.col("Platform"), F.col("Photo_ID")).alias("photo_key"), "event_id", "vec_id")
    fetched = lambda rows: rows.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    first = ingest.resume_in_lockstep(todo.where("event_id % 3 = 0"), root, fetched)
    last = ingest.resume_in_lockstep(todo, root, fetched)
    early = versions.read(spark, root, "keys", first).withColumn("early", F.lit(first))
    at = lambda name: versions.read(spark, root, name, last)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    joined = at("keys").join(at("metadata"), "photo_key").join(at("embeddings"), "photo_key").join(early, "photo_key", "left")
    return joined.select("photo_key", "event_id", F.round(total, 4).alias("total"), F.coalesce("early", F.lit(last)).cast("long").alias("version"))


LOCKSTEP_TABLES = PHOTOS_SQL + " SELECT Platform || '_' || Photo_ID AS photo_key, event_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS version FROM photos JOIN embeddings USING (vec_id)"


def only_new_keys(spark: SparkSession, d: str) -> DataFrame:
    p = keyed(spark, d).select("photo_key", "event_id")
    return ingest.only_new(p, p.where(F.col("event_id") % 3 == 0))


ONLY_NEW_KEYS = KEYED + " SELECT photo_key, event_id FROM keyed WHERE event_id % 3 <> 0"


def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    p = keyed(spark, d).select("photo_key", "event_id")
    return maintain.sync_summary(p.where(F.col("event_id") % 4 != 1), {"offline": p.where(F.col("event_id") % 2 == 1), "clusters": clusters(spark, d)})


SYNC_COUNTS = CLUSTERS + """, o AS (SELECT photo_key FROM keyed WHERE event_id % 4 <> 1)
    SELECT 'offline' AS "table", count(*) AS rows, count(o.photo_key) AS kept, count(*) - count(o.photo_key) AS removed FROM keyed LEFT JOIN o USING (photo_key) WHERE event_id % 2 = 1
    UNION ALL SELECT 'clusters', count(*), count(o.photo_key), count(*) - count(o.photo_key) FROM clusters LEFT JOIN o USING (photo_key)"""


def sync_rows(spark: SparkSession, d: str) -> DataFrame:
    p = keyed(spark, d).select("photo_key", "event_id")
    return maintain.sync(p.where(F.col("event_id") % 4 != 1), p.where(F.col("event_id") % 2 == 1), {"c": clusters(spark, d)})[1]["c"]


SYNC_ROWS = CLUSTERS + " SELECT c.* FROM clusters c JOIN keyed USING (photo_key) WHERE event_id % 4 <> 1 AND event_id % 2 = 1"


def purge_ids(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select("Photo_ID", "Platform", "event_id")
    return maintain.purge(p, p.where(F.col("event_id") % 5 == 0).select(F.concat("Photo_ID", F.lit(".0")).alias("Photo_ID")))


PURGE_IDS = PHOTOS_SQL + " SELECT Photo_ID, Platform, event_id FROM photos WHERE NOT (Platform = 'mapillary' AND event_id % 5 = 0)"


def purge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Cells removed for all or one platform, and whole sequences of what is so removed."""
    p = photos(spark, d).select("Platform", "event_id", "user_id", "Latitude", "Longitude")
    cell = grid.encode(F.col("Latitude"), F.col("Longitude"), 2)
    at = p.where("event_id < 12").select(cell.alias("cell"), F.when(F.col("event_id") % 2 == 0, "all").otherwise("mapillary").alias("platform"), (F.col("event_id") == 4).alias("expand_sequence")).where("cell is not null")
    return maintain.purge_by_rules(p, at, cell, "user_id")


PURGE_RULES = PHOTOS_SQL + f""", p AS (SELECT *, CASE WHEN Latitude IS NOT NULL THEN {cell_sql(2)} END AS c FROM photos),
    r AS (SELECT c, event_id % 2 = 0 AS every, event_id = 4 AS expand FROM p WHERE event_id < 12 AND c IS NOT NULL),
    s AS (SELECT DISTINCT user_id FROM p JOIN r USING (c) WHERE expand AND (every OR Platform = 'mapillary'))
    SELECT Platform, event_id, user_id, Latitude, Longitude FROM p
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = p.c AND (every OR Platform = 'mapillary')) AND (user_id IS NULL OR user_id NOT IN (SELECT user_id FROM s WHERE user_id IS NOT NULL))"""


def companions_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of vectors with their key index: one in step, whose inactive keys go, and one whose vectors and keys differ in number, which stays."""
    numbered = table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_idx"), "embedding")
    index = numbered.select("embedding_idx", F.concat(F.lit("flickr_"), F.col("embedding_idx").cast("string")).alias("photo_key"))
    active = index.where("embedding_idx % 3 <> 0").select("photo_key")
    made = []
    for name, keys_of in (("in_step", index), ("out_of_step", index.where("embedding_idx > 0"))):
        v, i, removed = maintain.prune_companion(numbered, keys_of, active)
        made.append(v.agg(F.lit(name).alias("companion"), F.count(F.lit(1)).alias("vectors"), F.sum("embedding_idx").alias("total")).withColumns({"keys": F.lit(i.count()), "removed": F.lit(removed)}))
    return made[0].unionByName(made[1]).select("companion", "vectors", "total", F.col("keys").cast("long").alias("keys"), F.col("removed").cast("long").alias("removed"))


COMPANIONS_PRUNED = """
    SELECT 'in_step' AS companion, count(*) FILTER (vec_id % 3 <> 0) AS vectors, CAST(sum(vec_id) FILTER (vec_id % 3 <> 0) AS BIGINT) AS total, count(*) FILTER (vec_id % 3 <> 0) AS keys, count(*) FILTER (vec_id % 3 = 0) AS removed FROM embeddings
    UNION ALL SELECT 'out_of_step', count(*), CAST(sum(vec_id) AS BIGINT), count(*) FILTER (vec_id > 0), CAST(0 AS BIGINT) FROM embeddings"""


def restored_counts(spark: SparkSession, d: str) -> DataFrame:
    """A table whose addresses are restored in place, if no row is lost: what was updated and kept of each platform."""
    p = keyed(spark, d).select("photo_key", "Platform", "Image_URL", "event_id")
    path = shared.new_path(spark, "offline") + "/table"
    p.withColumn("Image_URL", F.when(F.col("event_id") % 2 == 0, "local.jpg").otherwise(F.col("Image_URL"))).write.parquet(path)
    done = maintain.restored_table(spark.read.parquet(path), p.where(F.col("event_id") % 3 != 0), path, platforms=("flickr", "inaturalist"))
    now = spark.read.parquet(path).groupBy(F.lower("Platform").alias("platform")).agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("Image_URL") == "local.jpg").cast("long")).alias("local"))
    return done.join(now, "platform")


RESTORED_COUNTS = KEYED + """
    , r AS (SELECT lower(Platform) AS platform, event_id % 2 = 0 AS was_local, event_id % 3 <> 0 AND Platform IN ('flickr', 'inaturalist') AS hit FROM keyed)
    SELECT platform, count(*) FILTER (was_local AND hit) AS updated, count(*) FILTER (NOT (was_local AND hit)) AS kept, count(*) AS "rows", count(*) FILTER (was_local AND NOT hit) AS local FROM r GROUP BY 1"""


def restore_urls(spark: SparkSession, d: str) -> DataFrame:
    p = keyed(spark, d).select("photo_key", "Platform", "Image_URL", "event_id")
    offline = p.withColumn("Image_URL", F.lit("local.jpg"))
    return maintain.restore_addresses(offline, p.where(F.col("event_id") % 3 != 0), ("flickr", "inaturalist"))


RESTORE_URLS = KEYED + " SELECT photo_key, Platform, CASE WHEN event_id % 3 <> 0 AND Platform IN ('flickr', 'inaturalist') THEN Image_URL ELSE 'local.jpg' END AS Image_URL, event_id FROM keyed"


def restore_licenses(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select("Photo_ID", "Platform", "License")
    return maintain.restore_licenses(p.withColumn("License", F.lit("x")), p)


RESTORE_LICENSES = PHOTOS_SQL + " SELECT Platform, Photo_ID, License FROM photos"


def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by sequence: the last check of each user, the later table on equal times."""
    p = photos(spark, d).select(F.col("user_id").alias("sequence_id"), F.unix_seconds("ts").alias("checked_at"))
    old = p.groupBy("sequence_id").agg(F.max("checked_at").alias("checked_at")).withColumn("source", F.lit("old"))
    new = p.groupBy("sequence_id").agg(F.min("checked_at").alias("checked_at")).where("sequence_id % 2 = 0").withColumn("source", F.lit("new"))
    return maintain.latest(old, new)


LATEST_VERDICTS = """
    WITH a AS (SELECT user_id AS sequence_id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS hi, min(CAST(floor(epoch(ts)) AS BIGINT)) AS lo FROM events GROUP BY 1)
    SELECT sequence_id, hi AS checked_at, CASE WHEN sequence_id % 2 = 0 AND hi = lo THEN 'new' ELSE 'old' END AS source FROM a"""


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Keys of which no source has a vector, by which source the others are found."""
    p = keyed(spark, d).select("photo_key", "event_id")
    source = lambda name, cond: p.where(cond).select("photo_key", F.lit(name).alias("embedding"))
    found, missing = ingest.backfill([source("a", F.col("event_id") % 2 == 0), source("b", F.col("event_id") % 3 == 0)], p)
    return found.unionByName(missing, allowMissingColumns=True)


BACKFILLED = KEYED + " SELECT photo_key, CASE WHEN event_id % 3 = 0 THEN 'b' WHEN event_id % 2 = 0 THEN 'a' END AS embedding FROM keyed"


def migrated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the vectors by their photos' numbers; of numbers that no photo of the first three platforms has, names for the unknown."""
    p = keyed(spark, d).where("Platform <> 'kartaview'").select("photo_key", F.col("event_id").alias("embedding_idx"))
    return maintain.migrate_keys(table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_idx"), F.lit(None).cast("string").alias("photo_key")), p)


MIGRATED_KEYS = KEYED + " SELECT vec_id AS embedding_idx, coalesce(photo_key, 'unknown_idx_' || vec_id) AS photo_key FROM embeddings LEFT JOIN (SELECT photo_key, event_id FROM keyed WHERE Platform <> 'kartaview') k ON k.event_id = vec_id"


def updated_times(spark: SparkSession, d: str) -> DataFrame:
    """Missing capture times filled from a lookup; those there stay."""
    p = photos(spark, d).select("Photo_ID", "Captured_At", "event_id")
    look = p.where(F.col("event_id") % 2 == 0).select("Photo_ID", F.lit("2020-01-01T00:00:00Z").alias("Captured_At"))
    return ingest.update_values(p, look, ["Photo_ID"], "Captured_At", keep_own=True)


UPDATED_TIMES = PHOTOS_SQL + " SELECT Photo_ID, coalesce(Captured_At, CASE WHEN event_id % 2 = 0 THEN '2020-01-01T00:00:00Z' END) AS Captured_At, event_id FROM photos"


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of each conversation that has an answer."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ingest.first_per_key(c.where("role <> 'system'"), ["conv_id"], [F.col("turn"), F.col("role")])


FIRST_ROWS = "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1"


def files_audit(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select("country", F.concat(F.lit("img/"), F.lpad("Photo_ID", 8, "0")).alias("Image_Location"), "event_id")
    return maintain.audit_files(p, p.where(F.col("event_id") % 9 != 0).select(F.col("Image_Location").alias("path")), "country")


FILES_AUDIT = PHOTOS_SQL + """, p AS (SELECT country, 'img/' || lpad(Photo_ID, 8, '0') AS l, event_id % 9 <> 0 AS there FROM photos)
    SELECT country, count(*) AS total, count(*) FILTER (there) AS found, count(*) FILTER (there) / count(*) AS share,
           coalesce(list_slice(list_sort(list(l) FILTER (NOT there)), 1, 5), []) AS missing FROM p GROUP BY 1"""


def deployments_joined(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as deployments, nations as their projects."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("deployment_id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 1000).alias("latitude"), F.lit(1.0).alias("longitude"), (F.col("s_suppkey") % 7 == 0).alias("fuzzed"), F.when(F.col("s_suppkey") % 3 == 0, "Camera Functioning ").otherwise("Unknown Failure").alias("camera_functioning"), F.col("s_nationkey").alias("project_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project_name"))
    return cameras.deployments(s, n).select("deployment_id", "project_id", "project_name")


DEPLOYMENTS_JOINED = "SELECT s_suppkey AS deployment_id, s_nationkey AS project_id, n_name AS project_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0 AND s_acctbal IS NOT NULL"


def images_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Photos matched to image files by platform and id, by id, or by the address."""
    p = keyed(spark, d).select("photo_key", "Photo_ID", "Platform", "Image_URL", "event_id")
    e = F.col("event_id")
    files = p.where(e % 3 != 2).select(F.when(e % 3 == 0, F.concat(F.lit("/d/"), "Platform", F.lit("/"), "Photo_ID", F.lit(".JPG"))).otherwise(F.concat(F.lit("/e/x/"), F.element_at(F.split("Image_URL", "/"), -1))).alias("path"))
    return tables.resolve_images(p, tables.image_index(files)).select("event_id", "image_path")


IMAGES_RESOLVED = KEYED + " SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/d/' || Platform || '/' || Photo_ID || '.JPG' WHEN 1 THEN '/e/x/' || split_part(Image_URL, '/', 4) END AS image_path FROM keyed"


QUERIES = {
    "join_clusters": (join_clusters, JOIN_CLUSTERS),
    "join_embeddings": (join_embeddings, JOIN_EMBEDDINGS),
    "upsert_cells": (upsert_cells, UPSERT_CELLS),
    "companions_pruned": (companions_pruned, COMPANIONS_PRUNED),
    "restored_counts": (restored_counts, RESTORED_COUNTS),
    "upsert_partitions": (upsert_partitions, UPSERT_PARTITIONS),
    "lockstep_tables": (lockstep_tables, LOCKSTEP_TABLES),
    "only_new_keys": (only_new_keys, ONLY_NEW_KEYS),
    "sync_counts": (sync_counts, SYNC_COUNTS),
    "sync_rows": (sync_rows, SYNC_ROWS),
    "purge_ids": (purge_ids, PURGE_IDS),
    "purge_rules": (purge_rules, PURGE_RULES),
    "restore_urls": (restore_urls, RESTORE_URLS),
    "restore_licenses": (restore_licenses, RESTORE_LICENSES),
    "latest_verdicts": (latest_verdicts, LATEST_VERDICTS),
    "backfilled": (backfilled, BACKFILLED),
    "migrated_keys": (migrated_keys, MIGRATED_KEYS),
    "updated_times": (updated_times, UPDATED_TIMES),
    "first_rows": (first_rows, FIRST_ROWS),
    "files_audit": (files_audit, FILES_AUDIT),
    "deployments_joined": (deployments_joined, DEPLOYMENTS_JOINED),
    "images_resolved": (images_resolved, IMAGES_RESOLVED),
}
