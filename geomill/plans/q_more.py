"""Further operators: set operations, splits of wide tables, model answers, archives, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import geo, grid, keys, text
from geomill.operators import cameras, cluster, filters, ingest, maintain, metrics, neighbours, sampling, stats, trajectory
from geomill.plans.q_aggregates import _points
from geomill.plans.q_joins import CLUSTERS, KEYED, clusters, keyed
from geomill.plans.q_vectors import _UNIT
from geomill.plans.views import PHOTOS_SQL, cell_sql, photos, table
from geomill.sources import occurrences, tables


def cell_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the cells of two platforms."""
    p = photos(spark, d).where("cell is not null").select("Platform", grid.parent(F.col("cell"), 2).alias("c"))
    a, b = p.where("Platform = 'flickr'").select("c"), p.where("Platform = 'mapillary'").select("c")
    kind = lambda df, name: df.select("c", F.lit(name).alias("kind"))
    return ingest.concat(kind(a.union(b).distinct(), "union"), kind(a.intersect(b), "both"), kind(a.subtract(b), "first"))


CELL_SETS = PHOTOS_SQL + f""", p AS (SELECT Platform, {cell_sql(2)} AS c FROM photos WHERE Latitude IS NOT NULL), a AS (SELECT c FROM p WHERE Platform = 'flickr'), b AS (SELECT c FROM p WHERE Platform = 'mapillary')
    SELECT c, 'union' AS kind FROM (SELECT c FROM a UNION SELECT c FROM b) UNION ALL SELECT c, 'both' FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT c, 'first' FROM (SELECT c FROM a EXCEPT SELECT c FROM b)"""


def cells_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Only rows of active cells, by a semi-join."""
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 2)).select("event_id", "c")
    return tables.scan_cells(p, p.where("event_id < 40"), "c")


CELLS_SCANNED = PHOTOS_SQL + f", p AS (SELECT event_id, {cell_sql(2)} AS c FROM photos WHERE Latitude IS NOT NULL) SELECT event_id, c FROM p WHERE c IN (SELECT c FROM p WHERE event_id < 40)"


def wide_base(spark: SparkSession, d: str) -> DataFrame:
    """The base part of a wide table that is decoupled."""
    wide = keyed(spark, d).select("photo_key", "Platform", "Photo_ID", "country", "vec_id").join(clusters(spark, d), "photo_key").join(table(spark, d, "embeddings").drop("label"), "vec_id").drop("vec_id")
    return maintain.decouple(wide)[0]


WIDE_BASE = CLUSTERS + " SELECT photo_key, Platform, Photo_ID, country FROM keyed JOIN clusters USING (photo_key)"


def wide_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """The cluster columns of a table with others, pruned to what a sidecar keeps."""
    return maintain.sidecar_columns(clusters(spark, d).withColumns({"extra": F.lit(1), "medoid_rank": F.lit(2)}))


WIDE_SIDECAR = CLUSTERS + " SELECT photo_key, cluster_id, parent_cluster_id, cluster_label, 2 AS medoid_rank FROM clusters"


def purge_report(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select("Photo_ID", "Platform", "event_id")
    return maintain.purge_counts(p, p.where(F.col("event_id") % 5 == 0).select("Photo_ID"))


PURGE_REPORT = PHOTOS_SQL + " SELECT count(*) AS rows_in, count(*) - count(*) FILTER (Platform = 'mapillary' AND event_id % 5 = 0) AS rows_out, count(*) FILTER (Platform = 'mapillary' AND event_id % 5 = 0) AS purged FROM photos"


def renamed_platform(spark: SparkSession, d: str) -> DataFrame:
    return maintain.rename_platform(photos(spark, d).select("event_id", "Platform"), "inaturalist", "inat")


RENAMED_PLATFORM = PHOTOS_SQL + " SELECT event_id, CASE WHEN Platform = 'inaturalist' THEN 'inat' ELSE Platform END AS Platform FROM photos"


def relaxed_sync(spark: SparkSession, d: str) -> DataFrame:
    """Offline rows that are online under either name of a platform."""
    p = keyed(spark, d).select("Photo_ID", "Platform", "event_id")
    return maintain.keep_relaxed(p, maintain.rename_platform(p.where(F.col("event_id") % 3 == 0), "inaturalist", "inat"))


RELAXED_SYNC = PHOTOS_SQL + " SELECT Photo_ID, Platform, event_id FROM photos WHERE event_id % 3 = 0"


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("event_id") % 3 == 0, "/data/a/").when(F.col("event_id") % 3 == 1, "/mnt/b//").otherwise("/else/"), F.col("Photo_ID"))
    return photos(spark, d).select("event_id", keys.relative_path(path, [("/data/", "d/"), ("/mnt/b", "m")]).alias("path"))


RELATIVE_PATHS = PHOTOS_SQL + " SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd/a/' WHEN 1 THEN 'm/' ELSE '/else/' END || Photo_ID AS path FROM photos"


def unlisted_files(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d)
    files = p.select(F.concat(F.lit("/img/"), "Photo_ID", F.lit(".jpg")).alias("path"))
    return maintain.unlisted_files(files, p.where(F.col("event_id") % 4 != 0))


UNLISTED_FILES = PHOTOS_SQL + " SELECT '/img/' || Photo_ID || '.jpg' AS path FROM photos WHERE event_id % 4 = 0"


def audited(spark: SparkSession, d: str) -> DataFrame:
    """Photos left when those of invalid tracks are purged."""
    judged = trajectory.validate(_points(spark, d), min_frames=60)
    p = keyed(spark, d).select("photo_key", "event_id", F.col("user_id").alias("sequence_id"))
    return trajectory.audit_purge(p.drop("sequence_id"), p.select("photo_key", "sequence_id"), judged.withColumn("is_valid", F.col("frames") >= 60))


AUDITED = KEYED + " SELECT photo_key, event_id FROM keyed WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60)"


def track_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The number of points of each track's GeoJSON line."""
    return trajectory.track(_points(spark, d)).select("sequence_id", F.json_array_length(F.get_json_object("geojson", "$.coordinates")).alias("n"))


TRACK_LENGTHS = "SELECT user_id AS sequence_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1"


def parents_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The first components of parents' centroids: children weighted by their counts."""
    e = table(spark, d, "embeddings").withColumn("cluster_id", F.col("label").cast("long"))
    c = cluster.centroids(e, unit=True)
    up = cluster.parent_centroids(c, c.select("cluster_id", F.floor(F.col("cluster_id") / 3).cast("long").alias("parent_cluster_id")))
    return up.select("parent_cluster_id", "children", *[F.round(F.col("centroid")[i], 5).alias(f"c{i}") for i in range(3)])


PARENTS_WEIGHTED = f"WITH {_UNIT}, c AS (SELECT label, sum(v[1]) AS a, sum(v[2]) AS b, sum(v[3]) AS c FROM u GROUP BY 1) SELECT CAST(label // 3 AS BIGINT) AS parent_cluster_id, count(*) AS children, round(avg(a), 5) AS c0, round(avg(b), 5) AS c1, round(avg(c), 5) AS c2 FROM c GROUP BY 1"


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return sampling.interleave(photos(spark, d).select("event_id", "Platform"), "Platform", [F.col("event_id")])


INTERLEAVED = PHOTOS_SQL + " SELECT event_id, Platform, CAST(row_number() OVER (PARTITION BY Platform ORDER BY event_id) AS INTEGER) AS turn FROM photos"


def balanced_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many of each platform a balanced sample has."""
    b = sampling.balanced(photos(spark, d), "Platform", 300, ["flickr", "mapillary"], "event_id")
    return b.groupBy("Platform").agg(F.count(F.lit(1)).alias("n"))


BALANCED_COUNTS = PHOTOS_SQL + " SELECT Platform, least(count(*), 150) AS n FROM photos WHERE Platform IN ('flickr', 'mapillary') GROUP BY 1"


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many successes and failures of each class a balanced sample has."""
    p = photos(spark, d).select("event_id", "country", (F.col("event_id") % 7 == 0).alias("success"))
    return sampling.balanced_outcomes(p, "country", "success", 20, "event_id").groupBy("country", "success").agg(F.count(F.lit(1)).alias("n"))


OUTCOME_COUNTS = PHOTOS_SQL + """, c AS (SELECT country, event_id % 7 = 0 AS success, count(*) AS n FROM photos GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY country) - n AS other FROM c)
    SELECT country, success, CAST(CASE WHEN n >= 10 AND other >= 10 THEN 10 WHEN n < 10 THEN n ELSE least(n, 20 - other) END AS BIGINT) AS n FROM t"""


def _landmarks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Photos of cells with fewer than 12, and those taken in order: 2 of a landmark and 3 of a cell at most."""
    p = photos(spark, d).where("cell is not null").select("event_id", grid.parent(F.col("cell"), 2).alias("c"), (F.col("event_id") % 97).alias("landmark"))
    n = p.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n.where("n < 12"), "c").drop("n"), sampling.sparse_landmarks(p, n, "c", "landmark", "event_id", 12, 3, 2)


def landmark_samples(spark: SparkSession, d: str) -> DataFrame:
    return _landmarks(spark, d)[1]


def landmarks_hold(spark: SparkSession, d: str) -> DataFrame:
    """Photos that may be taken, and how many are though their cell or landmark had enough before, or aren't though neither had."""
    rows, taken = _landmarks(spark, d)
    marked = rows.join(taken.select("event_id", F.lit(1).alias("t")), "event_id", "left").fillna(0, ["t"])
    before = lambda c: F.coalesce(F.sum("t").over(Window.partitionBy(c).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = (before("c") < 3) & (before("landmark") < 2)
    return marked.withColumn("free", free).agg(F.count(F.lit(1)).alias("photos"), F.coalesce(F.sum((F.col("free") != (F.col("t") == 1)).cast("long")), F.lit(0)).alias("wrong"))


LANDMARKS_HOLD = PHOTOS_SQL + f", p AS (SELECT event_id, {cell_sql(2)} AS c FROM photos WHERE Latitude IS NOT NULL) SELECT count(*) AS photos, CAST(0 AS BIGINT) AS wrong FROM p WHERE c NOT IN (SELECT c FROM p GROUP BY 1 HAVING count(*) >= 12)"


def exact_answers(spark: SparkSession, d: str) -> DataFrame:
    """Percent of right answers, without case and blanks."""
    p = photos(spark, d).select(F.concat(F.lit(" "), F.upper("country")).alias("country"), F.when(F.col("event_id") % 3 == 0, "Kenya").otherwise(F.col("country")).alias("country_true"))
    return metrics.exact_match(p, ["country"])


EXACT_ANSWERS = PHOTOS_SQL + " SELECT round(avg(CAST(event_id % 3 <> 0 OR country = 'Kenya' AS INTEGER)) * 100, 6) AS country FROM photos"


def direction_answers(spark: SparkSession, d: str) -> DataFrame:
    """Percent of right answers by the direction in which pictures were taken, which is the letter behind the digits of their name."""
    e = F.col("event_id")
    name = F.concat(F.lpad(e.cast("string"), 8, "0"), F.element_at(F.array(*map(F.lit, ["N", "e", "S", "w", ""])), (e % 5 + 1).cast("int")), F.lit(".jpg"))
    direction = F.coalesce(F.nullif(F.upper(F.regexp_extract(name, r"(?i)\d{8}([nesw])", 1)), F.lit("")), F.lit("Unknown"))
    p = photos(spark, d).select(direction.alias("direction"), F.upper("country").alias("country"), F.when(e % 3 == 0, "Kenya").otherwise(F.col("country")).alias("country_true"), F.col("continent"), F.when(e % 7 != 0, F.lower("continent")).alias("continent_true"))
    return metrics.exact_match(p, ["country", "continent"], by="direction")


DIRECTION_ANSWERS = PHOTOS_SQL + """
    SELECT list_extract(['N', 'E', 'S', 'W', 'Unknown'], event_id % 5 + 1) AS direction, count(*) AS n, round(avg(CAST(event_id % 3 <> 0 OR country = 'Kenya' AS INTEGER)) * 100, 6) AS country,
           round(avg(CAST(event_id % 7 <> 0 AS INTEGER)) * 100, 6) AS continent FROM photos GROUP BY 1"""


def cell_variety(spark: SparkSession, d: str) -> DataFrame:
    """Photos and different platforms of each cell at resolution 3."""
    return stats.variety(photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 3)), "c", "Platform")


CELL_VARIETY = PHOTOS_SQL + f" SELECT {cell_sql(3)} AS c, count(*) AS n, count(DISTINCT Platform) AS kinds FROM photos WHERE Latitude IS NOT NULL GROUP BY 1"


def null_words(spark: SparkSession, d: str) -> DataFrame:
    """Licences of rows that say nan, None or <NA> instead of nothing."""
    e = F.col("event_id")
    words = F.element_at(F.array(*map(F.lit, ["nan", "None", "<NA>", "NaN", "CC0"])), (e % 5 + 1).cast("int"))
    made = ingest.normalize(photos(spark, d).withColumn("License", words).select("Photo_ID", F.lit("other").alias("Platform"), "Latitude", "Longitude", "Image_URL", "License"))
    return made.select("Photo_ID", "License")


NULL_WORDS = "SELECT CAST(event_id AS VARCHAR) AS Photo_ID, CASE event_id % 5 WHEN 3 THEN 'NaN' WHEN 4 THEN 'CC0' END AS License FROM events"


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a Markdown report, without models whose rows repeat the reference row."""
    n = table(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 5 == 0, "Average Patch").otherwise(F.col("n_name"))
    figure = F.when(F.col("n_nationkey") % 5 == 1, F.col("n_regionkey") * 0 + F.floor(F.col("n_nationkey") / 5) * 5).otherwise(F.col("n_nationkey"))
    lines = n.select(F.floor(F.col("n_nationkey") / 5).alias("model"), F.concat(F.lit("| "), name, F.lit(" | **"), figure.cast("string"), F.lit(".5%** |")).alias("value"))
    parsed = lines.select("model", F.struct("value").alias("v")).select("model", "v.value")
    rows = parsed.select("model", metrics.report_name(F.col("value")).alias("name"), metrics.report_values(F.col("value")).alias("values"))
    return metrics.drop_repeated_rows(rows, "model", "name", "values").select("model", "name", F.col("values")[0].alias("figure"))


REPORT_ROWS = """
    WITH r AS (SELECT n_nationkey // 5 AS model, CASE WHEN n_nationkey % 5 = 0 THEN 'Average Patch' ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey - 1 ELSE n_nationkey END + 0.5e0 AS figure FROM nation)
    SELECT CAST(model AS BIGINT) AS model, name, figure FROM r WHERE name = 'Average Patch' OR NOT EXISTS (SELECT 1 FROM r x WHERE x.model = r.model AND x.name = 'Average Patch' AND x.figure = r.figure)"""


def text_image_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The cosines of every hundredth vector with all."""
    e = table(spark, d, "embeddings")
    return neighbours.similarity_matrix(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")))


TEXT_IMAGE_MATRIX = f"WITH {_UNIT} SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS similarity FROM u x JOIN u y ON x.vec_id % 100 = 0"


def map_zoom(spark: SparkSession, d: str) -> DataFrame:
    """The resolution for a map of each cell of the four coarsest grids, by what its photos span."""
    level = grid.parent(F.col("cell"), F.col("event_id") % 4)
    return stats.map_resolution(photos(spark, d).where("cell is not null"), level.alias("area"))


MAP_ZOOM = PHOTOS_SQL + f""" SELECT area, CASE WHEN s > 100 THEN 4 WHEN s > 30 THEN 5 WHEN s > 5 THEN 6 WHEN s > 1 THEN 7 ELSE 8 END AS resolution
    FROM (SELECT CASE event_id % 4 WHEN 0 THEN {cell_sql(0)} WHEN 1 THEN {cell_sql(1)} WHEN 2 THEN {cell_sql(2)} ELSE {cell_sql(3)} END AS area, greatest(max(Latitude) - min(Latitude), max(Longitude) - min(Longitude)) AS s FROM photos WHERE Latitude IS NOT NULL GROUP BY 1)"""


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Labels of cluster descriptions that a model gave, well formed or not."""
    e = F.col("event_id")
    answer = F.when(e % 4 == 0, F.concat(F.lit('LABEL: **"'), "country", F.lit('"** DESCRIPTION: A road across all frames.'))).when(e % 4 == 1, F.concat(F.lit("LABEL: `"), "country", F.lit("`"))).when(e % 4 == 2, "").otherwise("no idea")
    label, description = text.model_label(answer)
    return photos(spark, d).select("event_id", label.alias("label"), description.alias("description"), text.failed_label(label).alias("failed"))


MODEL_ANSWERS = PHOTOS_SQL + """ SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'Error Labeling' WHEN 3 THEN 'Unlabeled' ELSE country END AS label,
    CASE event_id % 4 WHEN 0 THEN 'A road across the scene.' WHEN 1 THEN 'LABEL: `' || country || '`' WHEN 2 THEN 'Inference failed or returned empty response.' ELSE 'No idea' END AS description, event_id % 4 > 1 AS failed FROM photos"""


def answer_values(spark: SparkSession, d: str) -> DataFrame:
    """A value from model answers that hold broken JSON."""
    e = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure: {"n": '), e, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"n": '), e, F.lit(", }"))).otherwise(F.concat(F.lit("{'n': "), e, F.lit("} done")))
    return photos(spark, d).select("event_id", F.try_variant_get(text.answer_json(raw), "$.n", "long").alias("n"))


ANSWER_VALUES = "SELECT event_id, event_id AS n FROM events"


def answer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts out of model answers whose JSON is among other words, has a comma too many, or stands in a code fence."""
    whole = F.to_json(F.struct(F.col("text").alias("t")))
    i = F.pmod("doc_id", F.lit(3))
    raw = F.when(i == 0, F.concat(F.lit("Sure: "), whole, F.lit(" done"))).when(i == 1, F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(", }"))).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.try_variant_get(text.answer_json(raw), "$.t", "string").cast("binary"), 256).alias("sha256"))


ANSWER_TEXTS = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"


def wkt_points(spark: SparkSession, d: str) -> DataFrame:
    w = F.concat(F.lit("Point("), F.col("Longitude").cast("string"), F.lit(" "), F.col("Latitude").cast("string"), F.lit(")"))
    return photos(spark, d).where("Latitude is not null").select("event_id", geo.wkt_point(w).alias("p")).select("event_id", "p.lat", "p.lon")


WKT_POINTS = PHOTOS_SQL + " SELECT event_id, Latitude AS lat, Longitude AS lon FROM photos WHERE Latitude IS NOT NULL"


def image_bytes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    head = F.when(e % 3 == 0, F.lit(b"\xff\xd8\xff\xe0abc")).when(e % 3 == 1, F.lit(b"RIFF0000WEBP")).otherwise(F.lit(b"<html>"))
    return photos(spark, d).select("event_id", text.valid_image(head).alias("ok"))


IMAGE_BYTES = "SELECT event_id, event_id % 3 < 2 AS ok FROM events"


def archive_photos(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with the first still image of each."""
    p = photos(spark, d)
    occ = p.select(F.col("Photo_ID").alias("gbifID"), F.col("Latitude").cast("string").alias("decimalLatitude"), F.col("Longitude").cast("string").alias("decimalLongitude"), F.col("Captured_At").alias("eventDate"))
    media = p.where(F.col("event_id") % 2 == 0).select(F.col("Photo_ID").alias("gbifID"), F.when(F.col("event_id") % 4 == 0, "StillImage").otherwise("Sound").alias("type"), F.col("Image_URL").alias("identifier"))
    return occurrences.from_archive(occ, media).select("Photo_ID", "Latitude", "Image_URL")


ARCHIVE_PHOTOS = PHOTOS_SQL + " SELECT Photo_ID, Latitude, Image_URL FROM photos WHERE event_id % 4 = 0 AND Latitude IS NOT NULL AND Image_URL LIKE '%.jpg'"


def point_labels(spark: SparkSession, d: str) -> DataFrame:
    """Survey points named by eight digits in a path; the last row of each holds."""
    o = table(spark, d, "orders").select(F.concat(F.lit("/x/"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 8, "0"), F.lit("P.jpg")).alias("path"), "o_orderstatus", F.col("o_orderkey").alias("row_number"))
    return tables.point_metadata(o, "path", ["o_orderstatus"])


POINT_LABELS = "SELECT lpad(CAST(o_orderkey % 50 AS VARCHAR), 8, '0') AS point_id, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"


def shared_projects(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.when(F.col("n_nationkey") % 2 == 0, "Open").otherwise("closed").alias("sharing_preference"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.when(F.col("n_nationkey") % 7 == 0, "DEMO ").otherwise("By "), F.lit("https://raid.org/1"))).otherwise("none").alias("citation"), F.col("n_name").alias("project_name"))
    return filters.shareable_project(n, ("nation_1", " NATION_2", "")).select("project_id", "project_name")


SHARED_PROJECTS = "SELECT n_nationkey AS project_id, n_name AS project_name FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 0 AND (n_name LIKE 'NATION\\_1%' ESCAPE '\\' OR n_name LIKE 'NATION\\_2%' ESCAPE '\\')"


def media_observed(spark: SparkSession, d: str) -> DataFrame:
    """Lines as media, orders as their observations, customers as places."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), "l_linenumber", F.col("l_suppkey").alias("deployment_id"))
    order = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("observation_id"))
    place = table(spark, d, "supplier").select(F.col("s_suppkey").alias("deployment_id"), "s_name")
    return cameras.observed_media(line, order, place).select("media_id", "l_linenumber", "observation_id", "s_name")


MEDIA_OBSERVED = "SELECT l_orderkey AS media_id, l_linenumber, o_custkey AS observation_id, s_name FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey"


def cell_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Centres and western edges of cells at resolution 1."""
    c = photos(spark, d).where("cell is not null").select(grid.parent(F.col("cell"), 1).alias("c")).distinct()
    lat, lon = grid.centre(F.col("c"))
    return c.select("c", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), F.round(F.array_min(F.transform(grid.unwrapped(grid.boundary(F.col("c"))), lambda p: p["lon"])), 4).alias("west"))


CELL_OUTLINES = PHOTOS_SQL + f", c AS (SELECT DISTINCT {cell_sql(1)} AS c, cell_row // {3**10} AS r, cell_col // {3**10} AS k FROM photos WHERE Latitude IS NOT NULL) SELECT c, round((r + 0.5e0) * 15 - 90, 4) AS lat, round((k + 0.5e0) * 15 - 180, 4) AS lon, round(k * 15.0e0 - 180, 4) AS west FROM c"


QUERIES = {
    "cell_sets": (cell_sets, CELL_SETS),
    "cells_scanned": (cells_scanned, CELLS_SCANNED),
    "wide_base": (wide_base, WIDE_BASE),
    "wide_sidecar": (wide_sidecar, WIDE_SIDECAR),
    "purge_report": (purge_report, PURGE_REPORT),
    "renamed_platform": (renamed_platform, RENAMED_PLATFORM),
    "relaxed_sync": (relaxed_sync, RELAXED_SYNC),
    "relative_paths": (relative_paths, RELATIVE_PATHS),
    "unlisted_files": (unlisted_files, UNLISTED_FILES),
    "audited": (audited, AUDITED),
    "track_lengths": (track_lengths, TRACK_LENGTHS),
    "parents_weighted": (parents_weighted, PARENTS_WEIGHTED),
    "interleaved": (interleaved, INTERLEAVED),
    "balanced_counts": (balanced_counts, BALANCED_COUNTS),
    "outcome_counts": (outcome_counts, OUTCOME_COUNTS),
    "landmark_samples": (landmark_samples, None),
    "landmarks_hold": (landmarks_hold, LANDMARKS_HOLD),
    "exact_answers": (exact_answers, EXACT_ANSWERS),
    "report_rows": (report_rows, REPORT_ROWS),
    "text_image_matrix": (text_image_matrix, TEXT_IMAGE_MATRIX),
    "map_zoom": (map_zoom, MAP_ZOOM),
    "model_answers": (model_answers, MODEL_ANSWERS),
    "answer_values": (answer_values, ANSWER_VALUES),
    "answer_texts": (answer_texts, ANSWER_TEXTS),
    "direction_answers": (direction_answers, DIRECTION_ANSWERS),
    "cell_variety": (cell_variety, CELL_VARIETY),
    "null_words": (null_words, NULL_WORDS),
    "wkt_points": (wkt_points, WKT_POINTS),
    "image_bytes": (image_bytes, IMAGE_BYTES),
    "archive_photos": (archive_photos, ARCHIVE_PHOTOS),
    "point_labels": (point_labels, POINT_LABELS),
    "shared_projects": (shared_projects, SHARED_PROJECTS),
    "media_observed": (media_observed, MEDIA_OBSERVED),
    "cell_outlines": (cell_outlines, CELL_OUTLINES),
}
