"""Source shapes, addresses, JSON fields, shards, projected rasters, galleries, and checks of greedy results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import climate, geo, grid, keys, text
from geomill.operators import cluster, ingest, metrics, near_dup, neighbours, regions, sampling, stats
from geomill.plans.q_aggregates import LABELLED, labelled
from geomill.plans.q_geo import PHOTO_BOXES, photo_boxes
from geomill.plans.q_vectors import _KM, _KNN, _UNIT, _knn, labelled_bank
from geomill.plans.views import PHOTOS_SQL, cell_sql, in_cells, photos, table
from geomill.sources import shared


def source_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Three shapes of sources as one table: a street-view collection, camera-trap files, and another."""
    p = photos(spark, d)
    e = F.col("event_id")
    street = p.where(e % 3 == 0).select(F.col("Image_URL").alias("uuid"), "Platform", F.upper("Platform").alias("source"), F.concat("Photo_ID", F.lit(".0")).alias("orig_id"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("Image_URL").alias("url"))
    traps = p.where(e % 3 == 1).select(F.col("Photo_ID").alias("ID"), F.lit("wrong").alias("Platform"), "Latitude", "Longitude", F.col("Image_URL").alias("Image_Location"))
    other = p.where(e % 3 == 2).select(F.col("Photo_ID").alias("photo_id"), F.col("Latitude").cast("string").alias("latitude"), F.col("Longitude").cast("string").alias("longitude"), F.col("Image_URL").alias("image_url"), F.col("License").alias("license"))
    made = ingest.concat(ingest.normalize(street), ingest.normalize(traps, F.lit("/data/iWildCam_train.csv")), ingest.normalize(other, F.lit("/data/Flickr_tiles.csv")))
    return made.select("photo_key", "Platform", F.round("Latitude", 4).alias("Latitude"), "Image_URL", "License")


SOURCE_SHAPES = PHOTOS_SQL + f"""
    , s AS (SELECT CASE event_id % 3 WHEN 0 THEN Platform WHEN 1 THEN 'iwildcam' ELSE 'flickr' END AS p, * EXCLUDE (Platform) FROM photos)
    SELECT p || '_' || Photo_ID AS photo_key, p AS "Platform", round(Latitude, 4) AS "Latitude", CASE WHEN p IN ('mapillary', 'kartaview') THEN p || '://' || Photo_ID ELSE Image_URL END AS "Image_URL",
           CASE WHEN p IN ('mapillary', 'kartaview') THEN 'CC BY-SA 4.0' WHEN p = 'iwildcam' THEN 'CDLA-Permissive-1.0' WHEN p = 'inaturalist' THEN 'CC BY-NC 4.0'
                WHEN event_id % 3 = 2 THEN CASE License {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.FLICKR_LICENSES.items())} ELSE License END END AS "License" FROM s"""


def number_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids out of a column of floating-point numbers."""
    e = F.col("event_id")
    return photos(spark, d).select("event_id", keys.photo_id_of_number(F.when(e % 3 == 0, e.cast("double")).when(e % 3 == 1, e + F.lit(0.5))).alias("clean_id"))


NUMBER_IDS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || '.5' ELSE '' END AS clean_id FROM events"


def sniffed_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Street-level pictures told by their platform or by where they are served."""
    e = F.col("event_id")
    url = F.when(e % 7 == 1, F.concat(F.lit("https://x.fbcdn.net/"), "Photo_ID")).when(e % 7 == 2, "https://cdn.openstreetcam.org/a").otherwise(F.col("Image_URL"))
    pid = F.when(e % 5 != 0, F.concat("Photo_ID", F.lit(".0")))
    return photos(spark, d).select("event_id", keys.sniffed_address(F.col("Platform"), pid, url).alias("address"))


SNIFFED_ADDRESSES = PHOTOS_SQL + """
    SELECT event_id, CASE WHEN event_id % 5 <> 0 AND (Platform = 'mapillary' OR event_id % 7 = 1) THEN 'mapillary://' || Photo_ID
        WHEN event_id % 5 <> 0 AND (Platform = 'kartaview' OR event_id % 7 = 2) THEN 'kartaview://' || Photo_ID
        WHEN event_id % 7 = 1 THEN 'https://x.fbcdn.net/' || Photo_ID WHEN event_id % 7 = 2 THEN 'https://cdn.openstreetcam.org/a' ELSE Image_URL END AS address FROM photos"""


def local_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of an offline copy, of which some lie beside the table, some in its folder for training, some nowhere."""
    p, e = photos(spark, d), F.col("event_id")
    listed = p.select("event_id", F.concat_ws("_", "Platform", "Photo_ID").alias("photo_key"), F.concat(F.lit("./a/"), "Photo_ID", F.lit(".jpg")).alias("Image_Location"), F.when(e % 4 == 3, F.lit("b/c.jpg")).when(e % 4 != 0, F.col("Image_URL")).alias("Image_URL"))
    files = p.where(e % 3 != 2).select(F.concat(F.lit("/d/"), F.when(e % 3 == 0, "a/").otherwise("train/"), "Photo_ID", F.lit(".jpg")).alias("path"))
    return ingest.with_local_pictures(listed, files, F.lit("/d")).select("event_id", "Image_URL")


LOCAL_PICTURES = PHOTOS_SQL + """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/d/a/' || Photo_ID || '.jpg' WHEN event_id % 3 = 1 THEN '/d/train/' || Photo_ID || '.jpg' WHEN event_id % 4 = 3 THEN '/d/b/c.jpg'
        WHEN event_id % 4 <> 0 THEN Image_URL ELSE '/d/a/' || Photo_ID || '.jpg' END AS "Image_URL" FROM photos"""


def joined_by_uuid(spark: SparkSession, d: str) -> DataFrame:
    """What two files of one collection say of each picture that both have."""
    p = photos(spark, d).withColumn("uuid", F.concat(F.lit("u"), "Photo_ID"))
    return ingest.joined_by_uuid(p.where("event_id % 2 = 0").select("uuid", "country", "Platform"), p.where("event_id % 3 = 0").select("uuid", "cell", "ts"), ("country", "cell"))


JOINED_BY_UUID = PHOTOS_SQL + f" SELECT 'u' || Photo_ID AS uuid, country, CASE WHEN Latitude IS NOT NULL THEN {cell_sql(grid.FINEST)} END AS cell FROM photos WHERE event_id % 6 = 0"


def natural_files(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the natural order of file names, folder by folder."""
    from pyspark.sql.window import Window

    path = F.concat(F.lit("part-0/"), F.col("n_nationkey").cast("string"), F.lit("x"), F.length("n_name").cast("string"), F.lit(".csv"))
    files = table(spark, d, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("a/"), F.char(F.lit(122) - F.col("n_nationkey")))).otherwise(path).alias("path"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(*keys.natural_order(F.col("path")))))


NATURAL_FILES = """
    WITH f AS (SELECT n_regionkey, n_nationkey AS k, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'a/' || chr(CAST(122 - n_nationkey AS INTEGER)) ELSE 'part-0/' || n_nationkey || 'x' || length(n_name) || '.csv' END AS path FROM nation)
    SELECT n_regionkey, path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY k % 5 = 0, CASE WHEN k % 5 <> 0 THEN k END, path) AS INTEGER) AS place FROM f"""


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Nested fields, dates in wrappers, licences and flattened text of project records."""
    e = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    date = F.when(e % 3 == 0, F.concat(F.lit('{"$date": "'), day, F.lit('"}'))).when(e % 3 == 1, F.concat(F.lit('"'), day, F.lit('"'))).otherwise(F.concat(F.lit('{"$date": {"$numberLong": "'), e.cast("string"), F.lit('"}}')))
    record = F.concat(F.lit('{"id": '), e.cast("string"), F.when(e % 2 == 0, F.concat(F.lit(', "meta": {"tags": ["a", "b"], "pref": "open"}'))).otherwise(""), F.lit(', "at": '), date, F.lit("}"))
    named = lambda scope, name: F.struct(F.lit(name).cast("string").alias("name"), F.lit(scope).cast("string").alias("scope"))
    licenses = F.when(e % 4 == 0, F.array(named("data", "CC0"), named("media", "CC-BY-NC-4.0"))).when(e % 4 == 1, F.array(named("media", ""), named("data", "CC0"))).when(e % 4 == 2, F.array(named("media", None)))
    p = photos(spark, d).where("ts is not null").select("event_id", record.alias("r"), licenses.alias("licenses"))
    r = F.col("r")
    return p.select("event_id", keys.json_field(r, "$.meta.pref", "closed").alias("pref"), keys.json_field(r, "$.at").alias("at"), keys.media_license(F.col("licenses")).alias("license"), text.flat_json(F.get_json_object(r, "$.meta")).alias("meta"))


JSON_FIELDS = """
    SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'open' ELSE 'closed' END AS pref, CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) ELSE strftime(ts, '%Y-%m-%d') END AS "at",
           CASE event_id % 4 WHEN 0 THEN 'CC-BY-NC-4.0' WHEN 1 THEN 'CC0' ELSE 'CC-BY-4.0' END AS license, CASE event_id % 2 WHEN 0 THEN 'tags: a, b, pref: open' END AS meta FROM events WHERE ts IS NOT NULL"""


def sharded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A grid of boxes over all photos, dealt among three jobs that look for photos: each box has one job, whatever the order, and no photo is missed."""
    boxes, p = photo_boxes(spark, d), photos(spark, d).select("Latitude", "Longitude", "event_id")
    jobs = [regions.shard(boxes, "box_id", 3, i).withColumn("job", F.lit(i)) for i in range(3)]
    dealt = jobs[0].unionByName(jobs[1]).unionByName(jobs[2])
    each = dealt.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))
    found = regions.box_hits(p, dealt, 2).agg(F.count(F.lit(1)).alias("found"))
    return boxes.join(each, "box_id", "left").agg(F.count(F.lit(1)).alias("boxes"), F.sum((F.col("n") == 1).cast("long")).alias("dealt_once")).crossJoin(found)


SHARDED_BOXES = PHOTO_BOXES + " SELECT (SELECT count(*) FROM boxes) AS boxes, (SELECT count(*) FROM boxes) AS dealt_once, (SELECT count(*) FROM photos JOIN boxes ON Latitude BETWEEN south AND north AND Longitude BETWEEN west AND east) AS found"

_BOXES = [(f"b{i}", -60.0 + 7 * i, -60.0 + 7 * i + (0.02 if i % 2 else 5.0), -170.0 + 19 * i, -170.0 + 19 * i + (0.02 if i % 2 else 12.0)) for i in range(17)]


def empty_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that hold no photo, and whether they meet two regions."""
    boxes = spark.createDataFrame(_BOXES, "box_id string, south double, north double, west double, east double")
    empty = regions.uncovered_boxes(photos(spark, d).where("Latitude is not null"), boxes)
    land = spark.createDataFrame([(-50.0, 0.0, -150.0, -20.0), (10.0, 60.0, 20.0, 150.0)], "south double, north double, west double, east double")
    meets = regions.boxes_meeting(boxes, land).select("box_id", F.lit(True).alias("on_land"))
    return empty.join(meets, "box_id", "left").select("box_id", F.coalesce("on_land", F.lit(False)).alias("on_land"))


EMPTY_BOXES = PHOTOS_SQL + f""", b(box_id, south, north, west, east) AS (VALUES {", ".join(f"('{n}', {s}::DOUBLE, {t}::DOUBLE, {w}::DOUBLE, {e}::DOUBLE)" for n, s, t, w, e in _BOXES)})
    SELECT box_id, (south < 0 AND north > -50 AND west < -20 AND east > -150) OR (south < 60 AND north > 10 AND west < 150 AND east > 20) AS on_land FROM b
    WHERE NOT EXISTS (SELECT 1 FROM photos WHERE Latitude BETWEEN south AND north AND Longitude BETWEEN west AND east)"""


def crossing_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Photos in boxes over the antimeridian, written both ways."""
    boxes = spark.createDataFrame([("east", -60.0, 60.0, 170.0, -175.0), ("far", -20.0, 20.0, 175.0, 190.0), ("west", -10.0, 30.0, -190.0, -178.0)], "box_id string, south double, north double, west double, east double")
    return regions.box_hits(photos(spark, d), boxes).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))


CROSSING_BOXES = PHOTOS_SQL + """
    SELECT box_id, count(*) AS n FROM photos JOIN (VALUES ('east', -60, 60, 170, 185), ('far', -20, 20, 175, 190), ('west', -10, 30, 170, 182)) b(box_id, south, north, west, east)
        ON Latitude BETWEEN south AND north AND ((Longitude >= west AND Longitude <= 180) OR Longitude <= east - 360) GROUP BY 1"""


def projected_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a raster on the European equal-area grid, by a legend."""
    raster = spark.range(60 * 60).select(F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), (F.col("id") % 11).cast("double").alias("value"))
    legend = spark.createDataFrame([(str(k), f"class {k}") for k in range(9)], "key string, label string")
    p = regions.projected_lookup(photos(spark, d).select("event_id", "Latitude", "Longitude"), raster, 1_000_000.0, 6_000_000.0, 100_000.0)
    return regions.class_label(p.where("value is not null"), legend, "value").select("event_id", "label")


PROJECTED_LOOKUP = PHOTOS_SQL + f"""
    , k AS (SELECT 6378137.0e0 AS a, 1 / 298.257222101e0 AS f), k1 AS (SELECT a, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM k),
    k2 AS (SELECT *, sin(radians(52.0e0)) AS s0, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp FROM k1),
    k3 AS (SELECT *, a * sqrt(qp / 2) AS r, asin((1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) / qp) AS b0 FROM k2),
    k4 AS (SELECT *, a * cos(radians(52.0e0)) / sqrt(1 - e2 * s0 * s0) / (r * cos(b0)) AS dd FROM k3),
    u AS (SELECT event_id, radians(Longitude - 10) AS l, asin((1 - e2) * (sin(radians(Latitude)) / (1 - e2 * pow(sin(radians(Latitude)), 2)) - ln((1 - e * sin(radians(Latitude))) / (1 + e * sin(radians(Latitude)))) / (2 * e)) / qp) AS b, r, b0, dd
          FROM photos, k4 WHERE Latitude IS NOT NULL AND Latitude BETWEEN -89.99 AND 89.99 AND NOT (Latitude = 0 AND Longitude = 0)),
    v AS (SELECT *, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS bb FROM u),
    w AS (SELECT event_id, floor((6000000 - (3210000 + bb / dd * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l)))) / 100000) AS rw, floor((4321000 + bb * dd * cos(b) * sin(l) - 1000000) / 100000) AS cl FROM v)
    SELECT event_id, CASE WHEN CAST(rw * 60 + cl AS BIGINT) % 11 < 9 THEN 'class ' || CAST(rw * 60 + cl AS BIGINT) % 11 ELSE 'Unknown' END AS label FROM w WHERE rw BETWEEN 0 AND 59 AND cl BETWEEN 0 AND 59"""


def habitat_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of raster values that come as text, as numbers with decimals, or not at all."""
    e = F.col("event_id")
    code = F.when(e % 4 == 0, (e % 23).cast("string")).when(e % 4 == 1, F.concat((e % 23).cast("string"), F.lit(".0"))).when(e % 4 == 2, F.concat(F.lit(" "), F.char(F.lit(65) + e % 12)))
    return table(spark, d, "events").select("event_id", climate.named(code, climate.ECOSYSTEMS).alias("ecosystem"), climate.named(code, climate.ENVIRONMENTAL_ZONES).alias("zone"))


def _named_sql(names: dict[str, str]) -> str:
    return f"CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} ELSE 'Unknown' END"


HABITAT_NAMES = f"""
    WITH c AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 23 AS VARCHAR) WHEN event_id % 4 = 2 THEN chr(CAST(65 + event_id % 12 AS INTEGER)) END AS code FROM events)
    SELECT event_id, {_named_sql(climate.ECOSYSTEMS)} AS ecosystem, {_named_sql(climate.ENVIRONMENTAL_ZONES)} AS zone FROM c"""


def bin_gallery(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of the largest clusters of each square of a scatter plot."""
    e = table(spark, d, "embeddings")
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    clusters = e.select((F.col("vec_id") % 97).alias("cluster"), x.alias("x"), y.alias("y")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.floor(F.round(F.avg("x"), 6) * 20).alias("bx"), F.floor(F.round(F.avg("y"), 6) * 20).alias("by"))
    shown = clusters.withColumn("address", F.when(F.col("cluster") % 6 != 0, F.concat(F.lit("https://img/"), F.col("cluster").cast("string"))))
    return stats.gallery(shown, ["bx", "by"], "cluster", "n", "address")


BIN_GALLERY = """
    WITH c AS (SELECT vec_id % 97 AS cluster, count(*) AS n, CAST(floor(round(avg(CAST(embedding[1] AS DOUBLE)), 6) * 20) AS BIGINT) AS bx, CAST(floor(round(avg(CAST(embedding[2] AS DOUBLE)), 6) * 20) AS BIGINT) AS "by" FROM embeddings GROUP BY 1)
    SELECT bx, "by", CAST(row_number() OVER (PARTITION BY bx, "by" ORDER BY n DESC, cluster) AS INTEGER) AS rank, cluster, 'https://img/' || cluster AS address FROM c WHERE cluster % 6 <> 0 QUALIFY rank <= 4"""


def geographic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores where a result within so many kilometres is a hit."""
    p = photos(spark, d).where("Latitude is not null").select(F.col("event_id").alias("i"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    a, b = (p.select(*[F.col(c).alias(f"{x}_{c}") for c in p.columns]) for x in "ab")
    r = _knn(spark, d, 10).join(a, F.col("query_id") == F.col("a_i")).join(b, F.col("id") == F.col("b_i"))
    km = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return metrics.means(metrics.geographic_scores(r.select("query_id", "rank", km.alias("km")), 5000.0))


GEOGRAPHIC_SCORES = PHOTOS_SQL + f""", {_KNN}, pl AS (SELECT event_id AS i, Latitude AS lat, Longitude AS lon FROM photos WHERE Latitude IS NOT NULL),
    r AS (SELECT query_id, rank, CAST({_KM} <= 5000 AS INTEGER) AS h FROM (SELECT query_id, rank, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS x
          FROM knn JOIN pl a ON a.i = query_id JOIN pl b ON b.i = id WHERE rank <= 10)),
    t AS (SELECT *, h * sum(h) OVER (PARTITION BY query_id ORDER BY rank) / rank AS part FROM r),
    q AS (SELECT round(sum(h) / 10.0e0, 6) AS p, round(coalesce(sum(part) / nullif(sum(h), 0), 0), 6) AS ap, round(coalesce(1 / min(CASE WHEN h = 1 THEN rank END), 0), 6) AS rr FROM t GROUP BY query_id)
    SELECT count(*) AS queries, round(avg(p), 6) AS mean_precision, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM q"""


def dedup_holds(spark: SparkSession, d: str) -> DataFrame:
    """Of the greedy result in cells, counted pair by pair: kept photos too like an earlier kept one, and dropped ones without one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = in_cells(photos(spark, d).select("event_id", "vec_id", "cell"), 2).select("event_id", "vec_id", "c").where("c is not null")
    kept = near_dup.dedup_cells(p.join(e, "vec_id"), "c", ["event_id"], threshold=0.6, id_col="event_id").select("event_id", F.lit(True).alias("kept"))
    marked = shared.written(p.join(kept, "event_id", "left").fillna(False, ["kept"]), "marked")
    met = near_dup.pairs_checked(marked.join(e, "vec_id"), "c", "event_id", "embedding", "kept", 0.6)
    number = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return met.agg(number(F.col("kept") & F.col("like")).alias("kept_too_alike"), number(~F.col("kept") & ~F.col("like")).alias("dropped_alone"))


DEDUP_HOLDS = "SELECT CAST(0 AS BIGINT) AS kept_too_alike, CAST(0 AS BIGINT) AS dropped_alone"


def split_holds(spark: SparkSession, d: str) -> DataFrame:
    """Of the split of spatial blocks: blocks, blocks on both sides, and classes of two blocks or more without one on each side."""
    p = labelled(spark, d).withColumn("c", grid.parent(F.col("cell"), 1)).where("c is not null")
    split = sampling.query_blocks(p, "c", "cluster_id")
    sides = split.groupBy("block").agg(F.countDistinct("is_query").alias("n"))
    per_class = p.select("cluster_id", F.col("c").alias("block")).distinct().join(split, "block").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("is_query").alias("sides"))
    return sides.agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("n") > 1).cast("long")).alias("on_both")).crossJoin(per_class.agg(F.sum(((F.col("blocks") > 1) & (F.col("sides") < 2)).cast("long")).alias("one_sided")))


SPLIT_HOLDS = LABELLED + f" SELECT count(DISTINCT {cell_sql(1)}) AS blocks, CAST(0 AS BIGINT) AS on_both, CAST(0 AS BIGINT) AS one_sided FROM labelled WHERE Latitude IS NOT NULL"


def target_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sample whose cap per cell comes nearest to a size."""
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 2))
    cap = sampling.cap_for_size(p, "c", 700)
    return sampling.cell_cap(p, "c", cap, "event_id").groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"))


TARGET_COUNTS = PHOTOS_SQL + f"""
    , h AS (SELECT {cell_sql(2)} AS c, count(*) AS n FROM photos WHERE Latitude IS NOT NULL GROUP BY 1),
    t AS (SELECT cap, CAST(sum(least(cap, n)) AS BIGINT) AS got FROM h, range(1, (SELECT max(n) + 1 FROM h)) r(cap) GROUP BY 1)
    SELECT got AS "rows", least(cap, (SELECT max(n) FROM h)) AS most FROM t ORDER BY abs(got - 700), cap LIMIT 1"""


def hierarchy_holds(spark: SparkSession, d: str) -> DataFrame:
    """Of the two-level clustering: rows, numbers out of range, and clusters under two parents. It says nothing of how good the clusters are."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    fitted = cluster.fit_hierarchy(e, 12, 3, id_col="vec_id")
    bad = ~(F.col("cluster_id").between(0, 11) & F.col("parent_cluster_id").between(0, 2))
    parents = fitted.groupBy("cluster_id").agg(F.countDistinct("parent_cluster_id").alias("p")).agg(F.sum((F.col("p") > 1).cast("long")).alias("two_parents"))
    return fitted.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"), F.sum(bad.cast("long")).alias("out_of_range")).crossJoin(parents)


HIERARCHY_HOLDS = 'SELECT count(*) AS "rows", count(DISTINCT vec_id) AS ids, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS two_parents FROM embeddings'


def medoid_firsts(spark: SparkSession, d: str) -> DataFrame:
    """The first medoid of each label: the nearest to its centroid."""
    bank = labelled_bank(spark, d)
    return cluster.diverse_medoids(photos(spark, d), cluster.centroids(bank, weight="photos"), 2, id_col="event_id", bank=bank).where("pick = 1").select("cluster_id", "id")


MEDOID_FIRSTS = PHOTOS_SQL + f""", {_UNIT}, m AS (SELECT event_id, label, v FROM photos JOIN u USING (vec_id)),
    w AS (SELECT vec_id, any_value(label) AS label, any_value(v) AS v, count(*) AS n FROM photos JOIN u USING (vec_id) GROUP BY 1),
    cc AS (SELECT label, i, sum(n * v[i]) / sum(n) AS x FROM w, range(1, 65) r(i) GROUP BY ALL), ce AS (SELECT label, list(x ORDER BY i) AS c FROM cc GROUP BY 1),
    s AS (SELECT label, event_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS s FROM m JOIN ce USING (label))
    SELECT CAST(label AS BIGINT) AS cluster_id, event_id AS id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, event_id) = 1"""


QUERIES = {
    "source_shapes": (source_shapes, SOURCE_SHAPES),
    "number_ids": (number_ids, NUMBER_IDS),
    "sniffed_addresses": (sniffed_addresses, SNIFFED_ADDRESSES),
    "local_pictures": (local_pictures, LOCAL_PICTURES),
    "joined_by_uuid": (joined_by_uuid, JOINED_BY_UUID),
    "natural_files": (natural_files, NATURAL_FILES),
    "json_fields": (json_fields, JSON_FIELDS),
    "sharded_boxes": (sharded_boxes, SHARDED_BOXES),
    "empty_boxes": (empty_boxes, EMPTY_BOXES),
    "crossing_boxes": (crossing_boxes, CROSSING_BOXES),
    "projected_lookup": (projected_lookup, PROJECTED_LOOKUP),
    "habitat_names": (habitat_names, HABITAT_NAMES),
    "bin_gallery": (bin_gallery, BIN_GALLERY),
    "geographic_scores": (geographic_scores, GEOGRAPHIC_SCORES),
    "dedup_holds": (dedup_holds, DEDUP_HOLDS),
    "split_holds": (split_holds, SPLIT_HOLDS),
    "target_counts": (target_counts, TARGET_COUNTS),
    "hierarchy_holds": (hierarchy_holds, HIERARCHY_HOLDS),
    "medoid_firsts": (medoid_firsts, MEDOID_FIRSTS),
}
