"""Aggregations, windows, samples, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import grid, times
from geomill.operators import anomaly, cluster, index, metrics, sampling, stats, trajectory
from geomill.plans.q_rows import _PLAIN
from geomill.plans.views import PHOTOS_SQL, cell_sql, photos, table


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Photos with season, time of day and their cluster."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("cluster_id"))
    p = photos(spark, d).withColumns({"Season": times.season(F.col("Captured_At"), F.col("Latitude")), "Time_Of_Day": times.time_of_day(F.col("Captured_At"))})
    return p.join(e, "vec_id").withColumns({"cluster_label": F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")), "cluster_description": F.lit(None).cast("string"), "parent_cluster_id": F.floor(F.col("cluster_id") / 3).cast("long")})


LABELLED = PHOTOS_SQL + f""", labelled AS (SELECT *, {_PLAIN} AS Season,
        CASE WHEN h IS NULL THEN 'Unknown' WHEN h BETWEEN 5 AND 7 THEN 'Dawn' WHEN h BETWEEN 8 AND 11 THEN 'Morning' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 19 THEN 'Dusk' ELSE 'Night' END AS Time_Of_Day
    FROM (SELECT *, CAST(Captured_At[6:7] AS INTEGER) AS m, CAST(Captured_At[12:13] AS INTEGER) AS h, CAST(label AS BIGINT) AS cluster_id FROM photos JOIN embeddings USING (vec_id)))"""
_INDEX_KEYS = "Season, Time_Of_Day, Koppen_Code, country, continent, cluster_id"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return index.build(labelled(spark, d))


def _index_sql(resolutions: range) -> str:
    return " UNION ALL ".join(f"SELECT {r} AS resolution, {cell_sql(r)} AS query_cell, {_INDEX_KEYS}, 'Cluster ' || cluster_id AS cluster_label, CAST(NULL AS VARCHAR) AS cluster_description, cluster_id // 3 AS parent_cluster_id, count(*) AS image_count FROM labelled WHERE Latitude IS NOT NULL GROUP BY {cell_sql(r)}, {_INDEX_KEYS}" for r in resolutions)


SPATIAL_INDEX = LABELLED + " " + _index_sql(range(1, 12))


def cell_cluster_share(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: cells, index, share of each cluster in each cell at resolution 3."""
    return index.shares(_index(spark, d), 3)


_CELLS = lambda r: LABELLED + f", c AS (SELECT {cell_sql(r)} AS query_cell, cluster_id, count(*) AS n FROM labelled WHERE Latitude IS NOT NULL GROUP BY ALL)"
CELL_CLUSTER_SHARE = _CELLS(3) + " SELECT query_cell, cluster_id, n, round(n * 100.0e0 / sum(n) OVER (PARTITION BY query_cell), 6) AS percent FROM c"


def point_hit(spark: SparkSession, d: str) -> DataFrame:
    return index.point(_index(spark, d), 10.0, 20.0, 2)


def point_ring(spark: SparkSession, d: str) -> DataFrame:
    """A cell without images among cells that have some: the ring answers."""
    near = labelled(spark, d).where((F.abs(F.col("Latitude") - 10.0) > 0.9) | (F.abs(F.col("Longitude") - 20.0) > 0.9))
    return index.point(index.build(near), 10.1, 20.1, 4)


def _point_sql(lat: float, lon: float, r: int, where: str) -> str:
    size = f"(45.0e0 / {3**grid.FINEST})"
    step = 3 ** (grid.FINEST - r)
    row, col = f"(CAST(floor(({lat}e0 + 90) / {size}) AS BIGINT) // {step})", f"(CAST(floor(({lon}e0 + 180) / {size}) AS BIGINT) // {step})"
    return LABELLED + f""", g AS (SELECT cluster_id, cell_row // {step} = {row} AND cell_col // {step} = {col} AS hit FROM labelled WHERE Latitude IS NOT NULL AND {where} AND abs(cell_row // {step} - {row}) <= 1 AND abs(cell_col // {step} - {col}) <= 1),
    n AS (SELECT cluster_id, hit, count(*) AS n FROM g WHERE hit OR NOT EXISTS (SELECT 1 FROM g WHERE hit) GROUP BY ALL)
    SELECT cluster_id, 'Cluster ' || cluster_id AS cluster_label, CAST(NULL AS VARCHAR) AS cluster_description, CASE WHEN hit THEN 'cell' ELSE 'ring' END AS source, n, round(n * 100.0e0 / sum(n) OVER (), 6) AS percent FROM n"""


def top_cell_clusters(spark: SparkSession, d: str) -> DataFrame:
    return index.top_clusters(_index(spark, d), 2, 3, 5)


TOP_CELL_CLUSTERS = _CELLS(2) + """, t AS (SELECT query_cell, cluster_id, n, CAST(row_number() OVER (PARTITION BY query_cell ORDER BY n DESC, cluster_id) AS INTEGER) AS rank, sum(n) OVER (PARTITION BY query_cell) AS total FROM c)
    SELECT query_cell, cluster_id, n, rank, CAST(total AS BIGINT) AS total, round(log10(greatest(total, 1)), 6) AS log_total FROM t WHERE rank <= 3 AND total >= 5"""


def cluster_cells(spark: SparkSession, d: str) -> DataFrame:
    return index.cluster_cells(_index(spark, d), 2)


CLUSTER_CELLS = _CELLS(2) + " SELECT cluster_id, list_sort(list(query_cell)) AS cells FROM c GROUP BY 1"


def uncovered_cells(spark: SparkSession, d: str) -> DataFrame:
    land = spark.range(0, 12 * 24).select(grid.cell(F.floor(F.col("id") / 24), F.col("id") % 24, 1).alias("query_cell"))
    return index.uncovered(land, photos(spark, d), 1, 3)


UNCOVERED_CELLS = PHOTOS_SQL + f" SELECT l.c AS query_cell FROM (SELECT {grid._RES} + (i // 24) * {grid._ROW} + i % 24 AS c FROM range(288) t(i)) l WHERE l.c NOT IN (SELECT {cell_sql(1)} FROM photos WHERE Latitude IS NOT NULL GROUP BY 1 HAVING count(*) > 3)"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Photos of which some were put on one latitude, on null island or on the diagonal."""
    e = F.col("event_id")
    p = photos(spark, d)
    lat = F.when(e % 29 == 0, 12.34).when(e % 31 == 0, 0.01).when(e % 37 == 0, F.col("Longitude") / 4).otherwise(F.col("Latitude"))
    lon = F.when(e % 31 == 0, 0.02).when((e % 37 == 0) & (e % 29 != 0), F.col("Longitude") / 4).otherwise(F.col("Longitude"))
    return p.select("event_id", "Platform", "continent", "user_id", lat.alias("Latitude"), lon.alias("Longitude"), F.concat_ws("_", "Platform", "Photo_ID").alias("photo_key"))


_DIRTY = PHOTOS_SQL + """, dirty AS (SELECT event_id, Platform, continent, user_id, Platform || '_' || Photo_ID AS photo_key,
        CASE WHEN event_id % 29 = 0 THEN 12.34e0 WHEN event_id % 31 = 0 THEN 0.01e0 WHEN event_id % 37 = 0 THEN Longitude / 4 ELSE Latitude END AS Latitude,
        CASE WHEN event_id % 31 = 0 THEN 0.02e0 WHEN event_id % 37 = 0 AND event_id % 29 <> 0 THEN Longitude / 4 ELSE Longitude END AS Longitude FROM photos),
    lines AS (SELECT Platform, continent, round_even(Latitude, 5) AS lat_round, count(Longitude) AS n, min(Longitude) AS min_lon, max(Longitude) AS max_lon FROM dirty WHERE Latitude IS NOT NULL GROUP BY 1, 2, 3 HAVING count(Longitude) > 10 AND max(Longitude) - min(Longitude) > 1),
    bad AS (SELECT d.*, l.n IS NOT NULL OR coalesce((abs(Latitude) < 0.05 AND abs(Longitude) < 0.05) OR (abs(Latitude - Longitude) < 1e-5 AND abs(Latitude) > 1), false) AS bad
            FROM dirty d LEFT JOIN lines l ON d.Platform = l.Platform AND d.continent = l.continent AND round_even(d.Latitude, 5) = l.lat_round)"""


def locked_lines(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.locked_latitudes(_dirty(spark, d))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.clean_coordinates(_dirty(spark, d)).select("event_id", "Latitude", "Longitude")


def cleaned_sequences(spark: SparkSession, d: str) -> DataFrame:
    p = _dirty(spark, d)
    members = p.where((F.col("event_id") % 2 == 0) & F.col("user_id").isNotNull()).select("photo_key", (F.col("user_id") * 100 + F.col("event_id") % 100).alias("sequence_id"))
    return anomaly.clean_coordinates(p, sequences=members).select("event_id")


CLEANED_SEQUENCES = _DIRTY + """, s AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN user_id * 100 + event_id % 100 END AS q FROM bad)
    SELECT event_id FROM s WHERE NOT bad AND (q IS NULL OR q NOT IN (SELECT q FROM s WHERE bad AND q IS NOT NULL))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as tracks in small steps."""
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("sequence_id"), e.cast("string").alias("photo_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_at"), (e * 7919 % 997 / F.lit(10000.0) + 40).alias("lat"), (e * 104729 % 991 / F.lit(10000.0) + 9).alias("lon"))


def trajectory_metrics(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.metrics(_points(spark, d))


def trajectory_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.validate(_points(spark, d), min_frames=8).select("sequence_id", "frames", "is_valid", F.split("reason", ":")[0].alias("reason"))


def _hav(a: str, b: str, c: str, e: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))"
    return f"12742000.0e0 * atan2(sqrt({x}), sqrt(1 - {x}))"


_TRACKS = f"""
    WITH p AS (SELECT user_id AS sequence_id, CAST(event_id AS VARCHAR) AS photo_id, (epoch_us(ts) // 1000) AS t, (event_id * 7919 % 997) / 10000.0e0 + 40 AS lat, (event_id * 104729 % 991) / 10000.0e0 + 9 AS lon FROM events),
    w AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, t - lag(t) OVER o AS dt, avg(lat) OVER (PARTITION BY sequence_id) AS mlat, avg(lon) OVER (PARTITION BY sequence_id) AS mlon,
               first_value(lat) OVER a AS lat0, first_value(lon) OVER a AS lon0, last_value(lat) OVER a AS lat1, last_value(lon) OVER a AS lon1
          FROM p WINDOW o AS (PARTITION BY sequence_id ORDER BY t, photo_id), a AS (PARTITION BY sequence_id ORDER BY t, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    s AS (SELECT *, {_hav('plat', 'plon', 'lat', 'lon')} AS step FROM w),
    g AS (SELECT sequence_id, count(*) AS frame_count, sum(step) AS total, any_value({_hav('lat0', 'lon0', 'lat1', 'lon1')}) AS net, max({_hav('mlat', 'mlon', 'lat', 'lon')}) AS radius,
                 list_sort(list(step / (dt / 1000.0e0) * 3.6e0) FILTER (dt >= 500)) AS v, (max(t) - min(t)) / 1000.0e0 AS duration FROM s GROUP BY 1),
    m AS (SELECT sequence_id, frame_count, round(total, 2) AS total_distance_m, round(net, 2) AS net_displacement_m, round(total / greatest(net, 1.0e0), 2) AS tortuosity, round(coalesce(v[-1], 0), 1) AS max_speed_kmh,
                 round(coalesce(v[least(CAST(floor(0.95e0 * len(v)) AS BIGINT), len(v) - 1) + 1], 0), 1) AS p95_speed_kmh, round(radius, 2) AS bounding_radius_m, round(duration, 1) AS duration_seconds FROM g WHERE frame_count >= 2)"""
TRAJECTORY_METRICS = _TRACKS + " SELECT * FROM m"
TRAJECTORY_VERDICTS = _TRACKS + """, r AS (SELECT g.sequence_id, g.frame_count AS frames, CASE WHEN g.frame_count < 8 THEN 'Insufficient sequence frames'
      WHEN g.frame_count >= 15 AND bounding_radius_m <= 35 AND total_distance_m >= 100 AND tortuosity >= 15 THEN 'Stationary camera GPS jitter'
      WHEN total_distance_m >= 250 AND net_displacement_m <= 25 AND tortuosity >= 20 THEN 'Severe random-walk tortuosity'
      WHEN max_speed_kmh >= 160 THEN 'Impossible speed teleportation' ELSE 'Valid moving trajectory' END AS reason FROM g LEFT JOIN m USING (sequence_id))
    SELECT sequence_id, frames, reason = 'Valid moving trajectory' AS is_valid, reason FROM r"""


def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.even_subsample(_points(spark, d), 5).select("sequence_id", "photo_id")


EVEN_SUBSAMPLE = """
    WITH p AS (SELECT user_id AS sequence_id, CAST(event_id AS VARCHAR) AS photo_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), CAST(event_id AS VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    j AS (SELECT sequence_id, n, CASE WHEN k = 4 THEN n - 1 ELSE CAST(floor(k * (n / 5.0e0)) AS BIGINT) END AS i FROM (SELECT DISTINCT sequence_id, n FROM p WHERE n > 5), range(5) r(k))
    SELECT sequence_id, photo_id FROM p WHERE n <= 5 UNION ALL SELECT sequence_id, photo_id FROM p JOIN j USING (sequence_id, i)"""


def dataset_extent(spark: SparkSession, d: str) -> DataFrame:
    return stats.extent(photos(spark, d), ["continent"])


DATASET_EXTENT = PHOTOS_SQL + """ SELECT continent, count(*) AS images, count(Latitude) AS located, round(min(Latitude), 4) AS min_lat, round(max(Latitude), 4) AS max_lat,
    round(min(Longitude) FILTER (Latitude IS NOT NULL), 4) AS min_lon, round(max(Longitude) FILTER (Latitude IS NOT NULL), 4) AS max_lon, round(avg(Latitude), 4) AS mean_lat,
    round(degrees(atan2(avg(sin(radians(Longitude))) FILTER (Latitude IS NOT NULL), avg(cos(radians(Longitude))) FILTER (Latitude IS NOT NULL))), 4) AS mean_lon FROM photos GROUP BY 1"""


def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return stats.shares(photos(spark, d), "Koppen_Code")


VALUE_SHARES = PHOTOS_SQL + " SELECT coalesce(Koppen_Code, 'Unknown') AS value, count(*) AS n, round(count(*) * 100.0e0 / (SELECT count(*) FROM photos), 6) AS percent FROM photos GROUP BY 1"


def season_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = labelled(spark, d).withColumn("query_cell", grid.parent(F.col("cell"), 2)).where("cell is not null")
    return stats.pivot(p, "query_cell", "Time_Of_Day", ["Dawn", "Morning", "Afternoon", "Dusk", "Night", "Unknown"])


SEASON_PIVOT = LABELLED + f" SELECT {cell_sql(2)} AS query_cell, " + ", ".join(f"count(*) FILTER (Time_Of_Day = '{v}') AS \"{v}\"" for v in ("Dawn", "Morning", "Afternoon", "Dusk", "Night", "Unknown")) + " FROM labelled WHERE Latitude IS NOT NULL GROUP BY 1"


def top_countries(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(labelled(spark, d), ["Platform", "Season"], "country", 2)


TOP_COUNTRIES = LABELLED + " SELECT Platform, Season, country, count(*) AS n, CAST(row_number() OVER (PARTITION BY Platform, Season ORDER BY count(*) DESC, country) AS INTEGER) AS rank FROM labelled GROUP BY 1, 2, 3 QUALIFY rank <= 2"


def cell_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Of each cell the count and, as text, the counts by platform."""
    p = photos(spark, d).withColumn("query_cell", grid.parent(F.col("cell"), 1))
    return stats.occupancy(p, "query_cell", "Platform").select("query_cell", "image_count", F.to_json("by_value").alias("by_platform"))


CELL_OCCUPANCY = PHOTOS_SQL + f""", n AS (SELECT {cell_sql(1)} AS query_cell, Platform, count(*) AS n FROM photos WHERE Latitude IS NOT NULL GROUP BY ALL)
    SELECT query_cell, CAST(sum(n) AS BIGINT) AS image_count, '{{' || string_agg('"' || Platform || '":' || n, ',' ORDER BY Platform) || '}}' AS by_platform FROM n GROUP BY 1"""


def nested_summary(spark: SparkSession, d: str) -> DataFrame:
    top = stats.nested_top(labelled(spark, d), "Platform", ["country", "Koppen_Code"], 2)
    return top.select("Platform", "image_count", F.to_json("country").alias("country"), F.to_json("Koppen_Code").alias("Koppen_Code"))


def _nested(c: str) -> str:
    return f"(SELECT '[' || string_agg('{{\"value\":\"' || v || '\",\"n\":' || n || '}}', ',' ORDER BY n DESC, v) || ']' FROM (SELECT {c} AS v, count(*) AS n FROM labelled i WHERE i.Platform = o.Platform AND {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 2)) AS {c}"


NESTED_SUMMARY = LABELLED + f" SELECT Platform, image_count, {_nested('country')}, {_nested('Koppen_Code')} FROM (SELECT Platform, count(*) AS image_count FROM labelled GROUP BY 1) o"


def marker_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = photos(spark, d).where("cell is not null").groupBy(grid.parent(F.col("cell"), 2).alias("query_cell")).agg(F.count(F.lit(1)).alias("n"))
    return stats.marker_sizes(n, "n")


MARKER_SIZES = PHOTOS_SQL + f" SELECT query_cell, n, CASE WHEN max(n) OVER () = min(n) OVER () THEN 10.0e0 ELSE round(6 + 24.0e0 * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) END AS size FROM (SELECT {cell_sql(2)} AS query_cell, count(*) AS n FROM photos WHERE Latitude IS NOT NULL GROUP BY 1)"


def scatter_bins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.scatter_bins(e, "label", "x", "y", 0.05)


SCATTER_BINS = "SELECT label, CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.05e0) AS BIGINT) AS bx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.05e0) AS BIGINT) AS \"by\", count(*) AS n FROM embeddings GROUP BY ALL"


def sample_cells(spark: SparkSession, d: str) -> DataFrame:
    """How many photos of each cell a sample of at most 3 has; which, depends on hashes."""
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 2))
    return sampling.cell_cap(p, "c", 3, "event_id").groupBy("c").agg(F.count(F.lit(1)).alias("n"))


SAMPLE_CELLS = PHOTOS_SQL + f" SELECT {cell_sql(2)} AS c, least(count(*), 3) AS n FROM photos WHERE Latitude IS NOT NULL GROUP BY 1"


def sample_target(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 2))
    return sampling.sample_size(p, "c", 700, "event_id").select("event_id", "c")


def sample_round_robin(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 1)).where("c is not null")
    return sampling.round_robin(p, "country", "c", 40, "event_id").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c").alias("cells"))


SAMPLE_ROUND_ROBIN = PHOTOS_SQL + f" SELECT country, least(count(*), 40) AS n, least(count(DISTINCT {cell_sql(1)}), 40) AS cells FROM photos WHERE Latitude IS NOT NULL GROUP BY 1"


def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    p = labelled(spark, d).withColumn("c", grid.parent(F.col("cell"), 1)).where("c is not null")
    return sampling.cluster_stratified(p, "c", "cluster_id", 4, "event_id").select("c", "cluster_id", "event_id", "pick")


SAMPLE_STRATIFIED = LABELLED + f""", p AS (SELECT {cell_sql(1)} AS c, cluster_id, event_id, row_number() OVER (PARTITION BY {cell_sql(1)}, cluster_id ORDER BY event_id) AS f, count(*) OVER (PARTITION BY {cell_sql(1)}, cluster_id) AS s FROM labelled WHERE Latitude IS NOT NULL)
    SELECT c, cluster_id, event_id, CAST(row_number() OVER (PARTITION BY c ORDER BY f > 1, CASE WHEN f = 1 THEN -s END, CASE WHEN f = 1 THEN cluster_id END, event_id) AS INTEGER) AS pick FROM p QUALIFY pick <= 4"""


def sample_priority(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).withColumn("c", grid.parent(F.col("cell"), 1)).where("c is not null")
    return sampling.prioritised(p, "c", "Platform", "mapillary", 5, "event_id").select("c", "Platform", "event_id")


SAMPLE_PRIORITY = PHOTOS_SQL + f" SELECT {cell_sql(1)} AS c, Platform, event_id FROM photos WHERE Latitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {cell_sql(1)} ORDER BY Platform <> 'mapillary', event_id) <= 5"


def sample_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Users as cameras: the order-dependent choice of images of each."""
    p = photos(spark, d).where("user_id is not null and Captured_At is not null")
    month, hour = F.substring("Captured_At", 6, 2).try_cast("int"), F.substring("Captured_At", 12, 2).try_cast("int")
    images = p.select(F.col("user_id").alias("deployment_id"), F.col("event_id").alias("image_id"), F.floor(F.col("event_id") / 3).cast("string").alias("sequence_id"), F.substring("Captured_At", 1, 10).alias("date"), times.camera_season(month).alias("season"), times.camera_time_of_day(hour).alias("time_of_day"), (F.col("event_id") % 3 == 0).alias("is_animal"))
    return sampling.camera_samples(images)


#: Image by image: those taken so far go along.
SAMPLE_CAMERAS = PHOTOS_SQL.replace("WITH base", "WITH RECURSIVE base") + """
    , i AS (SELECT user_id AS dep, {'id': event_id, 'bin': list_extract(['winter', 'spring', 'summer', 'fall'], (CAST(substr(Captured_At, 6, 2) AS INTEGER) % 12) // 3 + 1) || CASE WHEN CAST(substr(Captured_At, 12, 2) AS INTEGER) BETWEEN 7 AND 18 THEN ' day' ELSE ' night' END,
                   'seq': event_id // 3, 'd': substr(Captured_At, 1, 10), 'animal': event_id % 3 = 0} AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM photos WHERE user_id IS NOT NULL AND Captured_At IS NOT NULL),
    g(dep, k, t) AS (SELECT dep, k, [r] FROM i WHERE k = 1
          UNION ALL SELECT dep, k, CASE WHEN len(own) > 0 AND len(list_filter(t, lambda x: x.seq = r.seq)) > 0 THEN t
                                        WHEN len(own) < 2 THEN CASE WHEN len(list_filter(own, lambda x: x.d = r.d)) = 0 THEN list_append(t, r) ELSE t END
                                        WHEN r.animal AND len(places) > 0 THEN list_concat(list_append(t[1:places[1] - 1], r), t[places[1] + 1:]) ELSE t END
                    FROM (SELECT i.dep, i.k, i.r, g.t, list_filter(g.t, lambda x: x.bin = i.r.bin) AS own, list_filter(range(1, len(g.t) + 1), lambda p: g.t[p].bin = i.r.bin AND NOT g.t[p].animal AND g.t[p].d <> i.r.d) AS places
                          FROM g JOIN i ON i.dep = g.dep AND i.k = g.k + 1)),
    z AS (SELECT dep, arg_max(t, k) AS t FROM g GROUP BY 1), x AS (SELECT dep, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS pos FROM z),
    o AS (SELECT dep, x, min(pos) OVER (PARTITION BY dep, x.bin) AS bin_at, row_number() OVER (PARTITION BY dep, x.bin ORDER BY NOT x.animal, pos) AS turn FROM x)
    SELECT dep AS deployment_id, x.id AS image_id, CAST(row_number() OVER (PARTITION BY dep ORDER BY turn, bin_at) AS INTEGER) AS pick FROM o WHERE turn <= 2 QUALIFY pick <= 4"""


def split_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Spatial blocks split into query and database blocks with every class on both sides."""
    p = labelled(spark, d).withColumn("c", grid.parent(F.col("cell"), 1))
    return sampling.query_blocks(p, "c", "cluster_id")


def vote_parents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return cluster.vote(e.select(F.col("label").cast("long").alias("cluster_id"), (F.col("vec_id") % 4).alias("parent"), F.col("vec_id").alias("idx")), 16, 4)


VOTE_PARENTS = """
    WITH c AS (SELECT label AS cluster_id, vec_id % 4 AS parent, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY ALL), b AS (SELECT cluster_id, parent FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) = 1)
    SELECT k AS cluster_id, coalesce(parent, least(3, k // 4)) AS parent_cluster_id FROM range(16) t(k) LEFT JOIN b ON cluster_id = k"""


def elbow_point(spark: SparkSession, d: str) -> DataFrame:
    """The elbow of the curve of orders by priority rank and price."""
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 12 + 1).alias("k")).agg(F.round(F.sum("o_totalprice") / 1000, 2).alias("s"))
    return cluster.elbow(o.select("k", (F.col("s") / (F.col("k") * F.col("k"))).alias("cost")))


ELBOW_POINT = """
    WITH o AS (SELECT k, s / (k * k) AS cost FROM (SELECT o_orderkey % 12 + 1 AS k, round(sum(o_totalprice) / 1000, 2) AS s FROM orders GROUP BY 1)),
    e AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(cost, k) AS c0, arg_max(cost, k) AS c1, count(*) AS n FROM o)
    SELECT CASE WHEN any_value(n) < 3 THEN max(k) ELSE arg_max(k, round(abs((k1 - k0) * (cost - c0) - (c1 - c0) * (k - k0)) / sqrt((k1 - k0) * (k1 - k0) + (c1 - c0) * (c1 - c0)), 6)) END AS k FROM o, e"""


def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as ranked results; user turns as matches."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.row_number().over(_turns()).alias("rank"), (F.col("role") == "user").alias("match"))
    return metrics.per_query(c, 5)


def _turns():  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy("conv_id").orderBy("turn", "role")


RETRIEVAL_SCORES = """
    WITH c AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rank, CAST(coalesce(role = 'user', false) AS INTEGER) AS h FROM conversations),
    s AS (SELECT *, h * sum(h) OVER (PARTITION BY query_id ORDER BY rank) / rank AS part FROM c WHERE rank <= 5)
    SELECT query_id, round(sum(h) / 5.0e0, 6) AS precision, round(coalesce(sum(part) / nullif(sum(h), 0), 0), 6) AS ap, round(coalesce(1 / min(CASE WHEN h = 1 THEN rank END), 0), 6) AS rr FROM s GROUP BY 1"""


def retrieval_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.means(retrieval_scores(spark, d))


RETRIEVAL_MEANS = f"SELECT count(*) AS queries, round(avg(precision), 6) AS mean_precision, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM ({RETRIEVAL_SCORES})"


QUERIES = {
    "cell_cluster_share": (cell_cluster_share, CELL_CLUSTER_SHARE),
    "spatial_index": (_index, SPATIAL_INDEX),
    "point_hit": (point_hit, _point_sql(10.0, 20.0, 2, "true")),
    "point_ring": (point_ring, _point_sql(10.1, 20.1, 4, "(abs(Latitude - 10.0e0) > 0.9 OR abs(Longitude - 20.0e0) > 0.9)")),
    "top_cell_clusters": (top_cell_clusters, TOP_CELL_CLUSTERS),
    "cluster_cells": (cluster_cells, CLUSTER_CELLS),
    "uncovered_cells": (uncovered_cells, UNCOVERED_CELLS),
    "locked_lines": (locked_lines, _DIRTY + " SELECT * FROM lines"),
    "cleaned": (cleaned, _DIRTY + " SELECT event_id, Latitude, Longitude FROM bad WHERE NOT bad"),
    "cleaned_sequences": (cleaned_sequences, CLEANED_SEQUENCES),
    "trajectory_metrics": (trajectory_metrics, TRAJECTORY_METRICS),
    "trajectory_verdicts": (trajectory_verdicts, TRAJECTORY_VERDICTS),
    "even_subsample": (even_subsample, EVEN_SUBSAMPLE),
    "dataset_extent": (dataset_extent, DATASET_EXTENT),
    "value_shares": (value_shares, VALUE_SHARES),
    "season_pivot": (season_pivot, SEASON_PIVOT),
    "top_countries": (top_countries, TOP_COUNTRIES),
    "cell_occupancy": (cell_occupancy, CELL_OCCUPANCY),
    "nested_summary": (nested_summary, NESTED_SUMMARY),
    "marker_sizes": (marker_sizes, MARKER_SIZES),
    "scatter_bins": (scatter_bins, SCATTER_BINS),
    "sample_cells": (sample_cells, SAMPLE_CELLS),
    "sample_target": (sample_target, None),
    "sample_round_robin": (sample_round_robin, SAMPLE_ROUND_ROBIN),
    "sample_stratified": (sample_stratified, SAMPLE_STRATIFIED),
    "sample_priority": (sample_priority, SAMPLE_PRIORITY),
    "sample_cameras": (sample_cameras, SAMPLE_CAMERAS),
    "split_blocks": (split_blocks, None),
    "vote_parents": (vote_parents, VOTE_PARENTS),
    "elbow_point": (elbow_point, ELBOW_POINT),
    "retrieval_scores": (retrieval_scores, RETRIEVAL_SCORES),
    "retrieval_means": (retrieval_means, RETRIEVAL_MEANS),
}
