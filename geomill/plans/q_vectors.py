"""Similarity, clustering, near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import geo, grid, vectors
from geomill.operators import anomaly, cluster, ingest, metrics, near_dup, neighbours, stats
from geomill.plans.views import PHOTOS_SQL, cell_sql, in_cells, photos, table


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


_UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_KNN = f"{_UNIT}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.v, c.v), 6) AS similarity FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id), knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s)"


def _knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.cosine_top_k(e.where("id % 50 = 0"), e, k, exclude_self=True)


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 10)


def knn_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The search of every hundredth vector by angle bounds, which many queries take."""
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.cosine_top_k(e.where("id % 100 = 0"), e, 10, exclude_self=True, query_bytes=0)


KNN_COSINE = f"WITH {_KNN} SELECT query_id, id, similarity, rank FROM knn WHERE rank <= 10"


KNN_BOUNDED = KNN_COSINE.replace("q.vec_id % 50 = 0", "q.vec_id % 100 = 0")


def knn_label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, average precision and reciprocal rank of labels among the nearest ten."""
    lab = _embeddings(spark, d).select("vec_id", "label")
    r = _knn(spark, d, 10).join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(lab.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    return metrics.per_query(r.select("query_id", "rank", (F.col("a") == F.col("b")).alias("match")), 10)


KNN_LABEL_SCORES = f"""
    WITH {_KNN}, m AS (SELECT query_id, rank, CAST(a.label = b.label AS INTEGER) AS h FROM knn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 10),
    t AS (SELECT *, h * sum(h) OVER (PARTITION BY query_id ORDER BY rank) / rank AS part FROM m)
    SELECT query_id, round(sum(h) / 10.0e0, 6) AS precision, round(coalesce(sum(part) / nullif(sum(h), 0), 0), 6) AS ap, round(coalesce(1 / min(CASE WHEN h = 1 THEN rank END), 0), 6) AS rr FROM t GROUP BY 1"""


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All photos, each with one of all vectors."""
    return photos(spark, d).join(_embeddings(spark, d), "vec_id")


def labelled_bank(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that photos have, each once: its label as cluster, and the number of its photos."""
    n = photos(spark, d).groupBy("vec_id").agg(F.count(F.lit(1)).alias("photos"))
    return n.join(_embeddings(spark, d).withColumn("cluster_id", F.col("label").cast("long")), "vec_id")


def geographic_recall(spark: SparkSession, d: str) -> DataFrame:
    """How near the most similar photos are, each vector with the photo of its number."""
    located = photos(spark, d).where("Latitude is not null")
    p = located.select(F.col("event_id").alias("vec_id"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), "country", "Platform")
    a, b = (p.select(*[F.col(c).alias(f"{x}_{c}") for c in p.columns]) for x in "ab")
    r = _knn(spark, d, 10).join(a, F.col("query_id") == F.col("a_vec_id")).join(b, F.col("id") == F.col("b_vec_id"))
    km = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    # hundred times the distance thresholds, for the photos are spread over the globe
    return metrics.geographic(r.select("query_id", "rank", (km / 100).alias("km"), (F.col("a_country") == F.col("b_country")).alias("same_country"), (F.col("a_Platform") != F.col("b_Platform")).alias("other_platform")))


_KM = "12742.0e0 * atan2(sqrt(x), sqrt(1 - x))"
GEOGRAPHIC_RECALL = PHOTOS_SQL + f""", {_KNN}, pl AS (SELECT event_id AS vec_id, Latitude AS lat, Longitude AS lon, country, Platform FROM photos WHERE Latitude IS NOT NULL),
    r AS (SELECT query_id, rank, {_KM} / 100 AS km, c1 = c2 AS sc, p1 <> p2 AS op FROM (SELECT query_id, rank, a.country AS c1, b.country AS c2, a.Platform AS p1, b.Platform AS p2,
          pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS x FROM knn JOIN pl a ON a.vec_id = query_id JOIN pl b ON b.vec_id = id WHERE rank <= 10)),
    q AS (SELECT query_id, max(CAST(rank <= 1 AND km <= 5 AS INTEGER)) AS r1_5, max(CAST(rank <= 5 AND km <= 5 AS INTEGER)) AS r5_5, max(CAST(rank <= 1 AND km <= 50 AS INTEGER)) AS r1_50, max(CAST(rank <= 5 AND km <= 50 AS INTEGER)) AS r5_50,
                 max(CAST(rank <= 10 AND km <= 50 AS INTEGER)) AS r10_50, max(CAST(rank = 1 AND sc AS INTEGER)) AS country, max(CAST(op AND km <= 50 AS INTEGER)) AS can, CAST(arg_min(km, rank) FILTER (op) <= 50 AS INTEGER) AS crosses FROM r GROUP BY 1)
    SELECT count(*) AS queries, round(avg(r1_5), 6) AS r1_5, round(avg(r5_5), 6) AS r5_5, round(avg(r1_50), 6) AS r1_50, round(avg(r5_50), 6) AS r5_50, round(avg(r10_50), 6) AS r10_50, round(avg(country), 6) AS country, round(avg(coalesce(crosses, 0)) FILTER (can = 1), 6) AS "cross" FROM q"""


def self_match(spark: SparkSession, d: str) -> DataFrame:
    """Vectors looked up by their first half: how often the own second half is the nearest."""
    e = _embeddings(spark, d)
    a = e.select(F.col("vec_id").alias("id"), vectors.first_half(F.col("embedding")).alias("v"))
    b = e.select(F.col("vec_id").alias("id"), vectors.first_half(F.transform("embedding", lambda x: F.round(x, 1))).alias("v"))
    return metrics.self_match(neighbours.own_rank(a, b))


SELF_MATCH = """
    WITH h AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[1:32], lambda x: CAST(CAST(round(CAST(x AS DOUBLE), 1) AS FLOAT) AS DOUBLE)) AS b FROM embeddings),
    n AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b FROM h),
    s AS (SELECT q.vec_id AS q, g.vec_id AS g, round(list_dot_product(q.a, g.b), 6) AS s FROM n q JOIN n g ON true), m AS (SELECT q, s AS own FROM s WHERE q = g),
    r AS (SELECT q, 1 + count(*) FILTER ((s > own AND g <> q) OR (s = own AND g < q)) AS r FROM s JOIN m USING (q) GROUP BY 1)
    SELECT round(avg(CAST(r <= 1 AS INTEGER)) * 100, 6) AS top1, round(avg(CAST(r <= 5 AS INTEGER)) * 100, 6) AS top5, round(avg(1.0e0 / r), 6) AS mrr FROM r"""


def centroid_table(spark: SparkSession, d: str) -> DataFrame:
    """The first components of each label's mean unit vector."""
    c = cluster.centroids(_embeddings(spark, d), "label")
    return c.select("label", "n", *[F.round(F.col("centroid")[i], 6).alias(f"c{i}") for i in range(4)])


CENTROID_TABLE = f"WITH {_UNIT} SELECT label, count(*) AS n, " + ", ".join(f"round(avg(v[{i + 1}]), 6) AS c{i}" for i in range(4)) + " FROM u GROUP BY 1"
_CENTROIDS = f"{_UNIT}, cc AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) WHERE vec_id % 2 = 0 GROUP BY ALL), cn AS (SELECT label, list(x ORDER BY i) AS c FROM cc GROUP BY 1), ce AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM cn)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, d).select("vec_id", "embedding", F.col("label").cast("long").alias("cluster_id"))
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    old = old.withColumn("cluster_label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    return cluster.assign(new.drop("cluster_id"), old, 100, 4, id_col="vec_id").select("vec_id", "cluster_id", "similarity", "cluster_label", "parent_cluster_id")


ASSIGNED = f"""
    WITH {_CENTROIDS}, s AS (SELECT vec_id, ce.label AS cluster_id, round(list_dot_product(v, c), 6) AS similarity FROM u, ce WHERE vec_id % 2 = 1)
    SELECT vec_id, CAST(cluster_id AS BIGINT) AS cluster_id, similarity, 'Cluster ' || cluster_id AS cluster_label, CAST(least(3, cluster_id // 25) AS BIGINT) AS parent_cluster_id FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cluster_id) = 1"""


def drift_decision(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return cluster.drift(_embeddings(spark, d).where("vec_id % 4 < 2").select("vec_id", "embedding"), old.where("vec_id % 4 = 0").unionByName(old.where("vec_id % 4 = 2")), id_col="vec_id")


DRIFT_DECISION = f"""
    WITH {_CENTROIDS.replace("vec_id % 2 = 0", "vec_id % 4 = 0")}, s AS (SELECT vec_id, max(round(list_dot_product(v, c), 6)) AS m FROM u, ce WHERE vec_id % 4 = 1 GROUP BY 1), n AS (SELECT count(*) AS new_rows, count(*) FILTER (m < 0.7) AS outliers FROM s)
    SELECT CASE WHEN new_rows = 0 THEN 'assign' WHEN outliers / new_rows > 0.03 THEN 'fit' ELSE 'assign' END AS decision, new_rows, outliers FROM n"""


def cluster_closest(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return cluster.closest(e, cluster.centroids(e, "label"), 3, "label", id_col="vec_id").select("label", "vec_id", "similarity", "rank")


_ALL_CENTROIDS = _CENTROIDS.replace(" WHERE vec_id % 2 = 0", "")
CLUSTER_CLOSEST = f"""
    WITH {_ALL_CENTROIDS} SELECT label, vec_id, round(list_dot_product(v, c), 6) AS similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(v, c), 6) DESC, vec_id) AS INTEGER) AS rank FROM u JOIN ce USING (label) QUALIFY rank <= 3"""


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    scored = e.join(cluster.centroids(e, "label").select("label", "centroid"), "label").select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))
    return stats.representatives(scored, "label", "vec_id", "similarity", 3)


CLUSTER_REPRESENTATIVES = f"""
    WITH {_ALL_CENTROIDS}, s AS (SELECT label, vec_id, round(list_dot_product(v, c), 6) AS similarity FROM u JOIN ce USING (label)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank, row_number() OVER (PARTITION BY label ORDER BY similarity, vec_id DESC) AS s2 FROM s)
    SELECT label, vec_id, similarity, rank, rank > 3 AS outlier FROM r WHERE rank <= 3 OR s2 <= 2"""


def zero_shot(spark: SparkSession, d: str) -> DataFrame:
    """The three best of ten prompts, which are vectors of the table."""
    e = _embeddings(spark, d)
    prompts = e.where("vec_id < 10").select(F.concat(F.lit("class "), F.col("vec_id").cast("string")).alias("label"), F.col("embedding").alias("prompt"))
    return neighbours.zero_shot_labels(e.where("vec_id >= 10"), prompts, "vec_id", "embedding")


ZERO_SHOT = f"""
    WITH {_UNIT}, s AS (SELECT a.vec_id, 'class ' || b.vec_id AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, 'class ' || b.vec_id) AS k FROM u a JOIN u b ON a.vec_id >= 10 AND b.vec_id < 10)
    SELECT vec_id, string_agg(l, ', ' ORDER BY k) AS labels FROM s WHERE k <= 3 GROUP BY 1"""


def hybrid_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of each vector to the next, blended of two halves."""
    e = _embeddings(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    dist = vectors.hybrid_distance(vectors.first_half(F.col("embedding")), vectors.first_half(F.col("next")), vectors.second_half(F.col("embedding")), vectors.second_half(F.col("next")))
    return e.join(b, "vec_id").select("vec_id", F.round(dist, 6).alias("distance"))


HYBRID_DISTANCES = """
    WITH h AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings)
    SELECT x.vec_id, round(0.7e0 * (1 - list_dot_product(x.a, y.a) / (sqrt(list_dot_product(x.a, x.a)) * sqrt(list_dot_product(y.a, y.a)))) + 0.3e0 * (SELECT sum(abs(x.b[i] - y.b[i])) / 2 FROM range(1, 33) r(i)), 6) AS distance FROM h x JOIN h y ON y.vec_id = x.vec_id + 1"""


def derived_halves(spark: SparkSession, d: str) -> DataFrame:
    """First half, second half and both joined again, by their sums."""
    e = _embeddings(spark, d).select(F.col("vec_id").alias("photo_key"), "embedding")
    a, b = ingest.derive_representation(e, "first_half"), ingest.derive_representation(e, "second_half")
    both = ingest.derive_representation(a, "concat", b)
    total = lambda v: F.round(F.aggregate(F.col(v).cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return both.select(F.col("photo_key").alias("vec_id"), F.size("embedding").alias("n"), total("embedding").alias("total"))


DERIVED_HALVES = "SELECT vec_id, 64 AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"


def half_precision(spark: SparkSession, d: str) -> DataFrame:
    """How far 16-bit vectors are off, at most, in thousandths."""
    e = _embeddings(spark, d).withColumn("h", vectors.half_precision(F.col("embedding")))
    return e.select("vec_id", (F.array_max(F.zip_with("embedding", "h", lambda a, b: F.abs(a - b))) < 0.0005).alias("close"), F.size("h").alias("n"))


HALF_PRECISION = "SELECT vec_id, true AS close, 64 AS n FROM embeddings"


def dedup_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Photos left by the greedy rule inside cells; the vectors of one label are much alike."""
    p = in_cells(photos(spark, d).select("event_id", "vec_id", "cell"), 1).join(_embeddings(spark, d), "vec_id").select("event_id", "c", "embedding")
    return near_dup.dedup_cells(p, "c", ["event_id"], threshold=0.6, id_col="event_id").select("event_id", "c")


#: Cell by cell, row by row: the vectors kept so far go along.
DEDUP_IN_CELLS = PHOTOS_SQL.replace("WITH base", "WITH RECURSIVE base") + f""", {_UNIT},
    r AS (SELECT {cell_sql(1)} AS c, event_id, v, row_number() OVER (PARTITION BY {cell_sql(1)} ORDER BY event_id) AS k FROM photos JOIN u USING (vec_id) WHERE Latitude IS NOT NULL),
    g(c, k, event_id, stays, kept) AS (SELECT c, k, event_id, true, [v] FROM r WHERE k = 1
          UNION ALL SELECT c, k, event_id, stays, CASE WHEN stays THEN list_append(kept, v) ELSE kept END
                    FROM (SELECT r.c, r.k, r.event_id, r.v, g.kept, len(list_filter(g.kept, lambda x: round(list_dot_product(x, r.v), 6) > 0.6)) = 0 AS stays FROM g JOIN r ON r.c = g.c AND r.k = g.k + 1))
    SELECT event_id, c FROM g WHERE stays"""


def kmeans_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).select("vec_id", "embedding")
    return cluster.fit_hierarchy(e, 12, 3, id_col="vec_id").select("vec_id", "cluster_id", "parent_cluster_id")


def medoid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Four medoids of each label, different in place and address, described."""
    p = photos(spark, d)
    bank = labelled_bank(spark, d)
    m = cluster.diverse_medoids(p, cluster.centroids(bank, weight="photos"), 4, id_col="event_id", bank=bank)
    rows = m.join(p.select("event_id", "Latitude", "Longitude", "country", "continent", "Koppen_Code"), F.col("id") == F.col("event_id"))
    return cluster.medoid_metadata(rows)


def block_costs(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).where("cell is not null")
    return cluster.block_validation(p, grid.parent(F.col("cell"), 1), [2, 4, 8], id_col="event_id", bank=_embeddings(spark, d))


def climate_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select(F.concat_ws("_", "Platform", "Photo_ID").alias("photo_key"), "Platform", "Latitude", "Longitude", "Koppen_Code", "continent", "vec_id", "cell")
    return anomaly.climate_outliers(p.where("cell is not null"), ("flickr", "mapillary"), threshold=0.5, pictures=_embeddings(spark, d))


_MISFIT = f"CASE WHEN a.polar THEN b.major IN ('A', 'B') OR b.koppen IN {anomaly.NOT_POLAR} ELSE b.koppen IN {anomaly.NOT_DESERT} END"
CLIMATE_OUTLIERS = PHOTOS_SQL + f""", {_UNIT},
    p AS (SELECT Platform || '_' || Photo_ID AS photo_key, lower(Platform) AS plat, coalesce(Koppen_Code, '') AS koppen, coalesce(substr(Koppen_Code, 1, 1), '') AS major, {cell_sql(3)} AS c3, {cell_sql(4)} AS c4, Latitude, Longitude, continent, v
          FROM photos JOIN u USING (vec_id) WHERE Latitude IS NOT NULL),
    cells AS (SELECT c3, bool_or(plat NOT IN ('flickr', 'mapillary')) OR (count(DISTINCT plat) >= 2 AND count(*) >= 20) AS good, count(*) >= 5 AS several FROM p GROUP BY 1),
    pool AS (SELECT *, CASE WHEN major = 'E' THEN good OR several ELSE good END AS fit FROM p JOIN cells USING (c3) WHERE major <> ''),
    bank AS (SELECT * FROM (SELECT *, bool_or(fit) OVER (PARTITION BY major) AS any_fit FROM pool) WHERE fit OR NOT any_fit),
    mx AS (SELECT major, i, avg(v[i]) AS x FROM bank, range(1, 65) r(i) GROUP BY ALL), ml AS (SELECT major, list(x ORDER BY i) AS m FROM mx GROUP BY 1),
    sims AS (SELECT bank.*, round(list_dot_product(v, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))), 6) AS s FROM bank JOIN ml USING (major)),
    kept AS (SELECT * FROM (SELECT *, round(quantile_cont(s, 0.1) OVER (PARTITION BY major), 9) AS least, count(*) OVER (PARTITION BY major) AS of_group FROM sims) WHERE of_group < 10 OR s >= least),
    dense AS (SELECT c4 FROM p GROUP BY 1 HAVING count(*) >= 500 AND count(DISTINCT plat) >= 3),
    asked AS (SELECT * FROM (SELECT *, coalesce(lower(continent) = 'antarctica', false) OR koppen IN ('EF', 'ET') AS polar FROM p WHERE plat IN ('flickr', 'mapillary')) WHERE polar OR (koppen IN ('BWh', 'BWk') AND c4 NOT IN (SELECT c4 FROM dense))),
    pairs AS (SELECT a.photo_key AS a, b.photo_key AS b, CAST(round(list_dot_product(a.v, b.v) * 1e6, 0) AS BIGINT) AS s, a.c3 <> b.c3 AS other, a.c3 <> b.c3 AND (abs(a.Latitude - b.Latitude) > 3 OR abs(a.Longitude - b.Longitude) > 3) AS ok, {_MISFIT} AS bad FROM asked a, kept b),
    counts AS (SELECT a, count(*) FILTER (ok) AS n_ok, count(*) FILTER (other) AS n_other FROM pairs GROUP BY 1),
    ranked AS (SELECT a, bad, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs JOIN counts USING (a) WHERE CASE WHEN n_ok >= 25 THEN ok WHEN n_other >= 25 THEN other ELSE true END)
    SELECT a AS photo_key FROM ranked WHERE r <= 25 GROUP BY 1 HAVING avg(CAST(bad AS INTEGER)) >= 0.5"""


QUERIES = {
    "knn_cosine": (knn_cosine, KNN_COSINE),
    "knn_bounded": (knn_bounded, KNN_BOUNDED),
    "knn_label_scores": (knn_label_scores, KNN_LABEL_SCORES),
    "geographic_recall": (geographic_recall, GEOGRAPHIC_RECALL),
    "self_match": (self_match, SELF_MATCH),
    "centroid_table": (centroid_table, CENTROID_TABLE),
    "assigned": (assigned, ASSIGNED),
    "drift_decision": (drift_decision, DRIFT_DECISION),
    "cluster_closest": (cluster_closest, CLUSTER_CLOSEST),
    "cluster_representatives": (cluster_representatives, CLUSTER_REPRESENTATIVES),
    "zero_shot": (zero_shot, ZERO_SHOT),
    "hybrid_distances": (hybrid_distances, HYBRID_DISTANCES),
    "derived_halves": (derived_halves, DERIVED_HALVES),
    "half_precision": (half_precision, HALF_PRECISION),
    "dedup_in_cells": (dedup_in_cells, DEDUP_IN_CELLS),
    "kmeans_hierarchy": (kmeans_hierarchy, None),
    "medoid_summary": (medoid_summary, None),
    "block_costs": (block_costs, None),
    "climate_outliers": (climate_outliers, CLIMATE_OUTLIERS),
}
