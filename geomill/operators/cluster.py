"""Clustering of embeddings: fit, assign, drift, number of clusters, medoids."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import vectors
from geomill.operators.neighbours import nearest_of_few
from geomill.sources.shared import written

DRIFT_SIMILARITY, DRIFT_SHARE = 0.70, 0.03
#: Rows nearest to a centroid among which its medoids are sought first.
SHORTLIST = 64
#: Rows of one task of a k-means fit: its jobs are many, and each task of each sends a few KB to the driver.
FIT_ROWS = 50_000


def centroids(rows: DataFrame, cluster: str = "cluster_id", vector: str = "embedding", unit: bool = True, weight: str | None = None) -> DataFrame:
    """cluster and centroid: the mean vector, by a vector aggregate that combines on the map side. weight: how many rows a row stands for."""
    v = vectors.normalised(F.col(vector)) if unit else vectors.doubles(F.col(vector))
    mean, n = (Summarizer.mean(array_to_vector(v), F.col(weight).cast("double")), F.sum(weight)) if weight else (Summarizer.mean(array_to_vector(v)), F.count(F.lit(1)))
    mean = rows.where(f"{cluster} >= 0").groupBy(cluster).agg(mean.alias("m"), n.alias("n"))
    from pyspark.ml.functions import vector_to_array

    return mean.select(cluster, vector_to_array("m").alias("centroid"), "n")


def parent_centroids(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Of each parent the sum of its children's centroids by their counts, over the number of children. parents: cluster_id, parent_cluster_id."""
    from pyspark.ml.functions import vector_to_array

    weighted = F.transform("centroid", lambda x: x * F.col("n"))
    joined = children.join(parents, "cluster_id")
    return joined.groupBy("parent_cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector(weighted))).alias("centroid"), F.count(F.lit(1)).alias("children"))


def fit(rows: DataFrame, k: int, vector: str = "embedding", id_col: str = "photo_key", seed: int = 42, iterations: int = 20) -> DataFrame:
    """rows with cluster_id from k-means; k is at most the number of rows."""
    x = rows.withColumn("__x", array_to_vector(vectors.doubles(F.col(vector)))).persist()
    try:
        k = max(1, min(k, x.count()))
        if k == 1:
            return rows.withColumn("cluster_id", F.lit(0).cast("long"))
        model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__x", predictionCol="__c").fit(x)
        return model.transform(rows.withColumn("__x", array_to_vector(vectors.doubles(F.col(vector))))).withColumn("cluster_id", F.col("__c").cast("long")).drop("__x", "__c")
    finally:
        x.unpersist()


def closest(rows: DataFrame, centres: DataFrame, n: int, cluster: str = "cluster_id", vector: str = "embedding", id_col: str = "photo_key") -> DataFrame:
    """The n rows of each cluster most similar to its centroid, with rank; ties to the smaller id."""
    sim = F.round(vectors.dot(vectors.normalised(F.col(vector)), vectors.normalised(F.col("centroid"))), 6)
    w = Window.partitionBy(cluster).orderBy(F.desc("similarity"), id_col)
    joined = rows.join(centres.select(cluster, "centroid"), cluster).withColumn("similarity", sim).drop("centroid")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def vote(samples: DataFrame, k: int, parents: int, order: Column | None = None) -> DataFrame:
    """cluster_id, parent_cluster_id of each of k clusters: the most frequent parent among its samples, of equal ones that seen first.

    samples: cluster_id, parent, idx. A cluster without samples gets a parent by its number.
    """
    spark = samples.sparkSession
    counts = samples.groupBy("cluster_id", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    best = counts.groupBy("cluster_id").agg(F.max_by("parent", F.struct("n", (-F.col("first")).alias("f"))).alias("parent"))
    step = max(1, k // max(1, parents))
    every = spark.range(k).select(F.col("id").alias("cluster_id"))
    return every.join(best, "cluster_id", "left").select("cluster_id", F.coalesce(F.col("parent").cast("long"), F.least(F.lit(parents - 1), F.floor(F.col("cluster_id") / step))).cast("long").alias("parent_cluster_id"))


def fit_hierarchy(rows: DataFrame, k: int, parents: int | None = None, samples: int = 10, vector: str = "embedding", id_col: str = "photo_key", seed: int = 42) -> DataFrame:
    """rows with cluster_id and parent_cluster_id: k-means, then k-means of the rows nearest to each centroid, then a vote."""
    children = fit(rows, k, vector, id_col, seed)
    parents = parents or max(2, k // 20)
    near = closest(children, centroids(children, vector=vector), samples, vector=vector, id_col=id_col)
    above = fit(near.withColumnRenamed("cluster_id", "child"), parents, vector, id_col, seed + 1)
    votes = above.select(F.col("child").alias("cluster_id"), F.col("cluster_id").alias("parent"), F.xxhash64(id_col).alias("idx"))
    return children.join(vote(votes, k, parents), "cluster_id", "left")


def assign(rows: DataFrame, old: DataFrame, k: int, parents: int, vector: str = "embedding", id_col: str = "photo_key") -> DataFrame:
    """rows with the cluster of the old table whose centroid is most similar, and that cluster's labels."""
    valid = old.where((F.col("cluster_id") >= 0) & (F.col("cluster_id") < k))
    placed = nearest_of_few(rows, centroids(valid, vector=vector), id_col, vector, "cluster_id", "centroid")
    label_columns = [c for c in old.columns if c.endswith(("_label", "_description")) or c == "parent_cluster_id"]
    labels = valid.groupBy("cluster_id").agg(F.min(F.struct(*label_columns)).alias("__row")).select("cluster_id", "__row.*") if label_columns else valid.select("cluster_id").distinct()
    step = max(1, k // max(1, parents))
    fallback = F.least(F.lit(parents - 1), F.floor(F.col("cluster_id") / step)).cast("long")
    own = F.coalesce("parent_cluster_id", fallback) if "parent_cluster_id" in label_columns else fallback
    return placed.join(labels, "cluster_id", "left").withColumn("parent_cluster_id", own)


def drift(new: DataFrame, old: DataFrame, vector: str = "embedding", id_col: str = "photo_key") -> DataFrame:
    """One row: decision (fit or assign), new_rows, outliers. Old rows that are gone don't count; neither table is changed.

    old: key, cluster_id and vector. A new row is an outlier if no centroid is within 0.70 of it.
    """
    alive = old.join(new.select(id_col), id_col, "left_semi").where("cluster_id >= 0")
    centres = centroids(alive, vector=vector)
    fresh = new.join(old.select(id_col), id_col, "left_anti")
    judged = nearest_of_few(fresh.select(id_col, vector), centres, id_col, vector, "cluster_id", "centroid")
    far = F.coalesce(F.col("similarity") < DRIFT_SIMILARITY, F.lit(True))
    counts = judged.agg(F.count(F.lit(1)).alias("new_rows"), F.coalesce(F.sum(far.cast("long")), F.lit(0)).alias("outliers"))
    have = centres.agg(F.count(F.lit(1)).alias("k"))
    share = F.col("outliers") / F.greatest(F.col("new_rows"), F.lit(1))
    decision = F.when(F.col("k") == 0, "fit").when(F.col("new_rows") == 0, "assign").when(share > DRIFT_SHARE, "fit").otherwise("assign")
    return counts.crossJoin(F.broadcast(have)).select(decision.alias("decision"), "new_rows", "outliers")


def decide(new: DataFrame, old: DataFrame, vector: str = "embedding", id_col: str = "photo_key") -> str:
    """``drift``'s decision, or ``fit`` where it can't be made: a table that can't be read or lacks columns is clustered anew."""
    try:
        return drift(new, old, vector, id_col).first()["decision"]
    except (PySparkException, Py4JError) as e:
        logging.getLogger(__name__).warning("no decision about drift, so clusters are fitted anew: %s", e)
        return "fit"


def elbow(costs: DataFrame) -> DataFrame:
    """The k of a (k, cost) table farthest from the chord of its first and last point; of fewer than three points the last."""
    ends = costs.agg(F.min_by(F.struct("k", "cost"), "k").alias("a"), F.max_by(F.struct("k", "cost"), "k").alias("b"), F.count(F.lit(1)).alias("n"))
    dx, dy = F.col("b.k") - F.col("a.k"), F.col("b.cost") - F.col("a.cost")
    off = F.abs(dx * (F.col("cost") - F.col("a.cost")) - dy * (F.col("k") - F.col("a.k"))) / F.sqrt(dx * dx + dy * dy)
    far = costs.crossJoin(F.broadcast(ends)).agg(F.max("n").alias("n"), F.max("k").alias("last"), F.max_by("k", F.struct(F.round(off, 6), (-F.col("k")).alias("s"))).alias("best"))
    return far.select(F.when(F.col("n") < 3, F.col("last")).otherwise(F.col("best")).alias("k"))


def block_validation(rows: DataFrame, block: Column, ks: list[int], vector: str = "embedding", id_col: str = "photo_key", seed: int = 42, held_out: float = 0.1, bank: DataFrame | None = None, by: str = "vec_id") -> DataFrame:
    """k, train_cost, validation_cost: mean squared distances with whole spatial blocks held out by hash.

    Where rows share vectors, bank has each once by the column ``by`` of both: a vector is
    then fitted once with the number of its rows as weight, and none moves with the rows.
    """
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    held = (F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(1000)) < int(1000 * held_out)).alias("held")
    weighted = rows.select(vector, held, F.lit(1.0).alias("w")) if bank is None else rows.groupBy(by, held).agg(F.count(F.lit(1)).cast("double").alias("w")).join(bank.select(by, vector), by)
    x = weighted.select(array_to_vector(vectors.doubles(F.col(vector))).alias("__x"), "held", "w").persist()
    try:
        out = []
        n = x.where("not held").count()
        # not one task for each of the shuffle's partitions, which grow in number where the rows don't
        parts = max(spark.sparkContext.defaultParallelism, -(-n // FIT_ROWS))
        few = x.coalesce(parts)
        for k in ks:
            model = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=20, featuresCol="__x", predictionCol="__c", weightCol="w").fit(few.where("not held"))
            centres = spark.sparkContext.broadcast(np.array(model.clusterCenters()))

            @F.pandas_udf("double")
            def cost(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                c = centres.value  # noqa: B023
                squares = (c * c).sum(axis=1)
                for s in batches:
                    found = [np.empty(0)]
                    for at in range(0, len(s), 1024):
                        m = np.stack(s.iloc[at : at + 1024].to_numpy())
                        found.append(np.maximum(((m * m).sum(axis=1)[:, None] - 2 * m @ c.T + squares).min(axis=1), 0.0))
                    yield pd.Series(np.concatenate(found))

            costs = few.withColumn("d", cost(vector_to_array("__x")) * F.col("w"))
            mean = lambda of: F.sum(F.when(of, F.col("d"))) / F.sum(F.when(of, F.col("w")))
            row = costs.agg(mean(~F.col("held")).alias("t"), mean(F.col("held")).alias("v")).first()
            out.append((k, row["t"], row["v"]))
        return spark.createDataFrame(out, "k long, train_cost double, validation_cost double")
    finally:
        x.unpersist()


def diverse_medoids(rows: DataFrame, centres: DataFrame, n: int = 4, cluster: str = "cluster_id", vector: str = "embedding", id_col: str = "photo_key", bank: DataFrame | None = None, by: str = "vec_id") -> DataFrame:
    """cluster, pick (from 1), id: rows near the centroid that differ in place (1e-4 degrees) and address; if these are too few, the nearest others.

    The walk goes over the ``SHORTLIST`` rows nearest to each centroid. Clusters where these
    are all alike, and which have more rows, are walked through whole, in n rounds that
    each take the nearest row not in conflict with the picks so far.

    Where rows share vectors, bank has each once, with its cluster, by the column ``by`` of
    both: similarities are then found once for each vector, and none moves with the rows.
    """
    sim = F.round(vectors.dot(vectors.normalised(F.col(vector)), vectors.normalised(F.col("centroid"))), 6).alias("similarity")
    near_to = (rows if bank is None else bank).join(centres.select(cluster, "centroid"), cluster)
    judged = near_to.withColumn("similarity", sim) if bank is None else rows.join(near_to.select(by, cluster, sim), by)
    scored = judged.select(cluster, F.col(id_col).alias("id"), "similarity", F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("Image_URL").alias("url"))
    row = F.struct("id", "lat", "lon", "url")
    order = F.struct(F.col("similarity").isNull().alias("x"), F.nanvl(-F.col("similarity"), F.lit(float("-inf"))).alias("s"), "id")
    most = max(SHORTLIST, n)
    top = scored.withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(order))).where(F.col("__r") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__r", row.alias("row")))), lambda x: x["row"])
    # at most `most` rows a cluster; written, for what follows reads them twice
    near = written(top.groupBy(cluster).agg(listed.alias("near")), "medoids")

    def conflict(p: Column, lat: Column, lon: Column, url: Column, i: Column) -> Column:
        close = (F.abs(p["lat"] - lat) < 1e-4) & (F.abs(p["lon"] - lon) < 1e-4)
        return (p["id"] == i) | F.coalesce(close, F.lit(False)) | F.coalesce(p["url"] == url, F.lit(False))

    def take(picks: Column, x: Column) -> Column:
        free = (F.size(picks) < n) & ~F.exists(picks, lambda p: conflict(p, x["lat"], x["lon"], x["url"], x["id"]))
        return F.when(free, F.concat(picks, F.array(x))).otherwise(picks)

    walked = near.withColumn("picks", F.aggregate(F.slice("near", 2, most), F.slice("near", 1, 1), take))
    short = (F.size("picks") < n) & (F.size("near") == most)
    hungry = walked.where(short).select(cluster)
    chosen = walked.select(cluster, "near", "picks")
    if not hungry.isEmpty():
        rest = scored.join(hungry, cluster, "left_semi")
        picks = rest.groupBy(cluster).agg(F.array(F.min_by(row, order)).alias("picks"))
        for _ in range(n - 1):
            free = F.when(~F.exists("picks", lambda p: conflict(p, F.col("lat"), F.col("lon"), F.col("url"), F.col("id"))), order)
            met = rest.join(picks, cluster).groupBy(cluster).agg(F.first("picks").alias("before"), F.min_by(row, free).alias("next"))
            picks = met.select(cluster, F.when(F.col("next").isNull(), F.col("before")).otherwise(F.concat("before", F.array("next"))).alias("picks"))
        whole = picks.withColumnRenamed("picks", "__whole")
        chosen = chosen.join(whole, cluster, "left").select(cluster, "near", F.coalesce("__whole", "picks").alias("picks"))
    ids = lambda a: F.transform(a, lambda p: p["id"])
    others = F.array_except(ids(F.slice("near", 1, n)), ids(F.col("picks")))
    all_ = chosen.select(cluster, F.slice(F.concat(ids(F.col("picks")), others), 1, n).alias("ids"))
    return all_.select(cluster, F.posexplode("ids").alias("pick", "id")).select(cluster, (F.col("pick") + 1).alias("pick"), "id")


def medoid_metadata(medoids: DataFrame, group: str = "cluster_id", order: str = "pick") -> DataFrame:
    """Of each group's few medoids: a location text and the distinct known values of each descriptor, in order."""
    descriptors = [c for c in ("country", "continent", "Season", "Time_Of_Day", "Koppen_Code", "Koppen_Desc") if c in medoids.columns]

    def known(c: str) -> Column:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim(F.col(c)).alias("v")))), lambda x: x["v"])
        real = F.array_distinct(F.filter(ordered, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin("unknown", "nan", "n/a", "none")))
        return F.when(F.size(real) > 0, F.array_join(real, ", ")).otherwise("Unknown").alias(c)

    fmt = lambda p, *cs: F.format_string(p, *cs)
    lat, lon = F.col("Latitude"), F.col("Longitude")
    box = fmt("Bounding Box: (%.5f, %.5f) to (%.5f, %.5f) | Centroid: (%.5f, %.5f)", F.min(lat), F.min(lon), F.max(lat), F.max(lon), F.avg(lat), F.avg(lon))
    place = F.when((F.count(lat) == 0) | (F.count(lon) == 0), "Unknown").when(F.count(lat) > 1, box).otherwise(fmt("Lat %.5f, Lon %.5f", F.avg(lat), F.avg(lon)))
    return medoids.groupBy(group).agg(place.alias("location"), *[known(c) for c in descriptors])
