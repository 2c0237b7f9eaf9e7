"""The multi-resolution spatial-semantic index, and questions to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import grid

OPTIONAL = ("Time_Of_Day", "Koppen_Code", "Koppen_Desc", "country", "continent")
CLUSTER = ("cluster_id", "cluster_label", "cluster_description")
PARENT = ("parent_cluster_id", "parent_cluster_label")
PARENT_STEP = 80


def build(photos: DataFrame, cell: str = "cell", resolutions: tuple[int, int] = (1, grid.FINEST)) -> DataFrame:
    """One row per resolution, cell, descriptors and cluster, with image_count.

    Counts are additive: rows are grouped once at the finest cell, and only that result
    is spread over the coarser resolutions. Each resolution is grouped by itself, from the
    same shuffled rows: a task holds the groups of one resolution at a time, not of all,
    and a filter on the resolution leaves the others out. Rows without cell or cluster
    fall out; null descriptors are groups. Parent columns come out only if they came in.
    """
    have = photos.columns
    group = ["Season", *[c for c in OPTIONAL if c in have], *[c for c in CLUSTER if c in have], *[c for c in PARENT if c in have]]
    fine = photos.where(F.col(cell).isNotNull() & F.col("cluster_id").isNotNull()).groupBy(cell, *group).agg(F.count(F.lit(1)).alias("n"))

    def at(r: int) -> DataFrame:
        return fine.groupBy(grid.parent(F.col(cell), r).alias("query_cell"), *group).agg(F.sum("n").alias("image_count")).select(F.lit(r).alias("resolution"), "query_cell", *group, "image_count")

    return reduce(DataFrame.unionAll, [at(r) for r in range(resolutions[0], resolutions[1] + 1)])


def with_parents(photos: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """photos with parent ids: the given ones, else by the cluster's number."""
    own = F.col("parent_cluster_id") if "parent_cluster_id" in photos.columns else F.lit(None).cast("long")
    return photos.withColumn("parent_cluster_id", F.coalesce(own, F.floor(F.col("cluster_id") / PARENT_STEP).cast("long")))


def write(index: DataFrame, path: str) -> None:
    """Partitioned by resolution and clustered by cell: a question reads one directory and few row groups."""
    index.repartitionByRange("resolution", "query_cell").sortWithinPartitions("resolution", "query_cell").write.mode("overwrite").partitionBy("resolution").parquet(path)


def shares(index: DataFrame, resolution: int) -> DataFrame:
    """Of each cell at a resolution the clusters with their counts and percentages."""
    counts = index.where(F.col("resolution") == resolution).groupBy("query_cell", "cluster_id").agg(F.sum("image_count").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("query_cell")), 6))


def point(index: DataFrame, lat: float, lon: float, resolution: int) -> DataFrame:
    """The clusters at a place, most images first: of its cell, or if that is empty of the ring of neighbours (source: cell or ring)."""
    spark = index.sparkSession
    here = spark.range(1).select(grid.encode(F.lit(lat), F.lit(lon), resolution).alias("c"))
    row = here.select("c", grid.disk(F.col("c")).alias("d")).first()
    ring = [c for c in row["d"] if c != row["c"]]
    # literals, so that partition and row-group filters apply
    near = index.where((F.col("resolution") == resolution) & F.col("query_cell").isin([row["c"], *ring]))
    hit = F.col("query_cell") == row["c"]
    keys = [c for c in CLUSTER if c in index.columns]
    counts = near.groupBy(*keys).agg(F.sum(F.when(hit, F.col("image_count"))).alias("own"), F.sum(F.when(~hit, F.col("image_count"))).alias("around"))
    every = Window.partitionBy(F.lit(0))  # at most one row a cluster
    any_own = F.max(F.col("own").isNotNull()).over(every)
    counts = counts.withColumn("any", any_own).withColumn("n", F.when(F.col("any"), F.col("own")).otherwise(F.col("around"))).where("n is not null")
    return counts.select(*keys, F.when(F.col("any"), "cell").otherwise("ring").alias("source"), "n", F.round(F.col("n") * 100.0 / F.sum("n").over(every), 6).alias("percent")).orderBy(F.desc("n"), "cluster_id")


def top_clusters(index: DataFrame, resolution: int, k: int = 5, min_count: int = 1) -> DataFrame:
    """The k largest clusters of each cell with at least min_count images, with the cell's total and its logarithm for maps."""
    counts = index.where(F.col("resolution") == resolution).groupBy("query_cell", "cluster_id").agg(F.sum("image_count").alias("n"))
    w = Window.partitionBy("query_cell")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "cluster_id"))})
    return ranked.where((F.col("total") >= min_count) & (F.col("rank") <= k)).select("query_cell", "cluster_id", "n", "rank", "total", F.round(F.log10(F.greatest("total", F.lit(1))), 6).alias("log_total"))


def cluster_cells(index: DataFrame, resolution: int) -> DataFrame:
    """The cells of each cluster at one resolution. A cluster has at most as many as the grid."""
    return index.where(F.col("resolution") == resolution).groupBy("cluster_id").agg(F.sort_array(F.collect_set("query_cell")).alias("cells"))


def uncovered(land: DataFrame, photos: DataFrame, resolution: int, threshold: int = 0, cell: str = "cell") -> DataFrame:
    """Land cells with at most threshold photos."""
    covered = photos.where(F.col(cell).isNotNull()).groupBy(grid.parent(F.col(cell), resolution).alias("query_cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
    return land.select("query_cell").distinct().join(covered, "query_cell", "left_anti")
