"""Reports: extents, shares, pivots, top values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import geo


def extent(photos: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts, bounds and centre; the centre's longitude is the mean direction."""
    lat, lon = F.col("Latitude"), F.col("Longitude")
    ok = lat.isNotNull() & lon.isNotNull()
    pick = lambda c: F.when(ok, c)
    return photos.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("images"), F.count(pick(lat)).alias("located"),
        F.round(F.min(pick(lat)), 4).alias("min_lat"), F.round(F.max(pick(lat)), 4).alias("max_lat"),
        F.round(F.min(pick(lon)), 4).alias("min_lon"), F.round(F.max(pick(lon)), 4).alias("max_lon"),
        F.round(F.avg(pick(lat)), 4).alias("mean_lat"), F.round(geo.circular_mean_longitude(pick(lon)), 4).alias("mean_lon"),
    )


def shares(rows: DataFrame, column: str, k: int | None = None, unknown: str = "Unknown") -> DataFrame:
    """value, n, percent of each value of a column, largest first; the k largest if k is given."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent")).orderBy(F.desc("n"), "value")
    return out.limit(k) if k else out


def top_values(rows: DataFrame, group: list[str], column: str, k: int) -> DataFrame:
    """The k most frequent known values of a column in each group, ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), column)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pivot(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts of listed values in columns, 0 where there are none. Listing them saves a pass over the data."""
    return rows.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def occupancy(rows: DataFrame, cell: str, column: str) -> DataFrame:
    """Of each cell the count and a map of counts by value, of known values; ordered by key."""
    counts = rows.where(F.col(cell).isNotNull()).groupBy(cell, column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("k"), F.col("n").alias("v")))))
    return counts.groupBy(cell).agg(F.sum("n").alias("image_count"), F.map_from_entries(entries).alias("by_value"))


def nested_top(rows: DataFrame, group: str, columns: list[str], k: int) -> DataFrame:
    """Of each group the count and, of each column, its k most frequent values as an array: in one pass, the columns as rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")
    counts = rows.where(F.col(group).isNotNull()).select(group, pairs).select(group, "p.c", "p.v").groupBy(group, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group, "c")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("v").isNull(), F.desc("n"), "v"))})
    top = lambda c: F.transform(F.sort_array(F.collect_list(F.when((F.col("c") == c) & F.col("v").isNotNull() & (F.col("r") <= k), F.struct("r", "v", "n")))), lambda x: F.struct(x["v"].alias("value"), x["n"].alias("n"))).alias(c)
    return ranked.groupBy(group).agg(F.max("total").alias("image_count"), *map(top, columns))


def marker_sizes(cells: DataFrame, count: str) -> DataFrame:
    """Marker size from 6 to 30 by count; 10 if all are equal."""
    ends = cells.agg(F.min(count).alias("lo"), F.max(count).alias("hi"))
    size = F.when(F.col("hi") == F.col("lo"), F.lit(10.0)).otherwise(6 + 24.0 * (F.col(count) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return cells.crossJoin(F.broadcast(ends)).withColumn("size", F.round(size, 6)).drop("lo", "hi")


def scatter_bins(points: DataFrame, label: str, x: str, y: str, size: float) -> DataFrame:
    """Counts of points by label and square of a plane."""
    return points.groupBy(label, F.floor(F.col(x) / size).alias("bx"), F.floor(F.col(y) / size).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def gallery(clusters: DataFrame, bins: list[str], cluster: str, count: str, address: str, n: int = 4) -> DataFrame:
    """Of each bin the pictures of its largest clusters, n at most, largest first; clusters without an address give none."""
    w = Window.partitionBy(*bins).orderBy(F.desc(count), cluster)
    shown = clusters.where(F.coalesce(F.col(address), F.lit("")) != "")
    return shown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*bins, "rank", cluster, address)


def representatives(scored: DataFrame, cluster: str, key: str, similarity: str, n: int) -> DataFrame:
    """Of each cluster the n most similar rows and, if it has more, the two least similar among the others, as outliers."""
    w = Window.partitionBy(cluster)
    ranked = scored.withColumns({"r": F.row_number().over(w.orderBy(F.desc(similarity), key)), "s": F.row_number().over(w.orderBy(similarity, F.desc(key)))})
    return ranked.where((F.col("r") <= n) | (F.col("s") <= 2)).withColumn("outlier", F.col("r") > n).drop("s").withColumnRenamed("r", "rank")


def map_resolution(photos: DataFrame, *groups: Column) -> DataFrame:
    """The cell resolution for a map of all located photos, or of each group's."""
    span = F.greatest(F.max("Latitude") - F.min("Latitude"), F.max("Longitude") - F.min("Longitude"))
    return photos.groupBy(*groups).agg(geo.map_resolution(span).alias("resolution"))


def variety(df: DataFrame, cell: str, by: str) -> DataFrame:
    """cell, n, kinds: of each cell its rows and how many different values of ``by`` they have."""
    return df.where(F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(by).alias("kinds"))
