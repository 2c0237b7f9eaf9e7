"""The photo tables that the queries run on, made of the driver's tables by integer arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import grid

PLATFORMS = ("flickr", "mapillary", "inaturalist", "kartaview")
COUNTRIES = ("Kenya", "France", "Brazil", "Japan", "Canada")
CONTINENTS = ("Africa", "Europe", "South America", "Asia", "North America")
KOPPEN = ("Aw", "Csa", "BWh", "Cfb", "ET", "Dfb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo per event, with a vector's number: the vectors take turns. Latitudes, times and climates are missing here and there."""
    e = F.col("event_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    lat = F.when(e % 17 != 0, ((e * 7919) % 18001 - 9000) / F.lit(100.0))
    lon = ((e * 104729) % 36001 - 18000) / F.lit(100.0)
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        e.cast("string").alias("Photo_ID"),
        pick(PLATFORMS, e % 4).alias("Platform"),
        lat.alias("Latitude"),
        lon.alias("Longitude"),
        F.concat(F.lit("https://img.example.org/"), e.cast("string"), F.when(e % 5 == 0, ".gif").otherwise(".jpg")).alias("Image_URL"),
        F.when(e % 13 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Captured_At"),
        F.when(e % 3 == 0, (e % 20).cast("string")).alias("License"),
        pick(COUNTRIES, e % 5).alias("country"),
        pick(CONTINENTS, e % 5).alias("continent"),
        F.when(e % 11 != 0, pick(KOPPEN, e % 6)).alias("Koppen_Code"),
        "user_id",
        "ts",
        "event_id",
        (e % table(spark, sf_dir, "embeddings").select(F.max("vec_id") + 1).scalar()).alias("vec_id"),
        grid.encode(lat, lon).alias("cell"),
    )


def in_cells(rows: DataFrame, resolution: int, name: str = "c") -> DataFrame:
    """rows with their cell at a coarser resolution, computed once: as a plain expression it would be pushed into filters, where it takes ten times as long."""
    return rows.withColumn(name, F.explode(F.array(grid.parent(F.col("cell"), resolution))))


def _pick(names: tuple[str, ...], by: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({by} AS BIGINT) + 1)"


_E = "event_id"
_LAT = f"CASE WHEN {_E} % 17 <> 0 THEN CAST(({_E} * 7919) % 18001 - 9000 AS DOUBLE) / 100.0e0 END"
_LON = f"CAST(({_E} * 104729) % 36001 - 18000 AS DOUBLE) / 100.0e0"
_SIZE = f"(45.0e0 / {3**grid.FINEST})"
#: The same view for DuckDB, to be put before a query: it names photos.
PHOTOS_SQL = f"""
    WITH base AS (SELECT *, {_LAT} AS Latitude, {_LON} AS Longitude FROM events),
    fine AS (SELECT *, least(CAST(floor((Latitude + 90) / {_SIZE}) AS BIGINT), {grid.rows(grid.FINEST) - 1}) AS cell_row,
                    CAST(floor((Longitude + 180) / {_SIZE}) AS BIGINT) % {2 * grid.rows(grid.FINEST)} AS cell_col FROM base),
    photos AS (SELECT CAST({_E} AS VARCHAR) AS Photo_ID, {_pick(PLATFORMS, _E + ' % 4')} AS Platform, Latitude, Longitude,
                      'https://img.example.org/' || {_E} || CASE WHEN {_E} % 5 = 0 THEN '.gif' ELSE '.jpg' END AS Image_URL,
                      CASE WHEN {_E} % 13 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS Captured_At,
                      CASE WHEN {_E} % 3 = 0 THEN CAST({_E} % 20 AS VARCHAR) END AS License,
                      {_pick(COUNTRIES, _E + ' % 5')} AS country, {_pick(CONTINENTS, _E + ' % 5')} AS continent,
                      CASE WHEN {_E} % 11 <> 0 THEN {_pick(KOPPEN, _E + ' % 6')} END AS Koppen_Code,
                      user_id, ts, {_E}, {_E} % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id, cell_row, cell_col FROM fine)"""


def cell_sql(resolution: int, row: str = "cell_row", col: str = "cell_col") -> str:
    """SQL of the photo's cell at a resolution."""
    step = 3 ** (grid.FINEST - resolution)
    return f"({resolution} * {grid._RES} + ({row} // {step}) * {grid._ROW} + {col} // {step})"
