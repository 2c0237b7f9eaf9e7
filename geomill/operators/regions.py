"""Points against boxes, polygons and rasters, all through grid cells: no cross joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, grid

#: Metres in Web Mercator that a place may lie off its region.
NEAREST_M = 88_800.0
#: Polygons that are broadcast at most, as coordinates.
SHAPE_BYTES = 64 << 20


def projected_lookup(points: DataFrame, raster: DataFrame, west: float, north: float, step: float, value: str = "value") -> DataFrame:
    """points with the value of a raster on the European equal-area grid (west, north and step in metres); null outside, without a coordinate, or at (0, 0)."""
    lat, lon = F.col("Latitude"), F.col("Longitude")
    x, y = geo.laea_europe(lat, lon)
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    keyed = points.withColumns({"__row": F.when(ok, F.floor((north - y) / step).cast("int")), "__col": F.when(ok, F.floor((x - west) / step).cast("int"))})
    r = raster.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias(value))
    return keyed.join(r, (F.col("__row") == F.col("__r")) & (F.col("__col") == F.col("__c")), "left").drop("__row", "__col", "__r", "__c")


def class_label(points: DataFrame, legend: DataFrame, value: str, label: str = "label", unknown: str = "Unknown") -> DataFrame:
    """points with the legend's (key, label) name of a raster value: by the value as text, else by its whole number; else ``unknown``."""
    text = F.trim(F.col(value).cast("string"))
    whole = F.col(value).try_cast("double").cast("long").cast("string")
    names = legend.select(F.trim(F.col("key").cast("string")).alias("__k"), F.col("label").alias("__n"))
    first = points.join(names, text == F.col("__k"), "left").drop("__k").withColumnRenamed("__n", "__first")
    return first.join(names, whole == F.col("__k"), "left").withColumn(label, F.coalesce("__first", "__n", F.lit(unknown))).drop("__k", "__n", "__first")


def raster_lookup(points: DataFrame, raster: DataFrame, west: float, north: float, step: float, value: str = "value", lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """points with the value of the raster(row, col, value) pixel below them; null outside, or without a coordinate.

    Join keys are pixel numbers: Spark broadcasts a small raster and shuffles a large one.
    """
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    keyed = points.withColumns({"__row": F.when(ok, F.floor((north - F.col(lat)) / step).cast("int")), "__col": F.when(ok, F.floor((F.col(lon) - west) / step).cast("int"))})
    r = raster.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias(value))
    return keyed.join(r, (F.col("__row") == F.col("__r")) & (F.col("__col") == F.col("__c")), "left").drop("__row", "__col", "__r", "__c")


def overlay_label(points: DataFrame, legend: DataFrame, value: str, levels: tuple[str, ...], absent: str | None = None) -> DataFrame:
    """Legend names of a raster value at each level; ``absent`` for values up to 0 and at (0, 0). A level without a name takes the next coarser one's."""
    named = points.join(legend.select(F.col("value").alias("__v"), *levels), F.col(value) == F.col("__v"), "left").drop("__v")
    none = (F.col(value) <= 0) | F.col(value).isNull() | ((F.col("Latitude") == 0) & (F.col("Longitude") == 0))
    filled: dict[str, Column] = {}
    for i in range(len(levels)):
        chain = [F.nullif(F.col(levels[j]), F.lit("")) for j in range(i, -1, -1)]
        filled[levels[i]] = F.coalesce(F.when(~none, F.coalesce(*chain)), F.lit(absent))
    return named.withColumns(filled)


def koppen(points: DataFrame, raster: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """points with Koppen_Code and Koppen_Desc."""
    from geomill.functions.climate import KOPPEN

    spark = points.sparkSession
    legend = spark.createDataFrame([(k, c, d) for k, (c, d) in KOPPEN.items()], "value int, Koppen_Code string, Koppen_Desc string")
    found = raster_lookup(points.drop("Koppen_Code", "Koppen_Desc"), raster, west, north, step, "__k")
    return found.join(F.broadcast(legend), F.col("__k") == legend["value"], "left").drop("__k", "value")


def _cells_of_box(south: Column, north: Column, west: Column, east: Column, resolution: int) -> Column:
    """The grid cells that a box touches, as an array. West of its east side, or beyond 180 degrees, a box goes on at the other end."""
    size, n = F.lit(grid.cell_size(resolution)), grid.rows(resolution)
    row = lambda lat: F.least(F.greatest(F.floor((lat + 90) / size), F.lit(0)), F.lit(n - 1))
    first = F.floor((west + 180) / size)
    last = F.floor((F.when(east < west, east + 360).otherwise(east) + 180) / size)
    cols = F.sequence(first, F.least(last, first + (2 * n - 1)))
    return F.flatten(F.transform(F.sequence(row(south), row(north)), lambda r: F.transform(cols, lambda c: grid.cell(r, F.pmod(c, F.lit(2 * n).cast("long")), resolution))))


def _between_meridians(lon: Column, west: Column, east: Column) -> Column:
    crossing = F.when(east > 180, lon + 360 <= east).when(west < -180, lon - 360 >= west).otherwise(F.lit(False))
    return F.when(west <= east, lon.between(west, east) | crossing).otherwise((lon >= west) | (lon <= east))


def box_hits(points: DataFrame, boxes: DataFrame, resolution: int = 4, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """points joined with the boxes (box_id, south, north, west, east) that hold them: an equi-join on cells, then the comparison. A box with west > east goes over the antimeridian."""
    cells = boxes.select("*", F.explode(_cells_of_box(F.col("south"), F.col("north"), F.col("west"), F.col("east"), resolution)).alias("__cell"))
    inside = F.col(lat).between(F.col("south"), F.col("north")) & _between_meridians(F.col(lon), F.col("west"), F.col("east"))
    # a point on the lower edge of a cell belongs to the cell, so every box that holds it touches that cell
    return points.withColumn("__own", grid.encode(F.col(lat), F.col(lon), resolution)).join(cells, (F.col("__own") == F.col("__cell")) & inside).drop("__own", "__cell")


def uncovered_boxes(points: DataFrame, boxes: DataFrame, resolution: int = 4, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """The boxes that hold no point."""
    held = box_hits(points.select(lat, lon), boxes, resolution, lat, lon).select("box_id").distinct()
    return boxes.join(held, "box_id", "left_anti")


def boxes_meeting(boxes: DataFrame, regions: DataFrame, resolution: int = 3) -> DataFrame:
    """boxes that meet some region (south, north, west, east) in more than an edge: an equi-join on cells, then the comparison."""
    of = lambda df: df.withColumn("__cell", F.explode(_cells_of_box(F.col("south"), F.col("north"), F.col("west"), F.col("east"), resolution)))
    r = of(regions.select(*[F.col(c).alias(f"r_{c}") for c in ("south", "north", "west", "east")], *[F.col(c) for c in ("south", "north", "west", "east")])).drop("south", "north", "west", "east")
    meets = (F.col("south") < F.col("r_north")) & (F.col("north") > F.col("r_south")) & (F.col("west") < F.col("r_east")) & (F.col("east") > F.col("r_west"))
    found = of(boxes).join(r, "__cell").where(meets).select("box_id").distinct()
    return boxes.join(found, "box_id", "left_semi")


def shard(rows: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """Every shards-th row in the order of its key's hash: one worker's part of a job that several share."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(shards).cast("long")) == index)


def box_groups(hits: DataFrame, group: str) -> DataFrame:
    """Of each box its hits and the distinct groups among them, most hits first."""
    return hits.groupBy("box_id").agg(F.count(F.lit(1)).alias("hits"), F.sort_array(F.collect_set(group)).alias("groups")).orderBy(F.desc("hits"), "box_id")


def grid_boxes(spark, south: float, north: float, west: float, east: float, km: float, clip: bool = True) -> DataFrame:  # noqa: ANN001
    """box_id, south, north, west, east of a grid of about km by km; clip cuts the last ones at the edge, else longitude steps follow each row's lower edge."""
    import math

    step = km / 111.32
    rows = max(1, math.ceil(round((north - south) / step, 9)))
    base = spark.range(rows).select((F.lit(south) + F.col("id") * step).alias("s"), F.col("id").alias("r"))
    base = base.withColumn("n", F.least(F.col("s") + step, F.lit(north)) if clip else F.col("s") + step)
    at = (F.col("s") + F.col("n")) / 2 if clip else F.col("s")
    wide = F.lit(step) / F.cos(F.radians(F.greatest(F.least(at, F.lit(89.9)), F.lit(-89.9))))
    cols = base.withColumn("w_step", wide).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.lit(east - west)) / F.col("w_step")).cast("int") - 1, F.lit(0)))).alias("c"))
    x = F.lit(west) + F.col("c") * F.col("w_step")
    right = F.least(x + F.col("w_step"), F.lit(east)) if clip else x + F.col("w_step")
    return cols.select(F.concat_ws("_", "r", "c").alias("box_id"), F.col("s").alias("south"), F.col("n").alias("north"), x.alias("west"), right.alias("east"))


def inside_polygon(rings: list[np.ndarray], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon, by the parity of crossings with all its rings of (lon, lat): the holes' too."""
    crossings = np.zeros(len(lat), np.int64)
    for ring in rings:
        x, y = ring[:, 0], ring[:, 1]
        px, py = np.roll(x, -1), np.roll(y, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((y > lat[:, None]) != (py > lat[:, None])) & (lon[:, None] < (px - x) * (lat[:, None] - y) / (py - y) + x)
        crossings += crosses.sum(axis=1)
    return crossings % 2 == 1


def _distance_m(ring: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Web-Mercator metres of points to a ring of (lon, lat)."""
    def project(la: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return np.stack([np.radians(lo) * geo.MERCATOR_M, np.log(np.tan(np.radians(np.clip(la, -89.9, 89.9)) / 2 + np.pi / 4)) * geo.MERCATOR_M], axis=-1)

    a = project(ring[:, 1], ring[:, 0])
    b, p = np.roll(a, -1, axis=0), project(lat, lon)
    d = b - a
    length = np.maximum((d * d).sum(axis=1), 1e-9)
    t = np.clip(((p[:, None, :] - a) * d).sum(axis=2) / length, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - p[:, None, :]) ** 2).sum(axis=2)).min(axis=1)


def polygon_distance_m(rings: list[np.ndarray], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres to a polygon, 0 inside. Points are taken from the side of the antimeridian on which the polygon lies."""
    middle = (rings[0][:, 0].min() + rings[0][:, 0].max()) / 2
    lon = lon - 360 * np.round((lon - middle) / 360)
    out = np.zeros(len(lat))
    for at in range(0, len(lat), 256):
        la, lo = lat[at : at + 256], lon[at : at + 256]
        d = np.minimum.reduce([_distance_m(r, la, lo) for r in rings])
        d[inside_polygon(rings, la, lo)] = 0.0
        out[at : at + 256] = d
    return out


def map_regions(photos: DataFrame, polygons: DataFrame, cell: str = "cell", resolution: int = 8, nearest_m: float = NEAREST_M, coarse: int = 3) -> DataFrame:
    """photos with country and continent of the polygon at their cell's centre, else of the nearest one within nearest_m, else ``Ocean / Unknown``.

    polygons: name, continent, rings (the outer one, then holes; each an array of arrays
    lon, lat) or only ring. Geometry is computed once for each distinct cell; candidates
    are found by an equi-join on coarse cells that the polygon's box, widened by the
    distance, touches. Shapes of up to ``SHAPE_BYTES`` are broadcast, larger ones ride with
    the candidates. Of several the smallest name holds.
    """
    shapes = polygons.select("name", "continent", (F.col("rings") if "rings" in polygons.columns else F.array("ring")).alias("rings"))
    size = shapes.agg(F.sum(F.size(F.flatten("rings")).cast("long") * 16)).first()[0] or 0
    held = None
    if size <= SHAPE_BYTES:
        known = shapes.collect()
        held = photos.sparkSession.sparkContext.broadcast([[np.array(ring, float) for ring in r["rings"]] for r in known])
        rows = [(i, r["name"], r["continent"], *[float(f(p[k] for p in r["rings"][0])) for k, f in ((1, min), (1, max), (0, min), (0, max))]) for i, r in enumerate(known)]
        boxes = photos.sparkSession.createDataFrame(rows, "pid int, name string, continent string, south double, north double, west double, east double")
    else:
        lats, lons = F.transform(F.col("rings")[0], lambda p: p[1]), F.transform(F.col("rings")[0], lambda p: p[0])
        boxes = shapes.select(F.lit(0).alias("pid"), "name", "continent", F.array_min(lats).alias("south"), F.array_max(lats).alias("north"), F.array_min(lons).alias("west"), F.array_max(lons).alias("east"), "rings")
    pad = nearest_m / 111_320.0 * 1.5
    boxes = boxes.withColumn("__c", F.explode(_cells_of_box(F.col("south") - pad, F.col("north") + pad, F.col("west") - 3 * pad, F.col("east") + 3 * pad, coarse)))
    cells = photos.where(F.col(cell).isNotNull()).select(grid.parent(F.col(cell), resolution).alias("rc")).distinct()
    lat, lon = grid.centre(F.col("rc"))
    asked = cells.select("rc", lat.alias("lat"), lon.alias("lon"), grid.parent(F.col("rc"), coarse).alias("__o"))
    keys = ["pid"] if held is not None else ["name", "west", "south"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.zeros(len(pdf))
            for _, at in pdf.groupby(keys).indices.items():
                rings = held.value[pdf["pid"].iloc[at[0]]] if held is not None else [np.array([list(p) for p in ring], float) for ring in pdf["rings"].iloc[at[0]]]
                rows[at] = polygon_distance_m(rings, pdf["lat"].to_numpy()[at], pdf["lon"].to_numpy()[at])
            yield pdf[["rc", "name", "continent"]].assign(d=rows)

    more = [] if held is not None else ["west", "south", "rings"]
    measured = asked.join(boxes, F.col("__o") == F.col("__c")).select("rc", "lat", "lon", "name", "continent", "pid", *more).mapInPandas(measure, "rc long, name string, continent string, d double")
    best = measured.where(F.col("d") <= nearest_m).groupBy("rc").agg(F.min_by(F.struct("name", "continent"), F.struct(F.round("d", 3), "name")).alias("b"))
    unknown = F.lit("Ocean / Unknown")
    keyed = photos.drop("country", "continent").withColumn("__rc", grid.parent(F.col(cell), resolution))
    joined = keyed.join(best, F.col("__rc") == F.col("rc"), "left")
    return joined.withColumns({"country": F.coalesce("b.name", unknown), "continent": F.coalesce("b.continent", unknown)}).drop("__rc", "rc", "b")
