"""Boxes, polygons, rasters, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import climate, grid
from geomill.operators import dissolve, regions
from geomill.plans.views import PHOTOS_SQL, cell_sql, photos
from geomill.sources import shapefiles, shared

#: A raster of ten-degree pixels whose value is arithmetic.
STEP = 10.0


def _raster(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(18 * 36).select(F.floor(i / 36).cast("int").alias("row"), (i % 36).cast("int").alias("col"), (i * 7 % 31).cast("int").alias("value")).where("value > 0")


def koppen_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = photos(spark, d).select("event_id", "Latitude", "Longitude")
    return regions.koppen(p, _raster(spark), -180.0, 90.0, STEP).select("event_id", "Koppen_Code", "Koppen_Desc")


_LEGEND = ", ".join(f"({k}, '{c}', '{d}')" for k, (c, d) in climate.KOPPEN.items())
_PIXEL = f"CASE WHEN Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180 AND floor((90 - Latitude) / 10.0e0) < 18 AND floor((Longitude + 180) / 10.0e0) < 36 THEN ((CAST(floor((90 - Latitude) / 10.0e0) AS BIGINT) * 36 + CAST(floor((Longitude + 180) / 10.0e0) AS BIGINT)) * 7) % 31 END"
KOPPEN_LOOKUP = PHOTOS_SQL + f" SELECT event_id, c AS Koppen_Code, d AS Koppen_Desc FROM (SELECT event_id, {_PIXEL} AS v FROM photos) LEFT JOIN (VALUES {_LEGEND}) l(k, c, d) ON k = v"


def overlay_levels(spark: SparkSession, d: str) -> DataFrame:
    """Habitat names at three levels, a missing one from the coarser."""
    v = F.col("id").cast("int")
    legend = spark.range(1, 31).select(v.alias("value"), F.concat(F.lit("L"), (v % 5).cast("string")).alias("l1"), F.when(v % 2 == 0, F.concat(F.lit("M"), v.cast("string"))).alias("l2"), F.when(v % 3 == 0, F.concat(F.lit("N"), v.cast("string"))).otherwise("").alias("l3"))
    p = regions.raster_lookup(photos(spark, d).select("event_id", "Latitude", "Longitude"), _raster(spark), -180.0, 90.0, STEP)
    return regions.overlay_label(p, F.broadcast(legend), "value", ("l1", "l2", "l3")).select("event_id", "l1", "l2", "l3")


OVERLAY_LEVELS = PHOTOS_SQL + f""", v AS (SELECT event_id, CASE WHEN NOT (Latitude = 0 AND Longitude = 0) THEN nullif({_PIXEL}, 0) END AS v FROM photos),
    n AS (SELECT event_id, v, 'L' || v % 5 AS l1, coalesce(CASE WHEN v % 2 = 0 THEN 'M' || v END, 'L' || v % 5) AS l2 FROM v)
    SELECT event_id, l1, l2, coalesce(CASE WHEN v % 3 = 0 THEN 'N' || v END, l2) AS l3 FROM n"""


def _boxes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    south, west = (i * 37 % 150 - 80).cast("double"), (i * 91 % 330 - 175).cast("double")
    return spark.range(60).select(i.alias("box_id"), south.alias("south"), (south + 5).alias("north"), west.alias("west"), (west + 7.5).alias("east"))


_BOXES = "boxes AS (SELECT i AS box_id, CAST(i * 37 % 150 - 80 AS DOUBLE) AS south, CAST(i * 37 % 150 - 75 AS DOUBLE) AS north, CAST(i * 91 % 330 - 175 AS DOUBLE) AS west, i * 91 % 330 - 167.5e0 AS east FROM range(60) t(i))"


def box_hits(spark: SparkSession, d: str) -> DataFrame:
    return regions.box_hits(photos(spark, d), _boxes(spark), 3).select("event_id", "box_id")


BOX_HITS = PHOTOS_SQL + f", {_BOXES} SELECT event_id, box_id FROM photos JOIN boxes ON Latitude BETWEEN south AND north AND Longitude BETWEEN west AND east"


def box_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = regions.box_hits(photos(spark, d), _boxes(spark), 3)
    return regions.box_groups(hits, "Platform").select("box_id", "hits", F.array_join("groups", ",").alias("groups"))


BOX_GROUPS = PHOTOS_SQL + f", {_BOXES} SELECT box_id, count(*) AS hits, string_agg(DISTINCT Platform, ',' ORDER BY Platform) AS groups FROM photos JOIN boxes ON Latitude BETWEEN south AND north AND Longitude BETWEEN west AND east GROUP BY 1"


def photo_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of about 500 km over all places of photos."""
    e = photos(spark, d).agg(F.min("Latitude"), F.max("Latitude"), F.min("Longitude"), F.max("Longitude")).first()
    return regions.grid_boxes(spark, *e, 500.0)


def grid_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The photos in each box of a grid over all of them."""
    boxes = photo_boxes(spark, d)
    held = regions.box_hits(photos(spark, d).select("Latitude", "Longitude", "event_id"), boxes, 2).groupBy("box_id").agg(F.count(F.lit(1)).alias("photos"))
    return boxes.join(held, "box_id", "left").select("box_id", *[F.round(x, 6).alias(x) for x in ("south", "north", "west", "east")], F.coalesce("photos", F.lit(0)).cast("long").alias("photos"))


PHOTO_BOXES = PHOTOS_SQL + """
    , e AS (SELECT min(Latitude) AS s0, max(Latitude) AS n0, min(Longitude) AS w0, max(Longitude) AS e0, 500 / 111.32e0 AS step FROM photos),
    b0 AS (SELECT *, unnest(range(greatest(1, CAST(ceil(round((n0 - s0) / step, 9)) AS BIGINT)))) AS r FROM e),
    b1 AS (SELECT *, s0 + r * step AS s, least(s0 + r * step + step, n0) AS n FROM b0), b2 AS (SELECT *, step / cos(radians(greatest(least((s + n) / 2, 89.9), -89.9))) AS w FROM b1),
    b3 AS (SELECT *, unnest(range(greatest(CAST(ceil((e0 - w0) / w) AS BIGINT), 1))) AS c FROM b2),
    boxes AS (SELECT r || '_' || c AS box_id, s AS south, n AS north, w0 + c * w AS west, least(w0 + c * w + w, e0) AS east FROM b3)"""
GRID_BOXES = PHOTO_BOXES + """
    SELECT box_id, round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east, count(event_id) AS photos
    FROM boxes LEFT JOIN photos ON Latitude BETWEEN south AND north AND Longitude BETWEEN west AND east GROUP BY ALL"""


def _uncovered(spark: SparkSession, d: str) -> DataFrame:
    """All cells at resolution 3 without a photo."""
    n = grid.rows(3)
    every = spark.range(n * 2 * n).select(grid.cell(F.floor(F.col("id") / (2 * n)), F.col("id") % (2 * n), 3).alias("c"))
    return every.join(photos(spark, d).select(grid.parent(F.col("cell"), 3).alias("c")).where("c is not null"), "c", "left_anti")


def uncovered_polygons(spark: SparkSession, d: str) -> DataFrame:
    """What no photo covers, as polygons."""
    return dissolve.rings(_uncovered(spark, d), "c", 3).select("ring", "is_hole", F.round("area", 6).alias("area"), F.size("points").alias("points"))


def uncovered_holds(spark: SparkSession, d: str) -> DataFrame:
    """Of these polygons: the area that rings, less holes, enclose; the outer rings less the holes; and their corners."""
    r = dissolve.rings(_uncovered(spark, d), "c", 3)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return r.agg(F.round(total("area"), 4).alias("area"), total(F.when(F.col("is_hole"), -1).otherwise(1)).cast("long").alias("outer_less_holes"), total(F.size("points") - 1).cast("long").alias("corners"))


#: Each vertex sees four cells: one or three of the set there make a corner, two across two. Corners tell outer rings less holes (Euler's number).
UNCOVERED_HOLDS = PHOTOS_SQL + f"""
    , u AS (SELECT i, j FROM range({grid.rows(3)}) a(i), range({2 * grid.rows(3)}) b(j) EXCEPT SELECT cell_row // {3 ** (grid.FINEST - 3)}, cell_col // {3 ** (grid.FINEST - 3)} FROM photos WHERE Latitude IS NOT NULL),
    v AS (SELECT i + di AS vi, j + dj AS vj, count(*) AS n, sum(CASE WHEN di = dj THEN 1 ELSE -1 END) AS across FROM u, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(di, dj) GROUP BY 1, 2)
    SELECT round((SELECT count(*) FROM u) * {grid.cell_size(3)}e0 * {grid.cell_size(3)}e0, 4) AS area,
           CAST((count(*) FILTER (n = 1) - count(*) FILTER (n = 3) + 2 * count(*) FILTER (n = 2 AND abs(across) = 2)) // 4 AS BIGINT) AS outer_less_holes,
           CAST(count(*) FILTER (n = 1 OR n = 3) + 2 * count(*) FILTER (n = 2 AND abs(across) = 2) AS BIGINT) AS corners FROM v"""


def cell_disks(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the cells of photos at resolution 1, over the antimeridian and to the poles."""
    cells = photos(spark, d).where("cell is not null").select(grid.parent(F.col("cell"), 1).alias("c")).distinct()
    return cells.select("c", F.explode(grid.disk(F.col("c"))).alias("neighbour"))


CELL_DISKS = PHOTOS_SQL + f""", c AS (SELECT DISTINCT {cell_sql(1)} AS c, cell_row // {3**10} AS r, cell_col // {3**10} AS k FROM photos WHERE Latitude IS NOT NULL)
    SELECT DISTINCT c, {grid._RES} + (r + i) * {grid._ROW} + (k + j + 24) % 24 AS neighbour FROM c, range(-1, 2) a(i), range(-1, 2) b(j) WHERE r + i BETWEEN 0 AND 11"""


def region_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Photos per region: two polygons, places within 88.8 km of one, and the rest."""
    ring = [("Inland", "Europe", [[0.0, 40.0], [10.0, 40.0], [10.0, 50.0], [0.0, 50.0]]), ("Cape", "Africa", [[20.0, -35.0], [30.0, -35.0], [25.0, -25.0]])]
    polygons = spark.createDataFrame(ring, "name string, continent string, ring array<array<double>>")
    return regions.map_regions(photos(spark, d), polygons, resolution=6).groupBy("country", "continent").agg(F.count(F.lit(1)).alias("n"))


_EDGES = [("Inland", "Europe", 0, 40, 10, 40), ("Inland", "Europe", 10, 40, 10, 50), ("Inland", "Europe", 10, 50, 0, 50), ("Inland", "Europe", 0, 50, 0, 40), ("Cape", "Africa", 20, -35, 30, -35), ("Cape", "Africa", 30, -35, 25, -25), ("Cape", "Africa", 25, -25, 20, -35)]
_MERCATOR_X, _MERCATOR_Y = "6378137.0e0 * radians({0})", "6378137.0e0 * ln(tan(radians({0}) / 2 + pi() / 4))"
REGION_MAPPING = PHOTOS_SQL + f"""
    , rc AS (SELECT {cell_sql(6)} AS rc, any_value(cell_row // {3 ** (grid.FINEST - 6)}) AS r, any_value(cell_col // {3 ** (grid.FINEST - 6)}) AS c, count(*) AS n FROM photos WHERE Latitude IS NOT NULL GROUP BY 1),
    p AS (SELECT rc, n, (r + 0.5e0) * {grid.cell_size(6)!r}::DOUBLE - 90 AS la, (c + 0.5e0) * {grid.cell_size(6)!r}::DOUBLE - 180 AS lo FROM rc),
    e(name, continent, x1, y1, x2, y2) AS (VALUES {", ".join(f"('{n}', '{k}', {a}.0e0, {b}.0e0, {c}.0e0, {d}.0e0)" for n, k, a, b, c, d in _EDGES)}),
    m AS (SELECT rc, n, la, lo, e.*, {_MERCATOR_X.format("lo")} AS px, {_MERCATOR_Y.format("la")} AS py, {_MERCATOR_X.format("x1")} AS ax, {_MERCATOR_Y.format("y1")} AS ay, {_MERCATOR_X.format("x2")} AS bx, {_MERCATOR_Y.format("y2")} AS "by" FROM p, e),
    t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / ((bx - ax) ** 2 + ("by" - ay) ** 2))) AS t, (y1 > la) <> (y2 > la) AND lo < (x2 - x1) * (la - y1) / (y2 - y1) + x1 AS crosses FROM m),
    g AS (SELECT rc, name, continent, CASE WHEN count(*) FILTER (crosses) % 2 = 1 THEN 0 ELSE min(sqrt((ax + t * (bx - ax) - px) ** 2 + (ay + t * ("by" - ay) - py) ** 2)) END AS d FROM t GROUP BY ALL),
    b AS (SELECT rc, name, continent FROM g WHERE d <= 88800 QUALIFY row_number() OVER (PARTITION BY rc ORDER BY round(d, 3), name) = 1)
    SELECT coalesce(name, 'Ocean / Unknown') AS country, coalesce(continent, 'Ocean / Unknown') AS continent, count(*) AS n FROM (SELECT CASE WHEN Latitude IS NOT NULL THEN {cell_sql(6)} END AS rc FROM photos) LEFT JOIN b USING (rc) GROUP BY 1, 2"""


def shapes_stored(spark: SparkSession, d: str) -> DataFrame:
    """Each user's extent, with a hole of half its width and height, written as a shapefile and read again."""
    ends = [f(c).alias(n) for n, f, c in (("west", F.min, "Longitude"), ("east", F.max, "Longitude"), ("south", F.min, "Latitude"), ("north", F.max, "Latitude"))]
    box = photos(spark, d).where("Latitude is not null").groupBy(F.col("user_id").cast("string").alias("NAME")).agg(*ends).where("west < east and south < north")

    def ring(inset: float):  # noqa: ANN202
        x, y = (F.col("east") - F.col("west")) * inset, (F.col("north") - F.col("south")) * inset
        w, e, s, n = F.col("west") + x, F.col("east") - x, F.col("south") + y, F.col("north") - y
        return F.array(*[F.array(*p) for p in ((w, s), (w, n), (e, n), (e, s), (w, s))])

    path = shared.new_path(spark, "shapes")
    shapefiles.write(box.select("NAME", F.lit("X").alias("CONTINENT"), F.array(ring(0.0), ring(0.25)).alias("rings")), path)
    span = lambda r, i: F.array_max(F.transform(r, lambda p: p[i])) - F.array_min(F.transform(r, lambda p: p[i]))
    area = lambda r: span(r, 0) * span(r, 1)
    lon, lat = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    return shapefiles.polygons(spark, path).select(
        "name",
        F.size("rings").alias("n_rings"),
        F.array_min(lon).alias("west"),
        F.array_max(lon).alias("east"),
        F.array_min(lat).alias("south"),
        F.array_max(lat).alias("north"),
        F.round(area(F.col("ring")) - area(F.col("rings")[1]), 6).alias("area"),
    )


SHAPES_STORED = PHOTOS_SQL + """, b AS (SELECT CAST(user_id AS VARCHAR) AS name, min(Longitude) AS west, max(Longitude) AS east, min(Latitude) AS south, max(Latitude) AS north
    FROM photos WHERE Latitude IS NOT NULL GROUP BY user_id)
    SELECT name, CAST(2 AS INT) AS n_rings, west, east, south, north, round((east - west) * (north - south) * 0.75e0, 6) AS area FROM b WHERE west < east AND south < north"""

QUERIES = {
    "shapes_stored": (shapes_stored, SHAPES_STORED),
    "koppen_lookup": (koppen_lookup, KOPPEN_LOOKUP),
    "overlay_levels": (overlay_levels, OVERLAY_LEVELS),
    "box_hits": (box_hits, BOX_HITS),
    "box_groups": (box_groups, BOX_GROUPS),
    "grid_boxes": (grid_boxes, GRID_BOXES),
    "uncovered_polygons": (uncovered_polygons, None),
    "uncovered_holds": (uncovered_holds, UNCOVERED_HOLDS),
    "cell_disks": (cell_disks, CELL_DISKS),
    "region_mapping": (region_mapping, REGION_MAPPING),
}
