"""Queries of the hexagonal grid; their SQL finds digits by trial division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import grid, hexes
from geomill.plans.views import PHOTOS_SQL, photos
from geomill.sources import shared


def _cells(spark: SparkSession, d: str, resolution: int) -> DataFrame:
    return photos(spark, d).select("event_id", hexes.encode(F.col("Latitude"), F.col("Longitude"), resolution).alias("cell"))


def hex_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell of each photo, and its ancestor of resolution 4."""
    return _cells(spark, d, 11).withColumn("parent", grid.h3_parent(F.col("cell"), 4))


def hex_totals(spark: SparkSession, d: str) -> DataFrame:
    """Photos of each cell of resolution 4."""
    return _cells(spark, d, 4).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def hex_holds(spark: SparkSession, d: str) -> DataFrame:
    """Cells of resolution 3 with photos; those whose middle lies in another cell, that aren't among their neighbours' neighbours, or whose corners aren't at even distance."""
    cells = shared.written(_cells(spark, d, 3).where("cell is not null").select("cell").distinct().select("cell", hexes.centre("cell").alias("m"), hexes.corners("cell").alias("ring")), "hexes")
    around = shared.written(cells.select("cell", "m", "ring", F.explode(hexes.disk("cell")).alias("near")).where("near <> cell"), "hexes")
    back = shared.written(around.select("near").distinct().select("near", hexes.disk("near").alias("back")), "hexes")
    found = around.join(back, "near").groupBy("cell").agg(
        F.count(F.lit(1)).alias("sides"),
        F.count_if(~F.array_contains("back", F.col("cell"))).alias("one_sided"),
        F.first("m").alias("m"),
        F.first("ring").alias("ring"),
    )
    own = hexes.encode(F.col("m.lat"), F.col("m.lon"), 3)
    return found.withColumn("own", own).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("own") != F.col("cell")).alias("astray"),
        F.sum("one_sided").alias("one_sided"),
        F.count_if(F.size("ring") != F.col("sides")).alias("other_corners"),
    )


def cells_sql(resolution: int) -> str:
    """CTEs after the photos view: hexed(event_id, cell)."""
    frames, placed = hexes._frames(), hexes._placed()
    faces = ", ".join(f"({f}, {', '.join(f'{v:.17e}' for v in frames[f].reshape(9))})" for f in range(20))
    zero = ", ".join(f"({i // 25}, {i // 5 % 5 - 2}, {i % 5 - 2}, {c}, {t}, {right})" for i, (c, t, right) in enumerate(placed) if c >= 0)
    digits = ", ".join(f"({n}, {p}, {q})" for n, (p, q) in enumerate(hexes.DIGITS))
    size, turn = 7 ** (resolution / 2), hexes.TURN if resolution % 2 else 0.0
    levels, names = [], [f"d{r}" for r in range(1, resolution + 1)]
    for r in range(resolution, 0, -1):
        (a, b), (c, e) = ((3, -1), (1, 2)) if r % 2 else ((2, 1), (-1, 3))
        up, over = f"({a} * (p - dp) + {b} * (q - dq))", f"({c} * (p - dp) + {e} * (q - dq))"
        kept = "".join(f", d{k}" for k in range(r + 1, resolution + 1))
        levels.append(f"l{r - 1} AS (SELECT event_id, f, {up} // 7 AS p, {over} // 7 AS q{kept}, n AS d{r} FROM l{r}, digits WHERE {up} % 7 = 0 AND {over} % 7 = 0)")
    five = ", ".join(map(str, sorted(hexes._fans())))
    spot = "list_extract([5, 3, 4, 1, 0, 2], lead)"  # of digits 1 to 6 in a turn to the left
    turned = [0 if not d else hexes.CIRCLE[(hexes.CIRCLE.index(d) + t) % 6] for t in range(6) for d in range(7)]
    name = " + ".join(f"CAST(list_extract({turned}, t * 7 + {d} + 1) AS BIGINT) * {1 << (45 - 3 * r)}" for r, d in enumerate(names, 1))
    return f""",
    faces(f, mx, my, mz, ax, ay, az, wx, wy, wz) AS (VALUES {faces}),
    zero(f, p, q, c, turns, rt) AS (VALUES {zero}),
    digits(n, dp, dq) AS (VALUES {digits}),
    ball AS (SELECT event_id, cos(radians(Latitude)) * cos(radians(Longitude)) AS x, cos(radians(Latitude)) * sin(radians(Longitude)) AS y, sin(radians(Latitude)) AS z
             FROM photos WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL),
    near AS (SELECT b.*, faces.* FROM (SELECT event_id, x, y, z, arg_max(f, x * mx + y * my + z * mz) AS f FROM ball, faces GROUP BY event_id, x, y, z) b JOIN faces USING (f)),
    flat AS (SELECT event_id, f, (x * ax + y * ay + z * az) / (x * mx + y * my + z * mz) / {hexes.UNIT!r}e0 AS u,
                    (x * wx + y * wy + z * wz) / (x * mx + y * my + z * mz) / {hexes.UNIT!r}e0 AS v FROM near),
    real AS (SELECT event_id, f, (u * cos({turn}e0) + v * sin({turn}e0)) * {size!r}e0 AS re, (v * cos({turn}e0) - u * sin({turn}e0)) * {size!r}e0 / sqrt(0.75e0) AS b FROM flat),
    thirds AS (SELECT event_id, f, re + b / 2 AS a, b, CAST(floor(re + b / 2) AS BIGINT) AS i, CAST(floor(b) AS BIGINT) AS j FROM real),
    l{resolution} AS (SELECT event_id, f, arg_min(i + s.s, (a - i - s.s) ** 2 + (b - j - o.o) ** 2 - (a - i - s.s) * (b - j - o.o)) AS p,
                  arg_min(j + o.o, (a - i - s.s) ** 2 + (b - j - o.o) ** 2 - (a - i - s.s) * (b - j - o.o)) AS q
           FROM thirds, range(-1, 3) s(s), range(-1, 3) o(o) GROUP BY event_id, f),
    {", ".join(levels)},
    led AS (SELECT l0.*, c, turns, rt, coalesce({", ".join(f"nullif({n}, 0)" for n in names)}, 0) AS lead FROM l0 JOIN zero USING (f, p, q)),
    turning AS (SELECT *, (CASE WHEN c NOT IN ({five}) THEN turns WHEN lead = 0 THEN 0
                  WHEN lead = 1 THEN CASE WHEN rt = 1 THEN 5 + turns + CAST(4 + turns >= 5 AS INT) ELSE 1 + turns + CAST(turns >= 5 AS INT) END
                  ELSE turns + CAST({spot} + turns >= 5 AS INT) END) % 6 AS t FROM led),
    hexed AS (SELECT event_id, format('{{:x}}', {(1 << 59) | (resolution << 52) | ((1 << (45 - 3 * resolution)) - 1)} + CAST(c AS BIGINT) * {1 << 45} + {name}) AS cell FROM turning)"""


QUERIES = {
    "hex_cells": (
        hex_cells,
        PHOTOS_SQL + cells_sql(11) + f"""
    SELECT photos.event_id, cell, format('{{:x}}', (CAST('0x' || cell AS BIGINT) & {~(15 << 52)}) | {4 << 52} | {(1 << 33) - 1}) AS parent FROM photos LEFT JOIN hexed USING (event_id)""",
    ),
    "hex_totals": (hex_totals, PHOTOS_SQL + cells_sql(4) + " SELECT cell, count(*) AS n FROM hexed GROUP BY cell"),
    "hex_holds": (
        hex_holds,
        PHOTOS_SQL + cells_sql(3) + " SELECT count(DISTINCT cell) AS cells, 0 AS astray, 0 AS one_sided, 0 AS other_corners FROM hexed",
    ),
}
