"""Cells of the grid dissolved into polygons.

Each cell's four edges go round it against the clock. An edge between two cells of the
set is there in both directions, and both go. What is left are the borders, with the set
on their left hand. An edge is followed by that of its end which turns left, or goes on,
or turns right, in this order, so cells that touch in a corner alone stay apart. Rings
are found by pointer doubling: in each round every edge learns the smallest edge, and then
the number of edges to its ring's end, of twice as many edges ahead. So a ring of n edges
takes about log2(n) rounds of equi-joins, and rings of any length are spread over tasks
until their points are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import grid
from geomill.sources import shared

#: East, north, west, south: (rows, columns) that an edge goes on.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))
_VERTEX = 1 << 24


def _vertex(i: Column, j: Column) -> Column:
    return i * _VERTEX + j


def borders(cells: DataFrame, cell: str) -> DataFrame:
    """id, start, end (vertices), way (0 to 3), i and j (of the start) of the edges between a distinct cell and what isn't one of them."""
    c = F.col(cell)
    at = cells.where(c.isNotNull()).select(grid.row(c).alias("i"), grid.col(c).alias("j")).distinct()
    corners = ((0, 0), (0, 1), (1, 1), (1, 0))
    edges = F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(w).alias("way")) for w, (di, dj) in enumerate(corners)])
    e = at.select(F.explode(edges).alias("e")).select("e.*")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("way") + 1)
    e = e.select("i", "j", "way", _vertex(F.col("i"), F.col("j")).alias("start"), _vertex(F.col("i") + pick(0), F.col("j") + pick(1)).alias("end"))
    once = e.groupBy(F.least("start", "end").alias("a"), F.greatest("start", "end").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("i", "j", "way", "start", "end")).alias("e")).where("n = 1").select("e.*")
    return once.withColumn("id", F.col("start") * 4 + F.col("way"))


def rings(cells: DataFrame, cell: str, resolution: int) -> DataFrame:
    """ring, is_hole, area (square degrees, of a hole below 0) and points (lat, lon; the first once more at the end, none within a straight line) of the border of a set of cells of one resolution. The antimeridian is a border; empty sets have no rings."""
    edges = shared.written(borders(cells, cell), "edges")
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(2)), F.pmod(F.col("w2") - F.col("way"), F.lit(4)).cast("int") + 1)  # on, left, back, right
    after = edges.select(F.col("start").alias("end"), F.col("id").alias("next"), F.col("way").alias("w2"))
    follow = shared.written(edges.select("id", "end", "way").join(after, "end").groupBy("id").agg(F.min_by("next", turn).alias("next")), "follow")

    other = lambda s, **more: s.select(F.col("id").alias("next"), F.col("next").alias("far"), *[F.col(a).alias(b) for b, a in more.items()])
    state, changed = follow.withColumn("low", F.least("id", "next")), True
    while changed:
        seen = state.join(other(state, ahead="low"), "next").select("id", F.col("far").alias("next"), F.least("low", "ahead").alias("low"), (F.col("ahead") < F.col("low")).alias("new"))
        state = shared.written(seen, "low")
        changed = not state.where("new").isEmpty()
    ring = shared.written(state.select("id", F.col("low").alias("ring")), "ring")
    last = F.col("next") == F.col("ring")
    state = follow.join(ring, "id").select("id", "ring", F.when(~last, F.col("next")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("left"))
    state = shared.written(state, "left")
    while not state.where("next is not null").isEmpty():
        state = shared.written(state.join(other(state, more="left"), "next", "left").select("id", "ring", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "left")
    size = grid.cell_size(resolution)
    points = edges.join(state.select("id", "ring", "left"), "id").select("ring", F.struct((-F.col("left")).alias("at"), F.col("i"), F.col("j"), "way").alias("p"))
    line = points.groupBy("ring").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # twice the area in cells: the shoelace over edges of length 1, each of which starts where the one before ends
    double = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.when(x["way"] == 0, -x["i"]).when(x["way"] == 1, x["j"]).when(x["way"] == 2, x["i"]).otherwise(-x["j"]))
    before = lambda k: F.element_at("p", F.when(k == 0, -1).otherwise(k).cast("int"))
    bends = F.filter("p", lambda x, k: x["way"] != before(k)["way"])
    place = F.transform(bends, lambda x: F.struct((x["i"] * size - 90).alias("lat"), (x["j"] * size - 180).alias("lon")))
    return line.select("ring", (double < 0).alias("is_hole"), (double / 2 * size * size).alias("area"), F.concat(place, F.slice(place, 1, 1)).alias("points"))
