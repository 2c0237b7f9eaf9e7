"""Cells to polygons, against rings drawn by hand and by walking."""

import random

import pytest
from pyspark.sql import functions as F

from geomill.functions import grid
from geomill.operators import dissolve


def frame(spark, cells):
    rows = spark.createDataFrame([(i, j) for i, j in cells], "i long, j long")
    return rows.select(grid.cell(F.col("i"), F.col("j"), 2).alias("c"))


def walked(cells):
    """(area in cells, corners) of each ring, edge by edge."""
    steps, corners = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((0, 0), (0, 1), (1, 1), (1, 0))
    edges = {}
    for i, j in cells:
        for w, (di, dj) in enumerate(corners):
            beside = ((i - 1, j), (i, j + 1), (i + 1, j), (i, j - 1))[w]
            if beside not in cells:
                edges.setdefault((i + di, j + dj), set()).add(w)
    out = []
    while any(edges.values()):
        at = next(v for v, ways in edges.items() if ways)
        way = min(edges[at])
        ring, start = [], (at, way)
        while True:
            edges[at].discard(way)
            ring.append((at, way))
            at = at[0] + steps[way][0], at[1] + steps[way][1]
            follow = [(way + t) % 4 for t in (1, 0, 3) if (way + t) % 4 in edges.get(at, ()) or (at, (way + t) % 4) == start]
            if (at, follow[0]) == start:
                break
            way = follow[0]
        points = [p for p, _ in ring]
        area = sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2
        out.append((area, sum(ring[k][1] != ring[k - 1][1] for k in range(len(ring)))))
    return sorted(out)


def found(spark, cells):
    size = grid.cell_size(2) ** 2
    return sorted((round(r.area / size, 6), len(r.points) - 1) for r in dissolve.rings(frame(spark, cells), "c", 2).collect())


def test_a_square_with_a_hole(spark):
    cells = [(i, j) for i in range(3, 6) for j in range(3, 6) if (i, j) != (4, 4)]
    got = {r.is_hole: r for r in dissolve.rings(frame(spark, [*cells, cells[0]]), "c", 2).collect()}
    assert got[False].area == 9 * 25 and got[True].area == -25
    assert [(p.lat, p.lon) for p in got[False].points] == [(-75, -165), (-75, -150), (-60, -150), (-60, -165), (-75, -165)]
    assert {(p.lat, p.lon) for p in got[True].points} == {(-70, -160), (-70, -155), (-65, -160), (-65, -155)}


@pytest.mark.parametrize("cells", [set(), {(0, 0)}, {(1, 1), (2, 2)}, {(1, 2), (2, 1)}, {(0, 0), (0, 71), (35, 0), (35, 71)}, {(i, j) for i in range(36) for j in range(72)}])
def test_small_sets(spark, cells):
    assert found(spark, cells) == walked(set(cells))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sets(spark, seed):
    r = random.Random(seed)
    cells = {(i, j) for i in range(20) for j in range(30) if r.random() < 0.4 + 0.2 * seed}
    assert found(spark, cells) == walked(cells)
