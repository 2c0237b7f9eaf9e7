import math
import random

import pytest
from pyspark.sql import functions as F

from geomill.functions import grid, hexes


def test_known_cells(spark):
    """Published identifiers, the middle and the corners of one of them."""
    rows = [(37.3615593, -122.0553238, 5, "85283473fffffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (37.769377, -122.388903, 9, "89283082e73ffff")]
    for lat, lon, res, name in rows:
        got = spark.createDataFrame([(lat, lon)], "a double, b double").select(hexes.encode(F.col("a"), F.col("b"), res).alias("c")).first().c
        assert got == name
    c = spark.createDataFrame([("85283473fffffff",), ("85283473FFFFFFF",)], "c string")
    for r in c.select(hexes.centre("c").alias("m"), hexes.corners("c").alias("ring"), grid.h3_parent(F.lower("c"), 4).alias("up")).collect():
        assert (r.m.lat, r.m.lon) == pytest.approx((37.34579337536848, -121.97637597255124)) and r.up == "8428347ffffffff"
        assert [tuple(p) for p in r.ring][0] == pytest.approx((37.271355866731895, -121.91508032705622)) and len(r.ring) == 6


def test_whole_globe(spark, tmp_path):
    """Middles lie in their own cells, neighbours are mutual, and pentagons have five: also close to the twelve."""
    rng = random.Random(3)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(600)]
    for n in hexes._fans():
        lat, lon = map(float, hexes._pairs(hexes._zero_cells()[2][[n]])[0])
        points += [(lat + rng.gauss(0, s), lon + rng.gauss(0, s)) for s in (4, 0.5, 0.05) for _ in range(8)]
    points = [(min(90.0, max(-90.0, a)), b) for a, b in points]
    df = spark.createDataFrame(points, "lat double, lon double")
    for res in (0, 1, 4):
        path = str(tmp_path / str(res))
        df.select(hexes.encode(F.col("lat"), F.col("lon"), res).alias("c")).distinct().select("c", hexes.centre("c").alias("m"), hexes.corners("c").alias("ring")).write.parquet(path)
        cells = spark.read.parquet(path)
        rows = cells.select("c", "ring", hexes.encode(F.col("m.lat"), F.col("m.lon"), res).alias("own"), hexes.disk("c").alias("d")).collect()
        assert all(r.c == r.own and len(r.ring) == len(r.d) - 1 for r in rows)
        known = {r.c: set(r.d) for r in rows}
        assert all(c in known[n] for c, d in known.items() for n in d if n in known)
        five = {r.c for r in rows if len(r.ring) == 5}
        assert {int(c, 16) >> 45 & 127 for c in five} <= set(hexes._fans())
        assert res or (len(rows), len(five)) == (122, 12)


def test_no_cells(spark):
    rows = [(None, 1.0), (1.0, None), (90.5, 0.0), (float("nan"), 0.0), (0.0, float("inf")), (0.0, float("nan"))]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert [r.c for r in df.select(hexes.encode(F.col("lat"), F.col("lon"), 7).alias("c")).collect()] == [None] * 6
    poles = spark.createDataFrame([(90.0, 0.0), (90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (0.0, 540.0)], "lat double, lon double")
    a, b, c, d, e = (r.c for r in poles.select(hexes.encode(F.col("lat"), F.col("lon"), 5).alias("c")).collect())
    assert a == b and c == d == e
    bad = spark.createDataFrame([(None,), ("",), ("zz",), ("85283473ffffff",), ("85f83473fffffff",), ("8009fffffffffff",)], "c string")
    got = bad.select(hexes.centre("c").alias("m"), hexes.corners("c").alias("r"), hexes.disk("c").alias("d")).collect()
    assert all((r.m is None or r.m.lat is None) and r.r is None and r.d is None for r in got[:5]) and len(got[5].r) == 5
    empty = spark.createDataFrame([], "lat double, lon double").select(hexes.encode(F.col("lat"), F.col("lon"), 3).alias("c"))
    assert empty.select("c", hexes.centre("c")).count() == 0
    with pytest.raises(ValueError, match="resolutions"):
        hexes.encode(F.col("lat"), F.col("lon"), 16)
