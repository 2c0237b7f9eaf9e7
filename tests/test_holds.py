"""Queries that check results, where there is nothing to check or much of it."""

import math

import __spark_entry__ as entry
from geomill.functions import geo
from geomill.operators import regions
from geomill.plans import q_geo


def test_poles_lie_off_the_projected_raster(spark):
    points = spark.createDataFrame([(1, -90.0, 0.0), (2, 90.0, 0.0), (3, 52.0, 10.0), (4, -90.0, 123.45), (5, -52.0, -170.0)], "id int, Latitude double, Longitude double")
    x, y = geo.laea_europe(points["Latitude"], points["Longitude"])
    assert all(not math.isnan(v) for r in points.where("id < 5").select(x, y).collect() for v in r)
    raster = spark.range(3600).selectExpr("cast(id div 60 as int) row", "cast(id % 60 as int) col", "cast(id as double) value")
    found = regions.projected_lookup(points, raster, 1_000_000.0, 6_000_000.0, 100_000.0)
    assert {r.id: r.value for r in found.collect()} == {1: None, 2: None, 3: 27 * 60 + 33.0, 4: None, 5: None}


def test_nothing_uncovered_has_no_area(spark, sf, monkeypatch):
    monkeypatch.setattr(q_geo, "_uncovered", lambda s, d: s.range(0).selectExpr("id c"))
    assert q_geo.uncovered_holds(spark, sf).first().asDict() == {"area": 0.0, "outer_less_holes": 0, "corners": 0}


def test_landmarks_without_a_sparse_cell(spark, tmp_path):
    # all in one place
    spark.range(17).selectExpr(f"1 + id * {18_001 * 36_001} event_id", "1 user_id", "timestamp'2024-05-01 00:00:00' ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2).selectExpr("id vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["landmarks_hold"](spark, str(tmp_path)).first().asDict() == {"photos": 0, "wrong": 0}
