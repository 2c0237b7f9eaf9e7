import json

import pytest

from geomill.sources import shapefiles, tables

SCHEMA = "NAME string, CONTINENT string, rings array<array<array<double>>>"


def square(a, b):
    return [[a, a], [b, a], [b, b], [a, b], [a, a]]


def test_same_as_geojson(spark, tmp_path):
    """Rings, holes and attributes as the other reader has them, whatever the ranges of records."""
    shapes = [(f"n{i}", None if i % 3 else "Å x", [square(0.0, 30.0 + i), square(5.0, 9.0), square(10.0, 20.0)][: 1 + i % 3]) for i in range(25)]
    shapefiles.write(spark.createDataFrame(shapes, SCHEMA).repartition(3), str(tmp_path / "s"))
    features = [{"properties": {"NAME": n, "CONTINENT": c}, "geometry": {"type": "Polygon", "coordinates": r}} for n, c, r in shapes]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    def told(df):
        points = lambda rings: tuple(frozenset(map(tuple, r)) for r in rings)
        return sorted((r.name, r.continent or "", points(r.rings), points([r.ring])) for r in df.collect())

    want = told(tables.polygons(spark, str(tmp_path / "p.geojson")))
    assert told(shapefiles.polygons(spark, str(tmp_path / "s"))) == want
    few = shapefiles.load(spark, str(tmp_path / "s"), records=2)
    assert few.count() == 25 and few.rdd.getNumPartitions() >= 13
    one = next((tmp_path / "s").glob("*.shp"))
    assert set(told(shapefiles.polygons(spark, str(one)))) < set(want)


def test_several_polygons_of_a_shape(spark, tmp_path):
    """Islands with a lake each, one island in a lake: a row an island, lakes with the smallest island around them."""
    right = lambda ring: ring[::-1]
    rings = [right(square(0.0, 30.0)), right(square(100.0, 110.0)), square(102.0, 104.0), square(5.0, 25.0), right(square(10.0, 20.0)), square(12.0, 14.0)]
    import numpy as np

    found = shapefiles.parts_of([np.array(r) for r in rings])
    assert [[float(r[:, 0].min()) for r in part] for part in found] == [[0.0, 5.0], [100.0, 102.0], [10.0, 12.0]]
    lone = shapefiles.parts_of([np.array(square(0.0, 1.0))])
    assert len(lone) == 1 and len(lone[0]) == 1


def test_edges_of_shapefiles(spark, tmp_path):
    rows = [("a", None, None), ("", "b", [square(1.0, 2.0)]), ("a", None, None)]
    path = str(tmp_path / "s")
    shapefiles.write(spark.createDataFrame(rows, SCHEMA), path)
    got = sorted(((r.attributes["NAME"] or "", r.attributes["CONTINENT"], r.rings is None) for r in shapefiles.load(spark, path).collect()))
    assert got == [("", "b", False), ("a", None, True), ("a", None, True)]
    with pytest.raises(Exception, match="there already"):
        shapefiles.write(spark.createDataFrame(rows, SCHEMA), path)
    # what a lost task left behind isn't read
    for f in list((tmp_path / "s").glob("part-*")):
        f.with_name("part-lost" + f.suffix).write_bytes(f.read_bytes())
    assert shapefiles.load(spark, path).count() == 3
    shapefiles.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert shapefiles.load(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="254"):
        shapefiles.write(spark.createDataFrame([("x" * 255, None, None)], SCHEMA), str(tmp_path / "long"))
    with pytest.raises(Exception, match="10 bytes"):
        shapefiles.write(spark.createDataFrame([("x", None)], "a_long_attribute string, rings array<array<array<double>>>"), str(tmp_path / "name"))
    small = shapefiles.PART_BYTES
    try:
        shapefiles.PART_BYTES = 100
        assert len(shapefiles._Writer(str(tmp_path / "w"), shapefiles.StructType.fromDDL(SCHEMA)).write(iter([{"NAME": "x", "CONTINENT": None, "rings": [square(0.0, i)]} for i in (1.0, 2.0)])).names) == 2
    finally:
        shapefiles.PART_BYTES = small
