import sqlite3

import pytest
from pyspark.sql import functions as F

from geomill.functions import geo, keys, text
from geomill.operators import cluster, filters, ingest, regions
from geomill.sources import occurrences, tables


def test_sqlite_files(spark, tmp_path):
    path = str(tmp_path / "cache.db")
    with sqlite3.connect(path) as base:
        base.execute("create table verdicts (sequence_id text primary key, valid integer, note text)")
        base.executemany("insert into verdicts values (?, ?, ?)", [(f"s{i}", i % 2, None if i % 3 else "x") for i in range(25_000)])
    base.close()
    df = tables.sqlite(spark, path, "select sequence_id, valid, note from verdicts", "sequence_id string, valid long, note string")
    assert df.agg(F.count("*"), F.sum("valid"), F.count("note")).first() == (25_000, 12_500, 8_334)
    asked = spark.createDataFrame([("s1",), ("s4",), ("none",)], "sequence_id string")
    assert sorted(r.sequence_id for r in df.join(asked, "sequence_id", "left_semi").collect()) == ["s1", "s4"]


def test_resume(spark, tmp_path):
    """What a stopped run has committed isn't done again; an uncommitted table counts as nothing."""
    todo = spark.createDataFrame([(f"k{i}", i) for i in range(10)], "photo_key string, n int")
    path, seen = str(tmp_path / "done"), []

    def process(rows):
        seen.append(sorted(r.n for r in rows.collect()))
        return rows.withColumn("out", F.col("n") * 2)

    assert ingest.resume(todo.where("n < 4"), path, process).count() == 4
    got = ingest.resume(todo, path, process)
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]] and sorted(r.out for r in got.collect()) == list(range(0, 20, 2))

    def fails(rows):
        return rows.withColumn("out", F.raise_error(F.lit("stopped")).cast("int"))

    more = todo.unionByName(spark.createDataFrame([("z", 99)], todo.schema))
    with pytest.raises(Exception, match="stopped"):
        ingest.resume(more, path, fails)
    assert ingest.resume(more, path, process).count() == 11 and seen[-1] == [99]
    ingest.finish(spark, path)
    assert not (tmp_path / "done").exists()


def test_writer_options(spark, tmp_path):
    df = spark.createDataFrame([("flickr_1", "flickr", "1", [1.0, 2.0])], "photo_key string, Platform string, Photo_ID string, embedding array<float>")
    tables.save(df, str(tmp_path / "t.parquet"), level=9, dictionary=False)
    assert tables.load(spark, str(tmp_path / "t.parquet")).columns == ["photo_key", "Platform", "Photo_ID"]
    assert spark.read.parquet(str(tmp_path / "t.parquet.embeddings")).count() == 1


def test_first_usable_address_of_an_archive(spark):
    occ = spark.createDataFrame([("1", "5", "6", "2020")], "gbifID string, decimalLatitude string, decimalLongitude string, eventDate string")
    media = spark.createDataFrame([(0, "1", "StillImage", "ftp://a/z.jpg"), (1, "1", "Sound", "http://a/0.jpg"), (2, "1", "StillImage", "http://a/z.jpg"), (3, "1", "StillImage", "http://a/a.jpg")], "at int, gbifID string, type string, identifier string")
    assert occurrences.from_archive(occ, media.repartition(3), "at").first().Image_URL == "http://a/z.jpg"


def test_one_whole_sidecar_row(spark):
    """Of several rows of a key one is taken, never the smallest of each column."""
    photos = spark.createDataFrame([("a", 1)], "photo_key string, n int")
    side = spark.createDataFrame([("a", 2, "first"), ("a", 1, "second")], "photo_key string, cluster_id int, cluster_label string")
    assert [tuple(r) for r in tables.with_clusters(photos, side).collect()] == [("a", 1, 1, "second")]


def test_first_embedding_of_a_key(spark):
    photos = spark.createDataFrame([("a",), ("b",)], "photo_key string")
    e = spark.createDataFrame([("a", [9.0], 0), ("a", [1.0], 1)], "photo_key string, embedding array<float>, at int")
    assert {r.photo_key: r.embedding for r in ingest.align_embeddings(photos, e, 1, order="at").collect()} == {"a": [9.0], "b": [0.0]}


def test_holes_and_the_antimeridian(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [("Ring", "X", [square(0.0, 30.0), square(10.0, 20.0)]), ("Far", "Y", [[[170.0, -10.0], [190.0, -10.0], [190.0, 10.0], [170.0, 10.0]]])]
    polygons = spark.createDataFrame(shapes, "name string, continent string, rings array<array<array<double>>>")
    rows = [("in", 5.0, 5.0), ("hole", 15.0, 15.0), ("edge of the hole", 10.5, 15.0), ("far", 0.0, 175.0), ("over", 0.0, -172.0), ("near", 0.0, -169.6), ("away", 0.0, -160.0)]
    p = spark.createDataFrame(rows, "id string, Latitude double, Longitude double")
    p = p.withColumn("cell", regions.grid.encode(F.col("Latitude"), F.col("Longitude")))
    want = {"in": "Ring", "hole": "Ocean / Unknown", "edge of the hole": "Ring", "far": "Far", "over": "Far", "near": "Far", "away": "Ocean / Unknown"}
    assert {r.id: r.country for r in regions.map_regions(p, polygons).collect()} == want
    riding = regions.SHAPE_BYTES
    try:
        regions.SHAPE_BYTES = 0
        assert {r.id: r.country for r in regions.map_regions(p, polygons).collect()} == want
    finally:
        regions.SHAPE_BYTES = riding


def test_equal_area_grid(spark):
    """The published example of this projection."""
    x, y = geo.laea_europe(F.lit(50.0), F.lit(5.0))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert got.x == pytest.approx(3_962_799.45, abs=0.01) and got.y == pytest.approx(2_999_718.85, abs=0.01)


def test_places(spark):
    df = spark.createDataFrame([("Kenya", "Africa", 1.0, 36.0), ("Atlantis", "Europe", 10.0, 20.0)], "country string, continent string, Latitude double, Longitude double")
    of = lambda name, **more: [r.country for r in df.where(filters.place(df, name, **more)).collect()]
    assert of("africa") == ["Kenya"] and of(" atlantis ") == ["Atlantis"]
    assert filters.place(df, "Nairobi") is None
    assert of("Nairobi", geocoded={"nairobi": (0.0, 2.0, 35.0, 37.0)}) == ["Kenya"]


def test_prefixes_and_flat_records(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(keys.has_prefix(F.lit("ABc"), ["x", " ab "])) and not one(keys.has_prefix(F.lit("ABc"), [" "])) and one(keys.has_prefix(F.lit("ABc"), []))
    assert one(text.flat_json(F.lit('{"a": {"b": [1, 2], "c": "x"}, "d": "y"}'))) == "a: b: 1, 2, c: x, d: y"
    assert one(text.flat_json(F.lit("plain"))) == "plain"


def test_layout_phrases_in_any_script(spark):
    raw = "The input image is a vertical stack of f\u00fcnf\u00a0photographs. \u00c9t\u00e9\u2003 ."
    assert spark.range(1).select(text.clean_description(F.lit(raw))).first()[0] == "\u00c9t\u00e9."


def test_drift_that_cannot_be_judged(spark):
    old = spark.createDataFrame([("a", [1.0, 0.0], 0)], "photo_key string, embedding array<double>, cluster_id long")
    assert cluster.decide(old.drop("cluster_id"), old) == "assign"
    assert cluster.decide(old.drop("cluster_id"), old.drop("cluster_id")) == "fit"
    assert cluster.decide(old.select("photo_key"), old) == "fit"
