"""Expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from geomill.functions import geo, grid, keys, text, times, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1717156800", "2024-05-31T12:00:00Z"), ("1717156800000", "2024-05-31T12:00:00Z"), ("2024-06-01T13:30:00Z", "2024-06-01T13:30:00Z"), ("2024:12:01 22:30:00", "2024-12-01T22:30:00Z"), (" soon ", "soon"), ("20240501", "2024-05-01T00:00:00Z"), ("2024-06-01T13:30:00+02:00", "2024-06-01T11:30:00Z"), ("", "")],
)
def test_timestamps(spark, raw, want):
    assert one(spark, times.standard_timestamp(F.lit(raw))) == want


def test_missing_timestamp(spark):
    assert one(spark, times.standard_timestamp(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("when", "lat", "koppen", "season"),
    [
        ("2024-05-31T12:00:00Z", 45.0, None, "Spring"),
        ("2024-05-31T12:00:00Z", -45.0, None, "Autumn"),
        ("2024-06-01T13:30:00Z", 10.0, None, "Wet Season"),
        ("2024-12-01T22:30:00Z", 45.0, None, "Winter"),
        ("2024-12-01T22:30:00Z", -5.0, "Aw", "Wet Season"),
        ("2024-07-01T00:00:00Z", -5.0, "Am", "Dry Season"),
        ("2024-07-01T00:00:00Z", 38.0, "Csa", "Dry Season"),
        ("2024-10-01T00:00:00Z", 38.0, "Csb", "Autumn"),
        ("2024-07-01T00:00:00Z", 25.0, "BWh", "Dry Season"),
        ("never", 25.0, "BWh", "Unknown"),
        ("2024-07-01T00:00:00Z", None, None, "Unknown"),
    ],
)
def test_seasons(spark, when, lat, koppen, season):
    k = None if koppen is None else F.lit(koppen)
    assert one(spark, times.season(F.lit(when), F.lit(lat).cast("double"), k)) == season


@pytest.mark.parametrize(("hour", "want"), [("04", "Night"), ("05", "Dawn"), ("08", "Morning"), ("12", "Afternoon"), ("17", "Dusk"), ("20", "Night"), ("xx", "Unknown")])
def test_time_of_day(spark, hour, want):
    assert one(spark, times.time_of_day(F.lit(f"2024-01-01T{hour}:00:00Z"))) == want


def test_camera_times(spark):
    assert one(spark, times.camera_season(F.lit(12))) == "winter"
    assert one(spark, times.camera_season(F.lit(12), True)) == "summer"
    assert one(spark, times.camera_time_of_day(F.lit(7))) == "day"
    assert one(spark, times.camera_time_of_day(F.lit(17), True)) == "dusk"


def test_keys(spark):
    assert one(spark, keys.clean_photo_id(F.lit(" 12.0 "))) == "12"
    assert one(spark, keys.clean_photo_id(F.lit(None).cast("string"))) == ""
    assert one(spark, keys.photo_key(F.lit(" Flickr"), F.lit("7.0"))) == "flickr_7"
    assert one(spark, keys.image_address(F.lit("Mapillary"), F.lit("7"), F.lit("u"))) == "mapillary://7"


@pytest.mark.parametrize(("platform", "given", "want"), [("flickr", "4.0", "CC BY 2.0"), ("flickr", "99", "99"), ("mapillary", None, "CC BY-SA 4.0"), ("iWildCam", "", "CDLA-Permissive-1.0"), ("snapshot_usa", None, "CC0"), ("inaturalist", None, "CC BY-NC 4.0"), ("other", None, None), ("mapillary", "mine", "mine")])
def test_licenses(spark, platform, given, want):
    p, c = F.lit(platform), F.lit(given).cast("string")
    assert one(spark, keys.decode_flickr_license(p, keys.default_license(p, c))) == want


def test_h3_bits(spark):
    assert one(spark, grid.h3_parent(F.lit("85283473fffffff"), 4)) == "8428347ffffffff"
    assert one(spark, grid.h3_parent(F.lit("841f8f3ffffffff"), 3)) == "831f8ffffffffff"
    assert one(spark, grid.h3_resolution(F.lit("841f8f3ffffffff"))) == 4
    assert one(spark, grid.h3_parent(F.lit("841f8f3ffffffff"), 6)) is None


def test_grid(spark):
    c = grid.encode(F.lit(48.2), F.lit(16.4))
    for r in range(12):
        assert one(spark, grid.parent(c, r) == grid.encode(F.lit(48.2), F.lit(16.4), r))
    assert one(spark, grid.resolution(grid.parent(c, 5))) == 5
    assert len(one(spark, grid.disk(grid.encode(F.lit(0.0), F.lit(-179.9), 2)))) == 9
    assert len(one(spark, grid.disk(grid.encode(F.lit(90.0), F.lit(0.0), 2)))) == 6
    assert one(spark, grid.encode(F.lit(None).cast("double"), F.lit(0.0))) is None
    ring = one(spark, grid.unwrapped(F.array(*[F.struct(F.lit(1.0).alias("lat"), F.lit(x).alias("lon")) for x in (179.0, -179.0)])))
    assert [p["lon"] for p in ring] == [179.0, 181.0]


def test_distances(spark):
    m = one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert 111_000 < m < 112_000
    assert one(spark, geo.haversine_m(F.lit(5.0), F.lit(6.0), F.lit(5.0), F.lit(6.0))) == 0
    assert one(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(6.0), F.lit(5.0), F.lit(6.0))) is None
    assert one(spark, geo.wkt_point(F.lit("Point(9.5 45.25)"))).asDict() == {"lat": 45.25, "lon": 9.5}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("The input image is a vertical stack of four real-world photographs. a road.", "A road."),
        ("The input image contains a collage of things. Trees stand.", "Trees stand."),
        ("The input image is a vertical stack of four images, all depicting a hill.", "Representative views depict a hill."),
        ("Grass is seen across all frames .", "Grass is seen across the scene."),
        ("In the upper frame a cow.", "In specific views a cow."),
        ("Nothing to change.", "Nothing to change."),
        ("  ", "  "),
        (None, None),
    ],
)
def test_descriptions(spark, raw, want):
    assert one(spark, text.clean_description(F.lit(raw).cast("string"))) == want


def test_addresses(spark):
    assert one(spark, text.media_address(F.lit("ftp://a/b.jpg|https://inaturalist.org/x/original.JPG?1"))) == "https://inaturalist.org/x/medium.JPG?1"
    assert one(spark, text.media_address(F.lit("https://a/b.gif"))) is None
    assert one(spark, text.category_of_address(F.lit("https://w/wiki/Category:Old_Town%27s"))) == "Old Town's"
    assert one(spark, text.aerial_address(F.lit("https://a/view_of_b.jpg")))
    assert not one(spark, text.aerial_address(F.lit("https://a/b.JPG?x=1.gif")))


@pytest.mark.parametrize("inside", ["x" * 1_000_000, '\\\\n\\"' * 250_000, "'{}[],```" * 120_000, "\\\\u00e9 " * 150_000])
@pytest.mark.parametrize("form", ['{"a": "%s"}', 'so: {"a": "%s", }', "{'a': [1, 2,], \"b\": \"%s\",} there", '```json\n{"a": "%s"}\n```', '{"%s"}', '{"a": "%s"', '"%s"'])
def test_long_answers(spark, inside, form):
    """A million characters in every tier; where nothing can be read the answer is null, and the JVM lives."""
    raw = spark.createDataFrame([(form.replace("%s", inside),)], "a string")
    got = raw.select(F.length(F.to_json(text.answer_json(F.col("a")))).alias("n")).first()["n"]
    closed = form.rstrip("`\n there").endswith("}")
    assert got if closed else got is None or "{" in inside


def test_answers(spark):
    label, description = text.model_label(F.lit('LABEL: **"Forest"** DESCRIPTION: Trees across the frames.'))
    assert one(spark, label) == "Forest"
    assert one(spark, description) == "Trees across the scene."
    assert one(spark, text.model_label(F.lit(""))[0]) == "Error Labeling"
    assert one(spark, text.model_label(F.lit("what"))[0]) == "Unlabeled"
    for raw in ('x {"a": 1} y', '{"a": 1,}', "{'a': 1}"):
        assert one(spark, F.try_variant_get(text.answer_json(F.lit(raw)), "$.a", "int")) == 1
    assert one(spark, text.answer_json(F.lit("none")).isNull())


def test_images(spark):
    assert one(spark, text.valid_image(F.lit(b"\xff\xd8\xff\xe0")))
    assert one(spark, text.valid_image(F.lit(b"RIFFxxxxWEBP")))
    assert not one(spark, text.valid_image(F.lit(b"<html>")))


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(v(1.0, 0.0), v(0.0, 2.0))) == 0
    assert one(spark, vectors.normalised(v(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, vectors.normalised(v(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, vectors.first_half(v(1.0, 2.0, 3.0, 4.0))) == [1.0, 2.0]
    assert one(spark, vectors.second_half(v(1.0, 2.0, 3.0, 4.0))) == [3.0, 4.0]
    assert one(spark, vectors.half_precision(v(0.1, 65504.0).cast("array<float>"))) == pytest.approx([0.0999755859375, 65504.0])


def test_slug():
    assert text.slug("Café & Bar 2") == "caf_bar_2"


@pytest.mark.parametrize(("number", "want"), [(1e30, "1" + "0" * 30), (2.0**63, "9223372036854776000"), (-5.0, "-5"), (1.5, "1.5"), (1e300, "1.0E300"), (float("nan"), "")])
def test_ids_of_large_numbers(spark, number, want):
    assert one(spark, keys.photo_id_of_number(F.lit(number))) == want


@pytest.mark.parametrize(("raw", "want"), [("99999999999999", "5138-11-16T09:46:39Z"), ("999999999999999", "999999999999999"), ("0000-01-01", "0000-01-01"), ("9999-12-31", "9999-12-31T00:00:00Z")])
def test_years_out_of_range_stay_text(spark, raw, want):
    assert one(spark, times.standard_timestamp(F.lit(raw))) == want


@pytest.mark.parametrize(("word", "want"), [("nan", None), ("None", None), ("<NA>", None), ("", ""), ("NAN", "NAN"), (None, None)])
def test_words_for_nothing(spark, word, want):
    assert one(spark, keys.without_null_words(F.lit(word).cast("string"))) == want
