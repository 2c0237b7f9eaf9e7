"""Row-wise expressions and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import geo, grid, keys, text, times
from geomill.operators import filters, ingest
from geomill.plans.views import PHOTOS_SQL, photos, table

CAMERA_TRAPS = ("Wildlife Insights", "kartaview")


def row_identity(spark: SparkSession, d: str) -> DataFrame:
    """Ids with and without a trailing .0, in mixed case, as keys."""
    raw = F.concat(F.lit(" "), F.col("Photo_ID"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""))
    return photos(spark, d).select("event_id", keys.clean_photo_id(raw).alias("clean_id"), keys.photo_key(F.upper("Platform"), raw).alias("photo_key"))


ROW_IDENTITY = PHOTOS_SQL + """
    SELECT event_id, Photo_ID AS clean_id, Platform || '_' || Photo_ID AS photo_key FROM photos"""


def row_licenses(spark: SparkSession, d: str) -> DataFrame:
    lic = keys.decode_flickr_license(F.col("Platform"), keys.default_license(F.col("Platform"), F.col("License")))
    return photos(spark, d).select("event_id", lic.alias("License"), keys.image_address(F.col("Platform"), F.col("Photo_ID"), F.col("Image_URL")).alias("Image_URL"), keys.grouped_platform(F.col("Platform"), CAMERA_TRAPS).alias("platform_group"))


_FLICKR = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.FLICKR_LICENSES.items())
ROW_LICENSES = PHOTOS_SQL + f"""
    SELECT event_id,
           CASE WHEN License IS NULL THEN CASE Platform WHEN 'mapillary' THEN 'CC BY-SA 4.0' WHEN 'kartaview' THEN 'CC BY-SA 4.0' WHEN 'inaturalist' THEN 'CC BY-NC 4.0' END
                WHEN Platform = 'flickr' THEN CASE License {_FLICKR} ELSE License END ELSE License END AS License,
           CASE WHEN Platform IN ('mapillary', 'kartaview') THEN Platform || '://' || Photo_ID ELSE Image_URL END AS Image_URL,
           CASE WHEN Platform = 'kartaview' THEN 'Camera Traps' ELSE Platform END AS platform_group
    FROM photos"""


def row_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Epoch seconds and milliseconds, ISO, EXIF, unreadable and missing times."""
    e, ts = F.col("event_id"), F.col("ts")
    raw = (
        F.when(e % 6 == 0, F.unix_seconds("ts").cast("string"))
        .when(e % 6 == 1, (F.unix_seconds("ts") * 1000).cast("string"))
        .when(e % 6 == 2, F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
        .when(e % 6 == 3, F.concat(F.lit(" not a date "), e.cast("string")))
        .when(e % 6 == 4, F.date_format(ts, "yyyy-MM-dd"))
    )
    return photos(spark, d).select("event_id", times.standard_timestamp(raw).alias("captured"))


ROW_TIMESTAMPS = PHOTOS_SQL + """
    SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN event_id % 6 = 3 THEN 'not a date ' || event_id
                          WHEN event_id % 6 = 4 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') END AS captured FROM photos"""


def row_seasons(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("Captured_At")
    month, hour = F.substring(t, 6, 2).try_cast("int"), F.substring(t, 12, 2).try_cast("int")
    return photos(spark, d).select(
        "event_id",
        times.season(t, F.col("Latitude"), F.col("Koppen_Code")).alias("season"),
        times.season(t, F.col("Latitude")).alias("plain_season"),
        times.time_of_day(t).alias("tod"),
        times.camera_season(month).alias("camera_season"),
        times.camera_time_of_day(hour).alias("camera_tod"),
        times.camera_time_of_day(hour, True).alias("camera_period"),
    )


_PLAIN = """CASE WHEN m IS NULL OR Latitude IS NULL THEN 'Unknown'
    WHEN abs(Latitude) <= 23.5 THEN CASE WHEN m BETWEEN 6 AND 9 THEN 'Wet Season' ELSE 'Dry Season' END
    WHEN Latitude > 23.5 THEN list_extract(['Winter', 'Spring', 'Summer', 'Autumn'], (m % 12) // 3 + 1)
    ELSE list_extract(['Summer', 'Autumn', 'Winter', 'Spring'], (m % 12) // 3 + 1) END"""
ROW_SEASONS = PHOTOS_SQL + f""", p AS (SELECT *, CAST(Captured_At[6:7] AS INTEGER) AS m, CAST(Captured_At[12:13] AS INTEGER) AS h FROM photos)
    SELECT event_id, CASE WHEN m IS NULL OR Latitude IS NULL THEN 'Unknown'
        WHEN Koppen_Code = 'BWh' THEN 'Dry Season'
        WHEN Koppen_Code = 'Aw' THEN CASE WHEN (Latitude >= 0 AND m BETWEEN 6 AND 9) OR (Latitude < 0 AND (m >= 11 OR m <= 4)) THEN 'Wet Season' ELSE 'Dry Season' END
        WHEN Koppen_Code = 'Csa' AND ((Latitude >= 0 AND m IN (12, 1, 2)) OR (Latitude < 0 AND m IN (6, 7, 8))) THEN 'Wet Season'
        WHEN Koppen_Code = 'Csa' AND ((Latitude >= 0 AND m IN (6, 7, 8)) OR (Latitude < 0 AND m IN (12, 1, 2))) THEN 'Dry Season'
        ELSE {_PLAIN} END AS season,
      {_PLAIN} AS plain_season,
      CASE WHEN h IS NULL THEN 'Unknown' WHEN h BETWEEN 5 AND 7 THEN 'Dawn' WHEN h BETWEEN 8 AND 11 THEN 'Morning' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 19 THEN 'Dusk' ELSE 'Night' END AS tod,
      list_extract(['winter', 'spring', 'summer', 'fall'], (m % 12) // 3 + 1) AS camera_season,
      CASE WHEN h >= 7 AND h < 19 THEN 'day' ELSE 'night' END AS camera_tod,
      CASE WHEN h IN (5, 6) THEN 'dawn' WHEN h BETWEEN 7 AND 16 THEN 'day' WHEN h IN (17, 18) THEN 'dusk' ELSE 'night' END AS camera_period
    FROM p"""


def row_h3_bits(spark: SparkSession, d: str) -> DataFrame:
    """Resolution and ancestors of H3 identifiers made of event ids: valid base cells, digits by arithmetic."""
    v = F.lit((8 << 59) + (9 << 52) + ((1 << 18) - 1)) + (F.col("event_id") % 122) * (1 << 45) + F.pmod(F.col("event_id") * 7919, F.lit(1 << 27)) * (1 << 18)
    h = F.lower(F.hex(v.cast("long") - (1 << 62)))
    return photos(spark, d).select("event_id", grid.h3_resolution(h).alias("res"), grid.h3_parent(h, 4).alias("parent4"), grid.h3_parent(h, 1).alias("parent1"))


_V = f"(({(8 << 59) + (9 << 52) + ((1 << 18) - 1)} - {1 << 62})::BIGINT + (event_id % 122) * {1 << 45} + ((event_id * 7919) % {1 << 27}) * {1 << 18})"
_H3_PARENT = lambda r: f"lower(to_hex(({_V} & {~(15 << 52)}) | {r << 52} | {(1 << (3 * (15 - r))) - 1}))"
ROW_H3_BITS = f"SELECT event_id, CAST(({_V} >> 52) & 15 AS INTEGER) AS res, {_H3_PARENT(4)} AS parent4, {_H3_PARENT(1)} AS parent1 FROM events"


def row_distances(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("Latitude"), F.col("Longitude")
    m = geo.haversine_m(lat, lon, F.lit(48.0), F.lit(2.0))
    return photos(spark, d).select("event_id", F.round(m, 2).alias("metres"), geo.haversine_km(lat, lon, F.lit(-33.0), F.lit(151.0), 1).alias("km"), geo.null_island(lat, lon).alias("null_island"), geo.diagonal(lat, lon).alias("diagonal"))


def _haversine(lat: float, lon: float) -> str:
    a = f"(pow(sin(radians({lat} - Latitude) / 2), 2) + cos(radians(Latitude)) * cos(radians({lat}e0)) * pow(sin(radians({lon} - Longitude) / 2), 2))"
    return f"12742000.0e0 * atan2(sqrt({a}), sqrt(1 - {a}))"


ROW_DISTANCES = PHOTOS_SQL + f"""
    SELECT event_id, round({_haversine(48.0, 2.0)}, 2) AS metres, round({_haversine(-33.0, 151.0)} / 1000, 1) AS km,
           abs(Latitude) < 0.05 AND abs(Longitude) < 0.05 AS null_island, abs(Latitude - Longitude) < 1e-5 AND abs(Latitude) > 1 AS diagonal FROM photos"""


def _lead() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, "The input image is a vertical stack of four real-world photographs. ").when(F.col("doc_id") % 3 == 1, "the composite image shows, in each frame , ").otherwise("Seen across all frames, ")


def row_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Clean-up of layout phrases put before, and standing in, document texts, which are cleaned from end to end."""
    return table(spark, d, "documents").select("doc_id", text.clean_description(F.concat(_lead(), "text")).alias("cleaned"))


def _cleaned_sql(value: str) -> str:
    for pattern, into in text.LAYOUT_PHRASES:
        value = f"regexp_replace({value}, '{_unicode(pattern)}', '{into}', 'gi')"
    value = f"regexp_replace(regexp_replace({value}, '{_SPACE}{{2,}}', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"regexp_replace(regexp_replace({value}, '{_SPACE}+([.,;:!?])', '\\1', 'g'), '^(?:[.,;:]|{_SPACE})+', '')"


_SPACE = r"[\s\x0b\x85\p{Z}]"


def _unicode(pattern: str) -> str:
    """The pattern with white space and word characters of all scripts."""
    return pattern.replace(r"\s", _SPACE).replace(r"\w", r"[\p{L}\p{M}\p{N}\p{Pc}]")


ROW_DESCRIPTIONS = rf"""
    WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'The input image is a vertical stack of four real-world photographs. ' WHEN 1 THEN 'the composite image shows, in each frame , ' ELSE 'Seen across all frames, ' END || text AS s FROM documents),
         u AS (SELECT doc_id, {_cleaned_sql("s")} AS s FROM t)
    SELECT doc_id, upper(s[1]) || s[2:] AS cleaned FROM u"""


def row_addresses(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    listed = F.concat_ws("|", F.lit("ftp://x/a.jpg"), F.concat(u, F.lit("/original.jpg")), F.concat(u, F.lit(".png")))
    return table(spark, d, "pages").select("page_id", text.aerial_address(u).alias("aerial"), text.media_address(listed).alias("media"))


ROW_ADDRESSES = r"""
    SELECT page_id, lower(url) LIKE '%view\_of\_%' ESCAPE '\' OR NOT regexp_matches(lower(split_part(url, '?', 1)), '\.(jpg|jpeg|png|webp)$') AS aerial,
           url || '/original.jpg' AS media FROM pages"""


def row_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Rows under other names, normalised."""
    raw = photos(spark, d).select(F.concat(F.col("Photo_ID"), F.lit(".0")).alias("id"), F.upper("Platform").alias("source"), F.col("Latitude").cast("string").alias("lat"), F.when(F.col("event_id") % 7 == 0, "east").otherwise(F.col("Longitude").cast("string")).alias("lng"), F.col("Image_URL").alias("url"), F.col("Captured_At").alias("datetime_local"), "License")
    return ingest.normalize(raw)


ROW_NORMALIZED = PHOTOS_SQL + f""", l AS ({ROW_LICENSES.replace(PHOTOS_SQL, "")})
    SELECT Photo_ID, Platform, Latitude, CASE WHEN p.event_id % 7 <> 0 THEN Longitude END AS Longitude, l.Image_URL, Captured_At, l.License, Platform || '_' || Photo_ID AS photo_key
    FROM photos p JOIN l USING (event_id)"""


def filter_slice(spark: SparkSession, d: str) -> DataFrame:
    """A conjunction of place, time, climate and platform."""
    return filters.select(photos(spark, d), bbox="-60,60,-150,150", country_names="Kenya, France,brazil", start="2024-01-02", end="2024-12-20", koppen="cfb", platforms="flickr mapillary,kartaview").select("event_id", "Platform", "country")


FILTER_SLICE = PHOTOS_SQL + """
    SELECT event_id, Platform, country FROM photos WHERE Latitude BETWEEN -60 AND 60 AND Longitude BETWEEN -150 AND 150 AND country IN ('Kenya', 'France', 'Brazil')
       AND Captured_At >= '2024-01-02' AND Captured_At < '2024-12-21' AND Koppen_Code = 'Cfb' AND Platform IN ('flickr', 'mapillary', 'kartaview')"""


def filter_continent_box(spark: SparkSession, d: str) -> DataFrame:
    return filters.select(photos(spark, d).drop("continent", "country"), continent_name="Europe").select("event_id", "Latitude", "Longitude")


FILTER_CONTINENT_BOX = PHOTOS_SQL + " SELECT event_id, Latitude, Longitude FROM photos WHERE Latitude BETWEEN 35 AND 72 AND Longitude BETWEEN -25 AND 45"


def filter_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    """Photos that stay by the class of their largest similarity: the first four components stand for prompts."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("sims"))
    rows = photos(spark, d).join(e, "vec_id")
    return rows.where(filters.zero_shot_keep(F.col("sims"), F.col("Platform"), 2, 3)).select("event_id", "Platform")


FILTER_ZERO_SHOT = PHOTOS_SQL + """, b AS (SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS best FROM embeddings)
    SELECT event_id, Platform FROM photos JOIN b USING (vec_id) WHERE NOT ((Platform = 'flickr' AND best = 0) OR (Platform = 'inaturalist' AND best IN (2, 3)))"""


QUERIES = {
    "row_identity": (row_identity, ROW_IDENTITY),
    "row_licenses": (row_licenses, ROW_LICENSES),
    "row_timestamps": (row_timestamps, ROW_TIMESTAMPS),
    "row_seasons": (row_seasons, ROW_SEASONS),
    "row_h3_bits": (row_h3_bits, ROW_H3_BITS),
    "row_distances": (row_distances, ROW_DISTANCES),
    "row_descriptions": (row_descriptions, ROW_DESCRIPTIONS),
    "row_addresses": (row_addresses, ROW_ADDRESSES),
    "row_normalized": (row_normalized, ROW_NORMALIZED),
    "filter_slice": (filter_slice, FILTER_SLICE),
    "filter_continent_box": (filter_continent_box, FILTER_CONTINENT_BOX),
    "filter_zero_shot": (filter_zero_shot, FILTER_ZERO_SHOT),
}
