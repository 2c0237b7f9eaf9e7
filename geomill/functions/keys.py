"""Identity, licence, address and platform expressions of photo rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flickr's licence numbers.
FLICKR_LICENSES = {
    "0": "All Rights Reserved",
    "1": "CC BY-NC-SA 2.0",
    "2": "CC BY-NC 2.0",
    "3": "CC BY-NC-ND 2.0",
    "4": "CC BY 2.0",
    "5": "CC BY-SA 2.0",
    "6": "CC BY-ND 2.0",
    "7": "No known copyright restrictions",
    "8": "United States Government Work",
    "9": "CC0 1.0",
    "10": "Public Domain Mark 1.0",
    "11": "CC BY 4.0",
    "12": "CC BY-NC 4.0",
    "13": "CC BY-NC-ND 4.0",
    "14": "CC BY-NC-SA 4.0",
    "15": "CC BY-ND 4.0",
    "16": "CC BY-SA 4.0",
}

# Column names that other sources use, lower-cased, for each of ours.
ALIASES = {
    "Photo_ID": ("photo_id", "id", "photoid", "image_id", "orig_id"),
    "Platform": ("platform", "source"),
    "Latitude": ("latitude", "lat"),
    "Longitude": ("longitude", "lon", "lng", "long"),
    "Image_URL": ("image_url", "url", "image_location"),
    "Captured_At": ("captured_at", "date_observed", "observed_on_string", "datetime_local", "timestamp"),
    "License": ("license", "licence"),
    "H3_Cell": ("h3_cell", "h3", "cell"),
}


def clean_photo_id(c: Column) -> Column:
    """Trimmed, without one trailing ``.0``; null becomes empty."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0$", "")


def photo_id_of_number(c: Column) -> Column:
    """The id that a floating-point column holds: whole numbers without decimals; null and NaN become empty."""
    d = c.cast("double")
    whole = (d % 1 == 0) & (F.abs(d) < 1e38)
    text = F.when(whole, F.when(whole, d).cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    return F.when(d.isNull() | F.isnan(d), "").otherwise(text)


def photo_key(platform: Column, photo_id: Column) -> Column:
    return F.concat_ws("_", F.lower(F.trim(F.coalesce(platform, F.lit("")))), clean_photo_id(photo_id))


# What a missing value is called once it is text.
NULL_WORDS = ("nan", "None", "<NA>")


def without_null_words(c: Column) -> Column:
    """c, null where it is the name of a missing value."""
    return F.when(~c.isin(*NULL_WORDS), c)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def default_license(platform: Column, license_: Column) -> Column:
    """The licence, or where there is none that of the platform's uploads."""
    p = F.lower(platform)
    by_platform = (
        F.when(p.isin("mapillary", "kartaview"), "CC BY-SA 4.0")
        .when(p == "iwildcam", "CDLA-Permissive-1.0")
        .when((p == "wildlife_insights") | p.contains("snapshot"), "CC0")
        .when((p == "inat") | p.contains("inaturalist"), "CC BY-NC 4.0")
        .when(p == "wildobs", "CC-BY-4.0")
        .otherwise(license_)
    )
    return F.when(blank(license_), by_platform).otherwise(license_)


def decode_flickr_license(platform: Column, license_: Column) -> Column:
    """Flickr's numeric licences (``4`` or ``4.0``) by name; all else unchanged."""
    names = F.create_map(*[F.lit(x) for pair in FLICKR_LICENSES.items() for x in pair])
    number = F.substring_index(license_, ".", 1)
    return F.when((F.lower(platform) == "flickr") & ~blank(license_), F.coalesce(F.try_element_at(names, number), license_)).otherwise(license_)


def image_address(platform: Column, photo_id: Column, url: Column) -> Column:
    """Street-level platforms have addresses by id; others their URL."""
    p = F.lower(platform)
    return F.when(p.isin("mapillary", "kartaview"), F.concat(p, F.lit("://"), photo_id)).otherwise(url)


# Parts of the addresses that street-level platforms serve their pictures from.
STREET_HOSTS = {"mapillary": ("mapillary", "fbcdn.net"), "kartaview": ("kartaview", "openstreetcam")}


def sniffed_address(platform: Column, photo_id: Column, url: Column) -> Column:
    """As ``image_address``, where the platform may also be told by the address; without an id the address stays."""
    i = clean_photo_id(photo_id)
    out = url
    for name, hosts in reversed(STREET_HOSTS.items()):
        known = reduce(lambda a, h: a | url.contains(h), hosts, F.lower(platform) == name)
        out = F.when(F.coalesce(known, F.lit(False)) & (i != ""), F.concat(F.lit(f"{name}://"), i)).otherwise(out)
    return out


def local_address(location: Column, folder: Column) -> Column:
    """A picture's place beside the table that lists it; absolute paths and addresses with a scheme stay."""
    at = F.trim(location)
    own = F.regexp_like(at, F.lit("^(https?|mapillary|kartaview)://|^/"))
    joined = F.regexp_replace(F.concat(folder, F.lit("/"), at), r"(?<=/)(\./)+|(?<!:)(?<=/)/+", "")
    return F.when(blank(at) | own, at).otherwise(joined)


def has_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    """Whether a name begins with one of several, without case; blank ones don't count, and without any all do."""
    given = list(prefixes)
    own = [p.strip().lower() for p in given if p.strip()]
    if not given:
        return F.lit(True)
    return reduce(lambda a, p: a | F.lower(c).startswith(p), own, F.lit(False))


def natural_order(path: Column) -> list[Column]:
    """Sort keys by the first number in a file's name, names without one last."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("decimal(38,0)")
    return [number.isNull(), number, name]


def json_field(c: Column, path: str, default: str | None = None) -> Column:
    """A nested field of a JSON text; the default where it or what holds it is missing. ``$date`` wrappers are taken off."""
    own = F.get_json_object(c, path)
    dated = F.get_json_object(own, "$['$date']")
    found = F.coalesce(F.get_json_object(dated, "$['$numberLong']"), dated, own)
    return found if default is None else F.coalesce(found, F.lit(default))


def media_license(licenses: Column, default: str = "CC-BY-4.0") -> Column:
    """Of licences (name, scope) the first for media that has a name, else the first with a name."""
    named = F.filter(licenses, lambda x: ~blank(x["name"]))
    media = F.filter(named, lambda x: x["scope"] == "media")
    return F.coalesce(F.get(media, F.lit(0))["name"], F.get(named, F.lit(0))["name"], F.lit(default))


def platform_of_path(path: Column) -> Column:
    """The platform that a file's name tells, else the name itself without its extension."""
    p = F.lower(path)
    own = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return reduce(lambda acc, name: F.when(p.contains(name), name).otherwise(acc), ("iwildcam", "flickr", "inaturalist"), own)


def grouped_platform(platform: Column, camera_traps: Iterable[str]) -> Column:
    """Camera-trap platforms as one group, compared without case, hyphens, underscores and spaces."""
    bare = lambda s: "".join(ch for ch in s.lower() if ch not in "-_ ")
    name = F.trim(platform)
    own = F.translate(F.lower(name), "-_ ", "")
    return F.when(own.isin(sorted({bare(t) for t in camera_traps})), "Camera Traps").when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(name)


def relaxed_platform(platform: Column) -> Column:
    """inat and inaturalist are one platform when offline lists are compared."""
    p = F.lower(F.trim(platform))
    return F.when(p == "inat", "inaturalist").otherwise(p)


def relative_path(path: Column, prefixes: Iterable[tuple[str, str]]) -> Column:
    """Behind the first listed prefix that occurs, with its replacement before; else unchanged."""
    out = path
    for prefix, into in reversed(list(prefixes)):
        rest = F.substring(path, F.instr(path, prefix) + len(prefix), 1 << 30)
        out = F.when(path.contains(prefix), F.regexp_replace(F.concat(F.lit(into), rest), r"/{2,}|/\./", "/")).otherwise(out)
    return out
