"""Conjunctive filters of photo rows. A filter whose column is missing is left out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import times
from geomill.functions.keys import has_prefix

# South, north, west, east of each continent.
CONTINENT_BOXES = {
    "africa": (-35.0, 38.0, -26.0, 52.0),
    "europe": (35.0, 72.0, -25.0, 45.0),
    "asia": (1.0, 77.0, 26.0, 180.0),
    "north america": (7.0, 85.0, -168.0, -52.0),
    "south america": (-56.0, 13.0, -82.0, -34.0),
    "oceania": (-48.0, 0.0, 110.0, 180.0),
    "australia": (-48.0, -10.0, 110.0, 155.0),
    "antarctica": (-90.0, -60.0, -180.0, 180.0),
}
# What countries are also called.
COUNTRY_ALIASES = {
    "usa": "United States of America",
    "us": "United States of America",
    "united states": "United States of America",
    "america": "United States of America",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "uae": "United Arab Emirates",
    "emirates": "United Arab Emirates",
    "south korea": "South Korea",
    "korea": "South Korea",
    "czech republic": "Czechia",
    "russia": "Russia",
    "russian federation": "Russia",
    "the netherlands": "Netherlands",
    "holland": "Netherlands",
    "ivory coast": "Côte d'Ivoire",
    "cote d'ivoire": "Côte d'Ivoire",
}


def same(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.strip().lower()


def in_box(south: float, north: float, west: float, east: float) -> Column:
    return F.col("Latitude").between(south, north) & F.col("Longitude").between(west, east)


def parse_box(text: str) -> tuple[float, float, float, float] | None:
    """(south, north, west, east) of ``min_lat,max_lat,min_lon,max_lon``; None if it isn't four numbers."""
    try:
        numbers = [float(x) for x in text.split(",")]
    except ValueError:
        return None
    return tuple(numbers) if len(numbers) == 4 else None  # type: ignore[return-value]


def continent(columns: list[str], name: str) -> Column | None:
    if "continent" in columns:
        return same("continent", "oceania" if name.strip().lower() == "australia" else name)
    box = CONTINENT_BOXES.get(name.strip().lower())
    return in_box(*box) if box else None


def countries(columns: list[str], names: str, geocoded: dict[str, tuple[float, float, float, float]] | None = None) -> Column | None:
    """A comma list of countries by name or alias; without a country column by the boxes that the caller has."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if "country" in columns:
        return F.lower(F.col("country")).isin([COUNTRY_ALIASES.get(n.lower(), n).lower() for n in wanted])
    boxes = [in_box(*geocoded[n.lower()]) for n in wanted if geocoded and n.lower() in geocoded]
    return reduce(lambda a, b: a | b, boxes) if boxes else None


def place(df: DataFrame, name: str, geocoded: dict[str, tuple[float, float, float, float]] | None = None) -> Column | None:
    """A continent, else a country by alias or as the table has it, else the box that the caller has for the name. None: an unknown place."""
    own = name.strip().lower()
    if own in CONTINENT_BOXES:
        return continent(df.columns, name)
    if "country" in df.columns:
        known = COUNTRY_ALIASES.get(own, own).lower()
        if own in COUNTRY_ALIASES or not df.where(F.lower(F.col("country")) == known).isEmpty():
            return F.lower(F.col("country")) == known
    return in_box(*geocoded[own]) if geocoded and own in geocoded else None


def date_range(start: str | None, end: str | None, column: str = "Captured_At") -> Column | None:
    """From start to end, a date without time meaning the whole day. Unreadable times fall out."""
    ts = times.parse_timestamp(F.col(column))
    parts = []
    if start:
        parts.append(ts >= F.lit(start).cast("timestamp"))
    if end:
        stop = F.lit(end).cast("timestamp")
        parts.append(ts < stop + F.expr("INTERVAL 1 DAY") if len(end) == 10 else ts <= stop)
    return reduce(lambda a, b: a & b, parts) if parts else None


def parse_platforms(text: str | None) -> list[str]:
    """Names between commas or blanks; all and * mean no filter."""
    names = [n.lower() for n in re.split(r"[,\s]+", text or "") if n]
    return [] if {"all", "*"} & set(names) else names


def select(df: DataFrame, *, bbox: str | None = None, place_name: str | None = None, continent_name: str | None = None, country_names: str | None = None, start: str | None = None, end: str | None = None, season: str | None = None, time_of_day: str | None = None, koppen: str | None = None, platforms: str | None = None, cluster_id: int | None = None, geocoded: dict | None = None) -> DataFrame:
    """One predicate of all that is asked; Catalyst pushes what it can into the scan."""
    have = df.columns
    box = parse_box(bbox) if bbox else None
    wanted = parse_platforms(platforms)
    parts = [
        in_box(*box) if box else None,
        place(df, place_name, geocoded) if place_name else None,
        continent(have, continent_name) if continent_name else None,
        countries(have, country_names, geocoded) if country_names else None,
        date_range(start, end) if "Captured_At" in have else None,
        same("Season", season) if season and "Season" in have else None,
        same("Time_Of_Day", time_of_day) if time_of_day and "Time_Of_Day" in have else None,
        same("Koppen_Code", koppen) if koppen and "Koppen_Code" in have else None,
        F.lower(F.col("Platform")).isin(wanted) if wanted and "Platform" in have else None,
        F.col("cluster_id") == cluster_id if cluster_id is not None and "cluster_id" in have else None,
    ]
    kept = [p for p in parts if p is not None]
    return df.where(reduce(lambda a, b: a & b, kept)) if kept else df


def scope(platforms: list[str], continent_name: str | None, columns: list[str]) -> Column:
    """The rows that maintenance may touch."""
    out = F.lower(F.col("Platform")).isin(platforms) if platforms else F.lit(True)
    return out & same("continent", continent_name) if continent_name and "continent" in columns else out


def zero_shot_keep(similarities: Column, platform: Column, macro: int = -1, sky: int = -1) -> Column:
    """Whether a photo stays, by the class of its largest prompt similarity: indoor (class 0), close-up, sky."""
    best = F.array_position(similarities, F.array_max(similarities)) - 1
    p = F.lower(platform)
    gone = (p.isin("flickr", "wikimedia", "googlelandmarks") & (best == 0)) | ((p == "inaturalist") & best.isin([c for c in (macro, sky) if c >= 0]))
    return ~F.coalesce(gone, F.lit(False))


#: Fixed value: what a citable project's reference holds.
PERSISTENT = "https://raid.org/"


def shareable_project(p: DataFrame, prefixes: tuple[str, ...] = (), name: str = "project_name") -> DataFrame:
    """Projects that are openly shared, cited by a persistent identifier and no demonstration; of these, with prefixes, those whose name begins so."""
    cited = F.coalesce(F.col("citation").cast("string"), F.lit(""))
    return p.where((F.lower("sharing_preference") == "open") & cited.contains(PERSISTENT) & ~cited.contains("DEMO") & has_prefix(F.col(name), prefixes))


def camera_deployments(deployments: DataFrame, exclude_fuzzed: bool = True, only_functioning: bool = True) -> DataFrame:
    """Deployments with coordinates that are exact and whose camera worked, one row each."""
    have = deployments.columns
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    for c in ("fuzzed", "deployment_fuzzed"):
        if exclude_fuzzed and c in have:
            ok &= F.col(c) == F.lit(False)
    if only_functioning and "camera_functioning" in have:
        ok &= F.lower(F.trim("camera_functioning")) == "camera functioning"
    return deployments.where(ok).dropDuplicates(["deployment_id"])
