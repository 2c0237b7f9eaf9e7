"""Distances, boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, MERCATOR_M = 6_371_000.0, 6_378_137.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = F.when(a < 0, 0.0).when(a > 1, 1.0).otherwise(a)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, places: int | None = None) -> Column:
    km = haversine_m(lat1, lon1, lat2, lon2) / 1000
    return km if places is None else F.round(km, places)


def mercator_m(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator x and y in metres."""
    return F.lit(MERCATOR_M) * F.radians(lon), F.lit(MERCATOR_M) * F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483))


def laea_europe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in metres on the European equal-area grid (Lambert azimuthal, GRS80, centred at 52 N 10 E); null at the point opposite to the centre."""
    import math

    a, flat = 6_378_137.0, 1 / 298.257222101
    e2 = flat * (2 - flat)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s0, q_pole = math.sin(math.radians(52.0)), q_of(1.0)
    radius, beta0 = a * math.sqrt(q_pole / 2), math.asin(q_of(s0) / q_pole)
    d = a * math.cos(math.radians(52.0)) / math.sqrt(1 - e2 * s0 * s0) / (radius * math.cos(beta0))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    # at the poles q can be beyond its limit by a last digit, which has no arcsine
    beta, east = F.asin(F.greatest(F.least(q / q_pole, F.lit(1.0)), F.lit(-1.0))), F.radians(lon - 10.0)
    b = radius * F.sqrt(F.try_divide(F.lit(2.0), 1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(east)))
    x = 4_321_000.0 + b * d * F.cos(beta) * F.sin(east)
    y = 3_210_000.0 + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(east))
    return x, y


def map_resolution(span: Column) -> Column:
    """The cell resolution for a map that shows so many degrees."""
    return F.when(span > 100, 4).when(span > 30, 5).when(span > 5, 6).when(span > 1, 7).otherwise(8)


def wkt_point(text: Column) -> Column:
    """(lat, lon) of ``Point(lon lat)``, else null."""
    pattern = r"(?i)Point\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    lon, lat = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def circular_mean_longitude(lon: Column) -> Column:
    """Aggregate: the direction of the mean unit vector."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(lon))), F.avg(F.cos(F.radians(lon)))))


def null_island(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) < 0.05) & (F.abs(lon) < 0.05)


def diagonal(lat: Column, lon: Column) -> Column:
    return (F.abs(lat - lon) < 1e-5) & (F.abs(lat) > 1)
