"""Timestamps, seasons and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order on strings that a plain cast doesn't read.
FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "yyyyMMddHHmmss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "MMM d, yyyy", "d MMM yyyy")
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds or milliseconds, ISO, EXIF and some other forms as a timestamp; null if unreadable or out of the years 1 to 9999. Session time zone: UTC."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    whole = F.when((number > -1e17) & (number < 1e17), number).cast("long")
    epoch = F.when(number > 5e10, F.timestamp_millis(whole)).when(number > 1e8, F.timestamp_seconds(number))
    exif = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    dated = F.when(exif.rlike(r"^\d{4}-\d{1,2}"), exif.try_cast("timestamp"))
    found = F.coalesce(epoch, F.when(number.isNull() | (number <= 1e8), F.coalesce(dated, *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])))
    return F.when(F.year(found).between(1, 9999), found)


def standard_timestamp(raw: Column) -> Column:
    """ISO 8601 in UTC to the second; what can't be read stays, trimmed; null stays null."""
    return F.coalesce(F.date_format(parse_timestamp(raw), ISO), F.trim(raw.cast("string")))


def _wet(wet: Column) -> Column:
    return F.when(wet, "Wet Season").otherwise("Dry Season")


def _four(month: Column, southern: bool) -> Column:
    names = ["Summer", "Autumn", "Winter", "Spring"] if southern else ["Winter", "Spring", "Summer", "Autumn"]
    return F.element_at(F.array(*map(F.lit, names)), F.floor(F.pmod(month, F.lit(12)) / 3).cast("int") + 1)


def season(captured: Column, latitude: Column, koppen: Column | None = None) -> Column:
    """From the month of an ISO timestamp, the latitude and, if known, the climate code."""
    month = F.substring(captured, 6, 2).try_cast("int")
    lat = latitude.cast("double")
    north = lat >= 0
    by_latitude = F.when(F.abs(lat) <= 23.5, _wet(month.between(6, 9))).when(lat > 23.5, _four(month, False)).otherwise(_four(month, True))
    if koppen is None:
        out = by_latitude
    else:
        rainy = F.when(north, month.between(6, 9)).otherwise(~month.between(5, 10))
        december = month.isin(12, 1, 2)
        june = month.between(6, 8)
        out = (
            F.when(koppen.isin("BWh", "BWk"), "Dry Season")
            .when(koppen.isin("Aw", "Am"), _wet(rainy))
            .when(koppen.isin("Csa", "Csb") & F.when(north, december).otherwise(june), "Wet Season")
            .when(koppen.isin("Csa", "Csb") & F.when(north, june).otherwise(december), "Dry Season")
            .otherwise(by_latitude)
        )
    return F.when(month.between(1, 12) & lat.isNotNull() & ~F.isnan(lat), out).otherwise("Unknown")


def time_of_day(captured: Column) -> Column:
    hour = F.substring(captured, 12, 2).try_cast("int")
    return F.when(hour.isNull(), "Unknown").when(hour.between(5, 7), "Dawn").when(hour.between(8, 11), "Morning").when(hour.between(12, 16), "Afternoon").when(hour.between(17, 19), "Dusk").otherwise("Night")


def camera_season(month: Column, southern: bool = False) -> Column:
    """winter, spring, summer, fall of camera deployments."""
    names = ["summer", "fall", "winter", "spring"] if southern else ["winter", "spring", "summer", "fall"]
    return F.when(month.isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.floor(F.pmod(month, F.lit(12)) / 3).cast("int") + 1))


def camera_time_of_day(hour: Column, four_periods: bool = False, day_start: int = 7, day_end: int = 19) -> Column:
    if four_periods:
        return F.when(hour.between(5, 6), "dawn").when(hour.between(7, 16), "day").when(hour.between(17, 18), "dusk").otherwise("night")
    return F.when((hour >= day_start) & (hour < day_end), "day").otherwise("night")
