"""Numeric, time, geodesy and wind expressions. NULL is the only missing marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
METERS_PER_DEGREE = 111_320.0
EARTH_RADIUS_KM = 6371.0088


def clip0(c: Column) -> Column:
    """At least 0; NULL stays NULL (greatest would make it 0)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Within bounds; NULL stays NULL."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def null_if_nan(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """A double where the value reads as one, else NULL; NaN is NULL too."""
    return null_if_nan(c.cast("string").try_cast("double"))


def local_hour(ts: Column, zone: str) -> Column:
    """The start of the local hour, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("hour", F.from_utc_timestamp(ts, zone)), zone)


def shift_hours(ts: Column, hours: int | Column) -> Column:
    """An instant so many hours later."""
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(hours) * F.lit(3_600_000_000))


def cyclic_features(ts: Column, zone: str) -> dict[str, Column]:
    """Sine and cosine of local hour of day and weekday (Monday 0)."""
    local = F.from_utc_timestamp(ts, zone)
    hour, weekday = F.hour(local), F.weekday(local)
    turn = lambda part, whole: 2 * F.pi() * part / whole
    return {
        "target_hour_sin": F.sin(turn(hour, 24.0)),
        "target_hour_cos": F.cos(turn(hour, 24.0)),
        "target_weekday_sin": F.sin(turn(weekday, 7.0)),
        "target_weekday_cos": F.cos(turn(weekday, 7.0)),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.when(a.isNotNull(), F.least(F.lit(1.0), F.sqrt(a))))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def alignment(wind_from: Column, bearing: Column) -> Column:
    """How far the wind comes from a bearing: the cosine of the angle between, at least 0."""
    return clip0(F.cos(F.radians(F.pmod(wind_from - bearing + 180.0, F.lit(360.0)) - 180.0)))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres east and north of a reference point."""
    return (lon - lon0) * METERS_PER_DEGREE * F.cos(lat0 * F.pi() / 180.0), (lat - lat0) * METERS_PER_DEGREE


def unproject(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and north; the inverse of `project`."""
    return lat0 + y / METERS_PER_DEGREE, lon0 + x / (METERS_PER_DEGREE * F.cos(lat0 * F.pi() / 180.0))


def wind_vector(speed: Column, wind_from: Column) -> tuple[Column, Column]:
    """Components of the wind, blowing to; 0 where speed or direction is missing."""
    known = speed.isNotNull() & wind_from.isNotNull()
    to = F.radians(F.pmod(wind_from + 180.0, F.lit(360.0)))
    size = F.greatest(speed, F.lit(0.0))
    return F.when(known, F.sin(to) * size).otherwise(0.0), F.when(known, F.cos(to) * size).otherwise(0.0)


def wind_from_vector(u: Column, v: Column) -> Column:
    """Direction the wind comes from; NULL when calm."""
    return F.when(F.hypot(u, v) > 0, F.pmod(F.degrees(F.atan2(u, v)) + 540.0, F.lit(360.0)))
