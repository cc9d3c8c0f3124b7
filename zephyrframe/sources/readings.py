"""Scans of measurements, posts and weather.

Every scan takes the table as a DataFrame (Parquet, JDBC or a view), so filters
and column lists reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import clip0, number

MEASURES = ("raw_hourly_mean", "raw_hourly_median", "filtered_hourly_mean", "hourly_min", "hourly_max", "hourly_p95", "hourly_std")
HOURLY_KEY = ("monitoring_post_id", "substance_code", "bucket_start")
#: Weather measures in storage order, and the feed's names for them.
WEATHER = {
    "air_temp": "temperature_2m",
    "air_hum": "relative_humidity_2m",
    "atm_press": "surface_pressure",
    "hor_win_spd": "wind_speed_10m",
    "hor_win_dir": "wind_direction_10m",
    "precipitation": "precipitation",
    "cloud_cover": "cloud_cover",
    "cloud_cover_low": "cloud_cover_low",
    "wind_speed_100m": "wind_speed_100m",
    "wind_direction_100m": "wind_direction_100m",
    "wind_gusts_10m": "wind_gusts_10m",
    "boundary_layer_height": "boundary_layer_height",
    "shortwave_radiation": "shortwave_radiation",
}


def within(df: DataFrame, column: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with start <= column < end, either bound optional."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    return df if end is None else df.filter(F.col(column) < end)


def raw_samples(sensors: DataFrame, device_state: DataFrame, plc_state: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Samples of sensors by way of device and controller: monitoring_post_id, substance_code, timestamp, value.

    The two state tables are joined by their ids; whether they are broadcast is left to their size.
    """
    known = sensors.filter(F.col("value").isNotNull() & F.col("substance_code").isNotNull())
    known = within(known, "device_timestamp_ms", None if start_ms is None else F.lit(start_ms), None if end_ms is None else F.lit(end_ms))
    devices = device_state.select(F.col("id").alias("device_state_id"), "plc_state_id")
    controllers = plc_state.select(F.col("id").alias("plc_state_id"), "monitoring_post_id")
    joined = known.join(devices, "device_state_id").join(controllers, "plc_state_id")
    out = joined.select("monitoring_post_id", F.upper("substance_code").alias("substance_code"), F.timestamp_millis("device_timestamp_ms").alias("timestamp"), number(F.col("value")).alias("value"))
    return out.filter(F.col("value").isNotNull())


def aggregated_readings(readings: DataFrame, gases: Iterable[str], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Readings that come by the hour, without sign. Codes are compared before they are upper-cased."""
    known = readings.filter(F.col("value").isNotNull() & F.col("substance_code").isin(*gases))
    known = within(known, "bucket_ms", None if start_ms is None else F.lit(start_ms), None if end_ms is None else F.lit(end_ms))
    out = known.select("monitoring_post_id", F.upper("substance_code").alias("substance_code"), F.timestamp_millis("bucket_ms").alias("bucket_start"), F.abs(number(F.col("value"))).alias("value"))
    return out.filter(F.col("value").isNotNull())


def hourly_features(table: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Stored hourly features with measures at least 0."""
    return within(table, "bucket_start", start, end).select(*HOURLY_KEY, *[clip0(F.col(m)).alias(m) for m in MEASURES], "samples_count")


def active_posts(posts: DataFrame) -> DataFrame:
    """Posts in service: monitoring_post_id, latitude, longitude."""
    return posts.filter(F.col("active_to").isNull()).select(F.col("id").alias("monitoring_post_id"), "latitude", "longitude")


def located_posts(posts: DataFrame) -> DataFrame:
    """Posts in service whose place is known."""
    return active_posts(posts).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def weather(table: DataFrame, data_kind: str, start: Column | None = None, end: Column | None = None, measures: Sequence[str] = tuple(WEATHER)) -> DataFrame:
    """Hourly weather of one kind (a partition column of the stored table)."""
    kind = table.filter(F.col("data_kind") == data_kind)
    return within(kind, "bucket_start", start, end).select("monitoring_post_id", "bucket_start", *measures)
