"""Station values that fields are built from, for all gases and hours in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import clip0, shift_hours
from zephyrframe.operators.weather import ANCHOR_WEATHER, anchor_columns, prefer_live

ANCHOR = ("substance_code", "hour_start", "monitoring_post_id", "latitude", "longitude", "source", "value", "samples_count", "lower_bound", "upper_bound", *ANCHOR_WEATHER)


def _located(posts: DataFrame) -> DataFrame:
    return posts.filter("latitude is not null and longitude is not null").select(F.col("id").alias("monitoring_post_id"), "latitude", "longitude", "source")


def _measured(hourly: DataFrame, posts: DataFrame) -> DataFrame:
    known = hourly.filter("filtered_hourly_mean is not null").select("substance_code", F.col("bucket_start").alias("source_hour"), "monitoring_post_id", clip0(F.col("filtered_hourly_mean")).alias("value"), "samples_count")
    none = F.lit(None).cast("double")
    return known.join(_located(posts), "monitoring_post_id").withColumns({"lower_bound": none, "upper_bound": none})


def analysis_anchors(hourly: DataFrame, posts: DataFrame, live: DataFrame) -> DataFrame:
    """Measurements on located posts with the weather of their own hour. Posts out of service count too."""
    rows = _measured(hourly, posts).withColumn("hour_start", F.col("source_hour"))
    return rows.join(anchor_columns(live, "hour_start"), ["monitoring_post_id", "hour_start"], "left").select(*ANCHOR)


def nowcast_anchors(hourly: DataFrame, posts: DataFrame, live: DataFrame) -> DataFrame:
    """Measurements of an hour with the weather of the next, which is their hour_start."""
    rows = _measured(hourly, posts).withColumn("hour_start", shift_hours(F.col("source_hour"), 1))
    return rows.join(anchor_columns(live, "hour_start"), ["monitoring_post_id", "hour_start"], "left").select(*ANCHOR)


def carried_anchors(hourly: DataFrame, posts: DataFrame, live: DataFrame) -> DataFrame:
    """Nowcast anchors that keep the weather of their own hour where a station has none for the next."""
    rows = analysis_anchors(hourly, posts, live).withColumn("hour_start", shift_hours(F.col("hour_start"), 1))
    return prefer_live(rows, live.withColumnRenamed("bucket_start", "hour_start"), ("monitoring_post_id", "hour_start")).select(*ANCHOR)


def forecast_anchors(predictions: DataFrame, hourly: DataFrame, posts: DataFrame, live: DataFrame) -> DataFrame:
    """Ready predictions whose post was measured an hour before the cutoff, with the cutoff's weather; also data_cutoff."""
    ready = predictions.filter("status = 'ready' and predicted_value is not null")
    measured = hourly.filter("filtered_hourly_mean is not null").select("monitoring_post_id", "substance_code", shift_hours(F.col("bucket_start"), 1).alias("data_cutoff"))
    kept = ready.join(measured, ["monitoring_post_id", "substance_code", "data_cutoff"], "left_semi").join(_located(posts), "monitoring_post_id")
    rows = kept.join(anchor_columns(live, "data_cutoff"), ["monitoring_post_id", "data_cutoff"], "left")
    rows = rows.withColumns({"hour_start": F.col("target_start"), "value": F.col("predicted_value"), "samples_count": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    return rows.select(*ANCHOR, "data_cutoff")


def forecast_cutoffs(predictions: DataFrame) -> DataFrame:
    """substance_code, target_start, data_cutoff (the latest) and duration_seconds of ready predictions."""
    found = predictions.filter("status = 'ready'").groupBy("substance_code", "target_start").agg(F.max("data_cutoff").alias("data_cutoff"))
    seconds = (F.unix_micros("target_start") - F.unix_micros("data_cutoff")) / 1e6
    return found.withColumn("duration_seconds", F.coalesce(seconds, F.lit(3600.0)))
