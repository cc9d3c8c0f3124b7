"""Which hours of fields are missing or stale, and from where they are rebuilt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.settings import DEFAULTS, Settings


def expected_outputs(hourly: DataFrame, posts: DataFrame, predictions: DataFrame, start: Column, end: Column, gases: Sequence[str] = DEFAULTS.gases) -> DataFrame:
    """bucket_start, substance_code, forecast_expected of hours with a located measurement."""
    located = posts.filter("latitude is not null and longitude is not null").select(F.col("id").alias("monitoring_post_id"))
    seen = hourly.filter(F.col("substance_code").isin(*gases) & (F.col("bucket_start") >= start) & (F.col("bucket_start") < end) & F.col("filtered_hourly_mean").isNotNull())
    hours = seen.join(located, "monitoring_post_id", "left_semi").select("bucket_start", "substance_code").distinct()
    ready = predictions.filter((F.col("status") == "ready") & (F.col("target_start") == shift_hours(F.col("data_cutoff"), 1)))
    ready = ready.select("substance_code", shift_hours(F.col("data_cutoff"), -1).alias("bucket_start")).distinct().withColumn("__ready", F.lit(True))
    return hours.join(ready, ["bucket_start", "substance_code"], "left").select("bucket_start", "substance_code", F.col("__ready").isNotNull().alias("forecast_expected"))


def latest_frames(frames: DataFrame, start: Column, end: Column, gases: Sequence[str] = DEFAULTS.gases) -> DataFrame:
    """The last generation of each (hour_start, data_kind, substance_code); both bounds inclusive."""
    kept = frames.filter(F.col("substance_code").isin(*gases) & (F.col("hour_start") >= start) & (F.col("hour_start") <= end))
    return kept.groupBy("hour_start", "data_kind", "substance_code").agg(F.max("generated_at").alias("generated_at"))


def cutoffs_to_rebuild(expected: DataFrame, existing: DataFrame, due: Column) -> DataFrame:
    """cutoff: all eligible cutoffs from the first missing one on, as fields are chained.

    Missing: no analysis; a forecast expected but absent; at the due cutoff, no
    nowcast or one older than its analysis.
    """
    rows = expected.filter("bucket_start is not null and substance_code is not null").select("substance_code", "forecast_expected", F.col("bucket_start").alias("analysis_at"), shift_hours(F.col("bucket_start"), 1).alias("cutoff"), shift_hours(F.col("bucket_start"), 2).alias("forecast_at"))
    for name, at, kind in (("analysis", "analysis_at", "analysis"), ("nowcast", "cutoff", "forecast"), ("forecast", "forecast_at", "forecast")):
        side = existing.filter(F.col("data_kind") == kind).select(F.col("hour_start").alias(at), "substance_code", F.lit(True).alias(f"has_{name}"), F.col("generated_at").alias(f"{name}_generated"))
        rows = rows.join(side, [at, "substance_code"], "left")
    has = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    stale = F.coalesce(F.col("nowcast_generated") < F.col("analysis_generated"), F.lit(False))
    missing = ~has("analysis") | (F.col("forecast_expected") & ~has("forecast")) | ((F.col("cutoff") == due) & (~has("nowcast") | stale))
    first = rows.filter(missing).agg(F.min("cutoff").alias("first"))
    return rows.select("cutoff").distinct().join(F.broadcast(first), F.col("cutoff") >= F.col("first")).select("cutoff")


def catchup_bounds(due: Column, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """First source hour looked at, and the last frame hour."""
    return shift_hours(due, -settings.catchup_hours), shift_hours(due, 1)
