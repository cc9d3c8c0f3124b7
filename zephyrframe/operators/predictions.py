"""Prediction rows: eligibility, bounds, status and removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.operators.frames import own_gas
from zephyrframe.settings import DEFAULTS, Settings

STATUSES = ("queued", "running", "ready", "failed", "unavailable")
KEY = ("monitoring_post_id", "substance_code", "target_start")


def eligible_rows(history: DataFrame, cutoff: Column, settings: Settings = DEFAULTS, more: Sequence[Column] = ()) -> DataFrame:
    """Rows at the cutoff (and at `more` of them) whose own gas has a current value."""
    gases = [g for g in settings.gases if f"gas_{g}_lag_0" in history.columns]
    if not gases:
        return history.filter(F.lit(False))
    return history.filter(F.col("data_cutoff").isin(cutoff, *more) & own_gas(gases, "_lag_0").isNotNull())


def forecast_value(baseline: Column, residual: Column) -> Column:
    """Baseline and learned residual together; missing counts as 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(baseline + residual, F.lit(None).cast("double")), F.lit(0.0)))


def add_bounds(frame: DataFrame, intervals: DataFrame, baseline: str = "physical_baseline", residual: str = "residual", default: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """predicted_value, lower_bound, upper_bound: bounds are taken from the unclipped value by gas."""
    raw = F.col(baseline) + F.col(residual)
    joined = frame.join(F.broadcast(intervals.select("substance_code", "lower", "upper")), "substance_code", "left")
    floor = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)))

    def bound(own: str, fallback: float | None) -> Column:
        shift = F.coalesce(F.col(own), F.lit(fallback).cast("double"))
        return F.when(shift.isNotNull(), floor(raw + shift))

    return joined.withColumns({"predicted_value": floor(raw), "lower_bound": bound("lower", default[0]), "upper_bound": bound("upper", default[1])}).drop("lower", "upper")


def with_status(rows: DataFrame, status: str, error: str | None = None, now: Column | None = None) -> DataFrame:
    """Prediction rows in a status; messages keep 4000 characters."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    value = lambda c: F.col(c) if status == "ready" and c in rows.columns else F.lit(None).cast("double")
    stamp = F.current_timestamp() if now is None else now
    return rows.select(
        *KEY[:2],
        stamp.alias("generated_at"),
        "data_cutoff",
        "target_start",
        "target_end",
        *[value(c).alias(c) for c in ("predicted_value", "lower_bound", "upper_bound")],
        F.lit(status).alias("status"),
        F.substring(F.lit(error).cast("string"), 1, 4000).alias("error_message"),
        stamp.alias("updated_at"),
    )


def measured_before(predictions: DataFrame, hourly: DataFrame, cutoff: Column) -> Column:
    """The join condition of predictions of a cutoff and the measurement an hour before it."""
    return (
        (predictions["monitoring_post_id"] == hourly["monitoring_post_id"])
        & (predictions["substance_code"] == hourly["substance_code"])
        & (predictions["target_start"] == shift_hours(cutoff, 1))
    )


def unmeasured(predictions: DataFrame, hourly: DataFrame, cutoff: Column) -> DataFrame:
    """Predictions of the cutoff's next hour whose post had no measurement in the hour before it: those to delete."""
    latest = hourly.filter((F.col("bucket_start") == shift_hours(cutoff, -1)) & F.col("filtered_hourly_mean").isNotNull()).select("monitoring_post_id", "substance_code")
    aimed = predictions.filter(F.col("target_start") == shift_hours(cutoff, 1))
    return aimed.join(latest, ["monitoring_post_id", "substance_code"], "left_anti")


def without_unmeasured(predictions: DataFrame, hourly: DataFrame, *cutoffs: Column) -> DataFrame:
    """All other predictions, of whichever of the cutoffs: those that stay."""
    keys = ["monitoring_post_id", "substance_code", "target_start"]
    latest = hourly.filter(F.col("bucket_start").isin(*[shift_hours(c, -1) for c in cutoffs]) & F.col("filtered_hourly_mean").isNotNull())
    seen = latest.select(*keys[:2], shift_hours(F.col("bucket_start"), 2).alias("target_start")).distinct().withColumn("__seen", F.lit(True))
    joined = predictions.join(seen, keys, "left").select(*predictions.columns, "__seen")
    return joined.filter(~F.col("target_start").isin(*[shift_hours(c, 1) for c in cutoffs]) | F.col("__seen")).drop("__seen")
