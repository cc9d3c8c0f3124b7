"""The physical baseline: what arrives at a post without learning anything."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import clip, clip0
from zephyrframe.operators.frames import own_gas
from zephyrframe.settings import DEFAULTS, Settings

#: Loss by hour, and loss by hour and millimetre of rain, of each gas.
DECAY = {"CO": 0.01, "NO": 0.18, "NO2": 0.08, "O3": 0.04, "SO2": 0.07, "H2S": 0.05}
SCAVENGING = {"CO": 0.002, "NO": 0.004, "NO2": 0.012, "O3": 0.004, "SO2": 0.025, "H2S": 0.008}
DECAY_DEFAULT, SCAVENGING_DEFAULT = 0.05, 0.008


def by_gas(table: Mapping[str, float], default: float, code: Column) -> Column:
    """A value by gas code."""
    pairs = [x for g, v in table.items() for x in (F.lit(g), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def loss_rate(code: Column, rain: Column) -> Column:
    """Loss by hour, with what rain washes out."""
    return by_gas(DECAY, DECAY_DEFAULT, code) + by_gas(SCAVENGING, SCAVENGING_DEFAULT, code) * rain


def physical_baseline(local: Column, upwind: Column, wind: Column, rain: Column, source_height: Column, target_height: Column, hours: Column, code: Column) -> Column:
    """Own and upwind value blended by wind, thinned by mixing height, and lost over the hours."""
    own = clip0(local)
    other = clip0(F.coalesce(upwind, own))
    blend = clip(clip0(F.coalesce(wind, F.lit(0.0))) / 12.0, 0.0, 0.35)
    below = clip(F.coalesce(source_height, F.lit(500.0)), 50.0, 4000.0)
    above = clip(F.coalesce(target_height, below), 50.0, 4000.0)
    mixing = clip(F.sqrt(below / above), 0.45, 1.8)
    left = F.exp(-F.greatest(hours, F.lit(1.0)) * loss_rate(code, clip0(F.coalesce(rain, F.lit(0.0)))))
    return clip0((own * (1 - blend) + other * blend) * mixing * left)


def add_baseline(frame: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A frame with physical_baseline; columns it lacks count as missing."""
    has = lambda c: F.col(c) if c in frame.columns else F.lit(None).cast("double")
    if {"source_bucket", "target_start"} <= set(frame.columns):
        hours = (F.unix_micros("target_start") - F.unix_micros("source_bucket")) / 3.6e9
    else:
        hours = F.lit(1.0)
    gases = [g for g in settings.gases if f"gas_{g}_lag_0" in frame.columns]
    local = own_gas(gases, "_lag_0") if gases else F.lit(None).cast("double")
    value = physical_baseline(
        local,
        has("spatial_upwind_value"),
        has("transport_weather_hor_win_spd"),
        has("transport_weather_precipitation"),
        has("source_weather_boundary_layer_height"),
        has("target_weather_boundary_layer_height"),
        hours,
        F.col("substance_code"),
    )
    return frame.withColumn("physical_baseline", value)
