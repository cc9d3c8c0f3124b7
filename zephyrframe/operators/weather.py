"""Mean weather over stations, and live weather over earlier weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR_WEATHER = {
    "weather_wind_speed": "wind_speed_100m",
    "weather_wind_direction": "wind_direction_100m",
    "weather_boundary_layer_height": "boundary_layer_height",
    "weather_precipitation": "precipitation",
}


def circular_mean(degrees: Column) -> Column:
    """The mean direction of an aggregate, in [0, 360)."""
    mean = F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))
    return F.pmod(F.degrees(mean) + 360.0, F.lit(360.0))


def mean_wind(weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """wind_speed and wind_direction of the wind at 10 m, from rows that have both."""
    both = weather.filter("hor_win_spd is not null and hor_win_dir is not null")
    return both.groupBy(*keys).agg(F.avg("hor_win_spd").alias("wind_speed"), circular_mean(F.col("hor_win_dir")).alias("wind_direction"))


def mean_weather(weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean wind at 100 m (10 m where missing, speed and direction apart), mixing height and rain."""
    speed, direction = F.coalesce("wind_speed_100m", "hor_win_spd"), F.coalesce("wind_direction_100m", "hor_win_dir")
    both = speed.isNotNull() & direction.isNotNull()
    return weather.groupBy(*keys).agg(
        F.avg(F.when(both, speed)).alias("wind_speed"),
        circular_mean(F.when(both, direction)).alias("wind_direction"),
        F.avg("boundary_layer_height").alias("boundary_layer_height"),
        F.avg("precipitation").alias("precipitation"),
    )


def prefer_live(anchors: DataFrame, weather: DataFrame, keys: Sequence[str] = ("monitoring_post_id",)) -> DataFrame:
    """Anchors with live weather where there is some, column by column."""
    live = weather.select(*keys, *[F.col(c).alias(f"__{a}") for a, c in ANCHOR_WEATHER.items()])
    joined = anchors.join(live, list(keys), "left")
    old = lambda a: F.col(a) if a in anchors.columns else F.lit(None).cast("double")
    return joined.select(*[c for c in anchors.columns if c not in ANCHOR_WEATHER], *[F.coalesce(F.col(f"__{a}"), old(a)).alias(a) for a in ANCHOR_WEATHER])


def anchor_columns(weather: DataFrame, at: str) -> DataFrame:
    """Weather renamed for a left join to anchors on (monitoring_post_id, `at`)."""
    return weather.select("monitoring_post_id", F.col("bucket_start").alias(at), *[F.col(c).alias(a) for a, c in ANCHOR_WEATHER.items()])
