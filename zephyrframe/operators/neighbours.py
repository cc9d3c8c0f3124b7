"""What neighbouring posts upwind measured, by data-dependent travel time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import alignment, bearing_degrees, haversine_km, shift_hours
from zephyrframe.operators.frames import own_gas
from zephyrframe.settings import DEFAULTS, Settings

SPATIAL = (
    "spatial_upwind_value",
    "spatial_neighbor_mean",
    "spatial_neighbor_max",
    "spatial_weight_sum",
    "spatial_neighbor_count",
    "spatial_min_distance_km",
    "backtrajectory_value",
    "backtrajectory_distance_km",
    "backtrajectory_travel_hours",
    "backtrajectory_alignment",
)


def post_pairs(posts: DataFrame) -> DataFrame:
    """Distance and bearing from each located post to each other one, computed once."""
    known = posts.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).dropDuplicates(["monitoring_post_id"])
    a = known.select("monitoring_post_id", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    b = known.select(F.col("monitoring_post_id").alias("neighbor_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    place = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    joined = a.join(b, F.col("monitoring_post_id") != F.col("neighbor_id"))
    return joined.select("monitoring_post_id", "neighbor_id", haversine_km(*place).alias("distance_km"), bearing_degrees(*place).alias("bearing"))


def upwind_values(frame: DataFrame, posts: DataFrame) -> DataFrame:
    """One row for each frame row and neighbour upwind of it that has a value when its air set out.

    `frame` has monitoring_post_id, substance_code, source_bucket, value and the
    source wind. The lag of 0 to 3 hours is the travel time, rounded half to
    even; the neighbour's value is found by an equi-join on its hour.
    """
    keys = ["monitoring_post_id", "substance_code", "source_bucket"]
    wind = frame.select(*keys, F.col("source_weather_hor_win_dir").alias("wind_from"), F.col("source_weather_hor_win_spd").alias("wind_speed")).filter("wind_from is not null and wind_speed is not null")
    near = wind.join(post_pairs(posts), "monitoring_post_id").withColumn("alignment", alignment(F.col("wind_from"), F.col("bearing"))).filter("alignment > 0")
    near = near.withColumn("travel_hours", F.col("distance_km") / F.greatest(F.col("wind_speed") * 3.6, F.lit(0.1)))
    near = near.withColumn("lag_hours", F.least(F.rint("travel_hours"), F.lit(3.0)).cast("int"))
    near = near.withColumn("seen_at", shift_hours(F.col("source_bucket"), -F.col("lag_hours")))
    seen = frame.filter(F.col("value").isNotNull()).select(F.col("monitoring_post_id").alias("neighbor_id"), "substance_code", F.col("source_bucket").alias("seen_at"), "value")
    return near.join(seen, ["neighbor_id", "substance_code", "seen_at"])


def summarize_upwind(found: DataFrame, radius_meters: float) -> DataFrame:
    """The ten spatial features of rows that have neighbours."""
    d, a, v = F.col("distance_km"), F.col("alignment"), F.col("value")
    weight = a * F.exp(-d / 20.0)
    reach = d * 1000.0 / radius_meters
    path = F.when(reach <= 1, a * F.exp(-0.5 * reach * reach))
    mean = lambda x, w: F.try_divide(F.sum(x * w), F.sum(w))
    return found.groupBy("monitoring_post_id", "substance_code", "source_bucket").agg(
        mean(v, weight).alias("spatial_upwind_value"),
        F.avg(v).alias("spatial_neighbor_mean"),
        F.max(v).alias("spatial_neighbor_max"),
        F.sum(weight).alias("spatial_weight_sum"),
        F.count(v).cast("double").alias("spatial_neighbor_count"),
        F.min(d).alias("spatial_min_distance_km"),
        mean(v, path).alias("backtrajectory_value"),
        mean(d, path).alias("backtrajectory_distance_km"),
        mean(F.col("travel_hours"), path).alias("backtrajectory_travel_hours"),
        mean(a, path).alias("backtrajectory_alignment"),
    )


def add_spatial(frame: DataFrame, settings: Settings = DEFAULTS, posts: DataFrame | None = None) -> DataFrame:
    """A local frame with its spatial features; rows without neighbours have count and weight 0.

    With `posts`, those of the frame among them, places aren't gathered from the frame once more.
    """
    slim = frame.select("monitoring_post_id", "substance_code", "source_bucket", own_gas(settings.gases, "_lag_0").alias("value"), "source_weather_hor_win_dir", "source_weather_hor_win_spd")
    posts = frame.select("monitoring_post_id", "latitude", "longitude").distinct() if posts is None else posts
    features = summarize_upwind(upwind_values(slim, posts), settings.influence_meters)
    joined = frame.join(features, ["monitoring_post_id", "substance_code", "source_bucket"], "left")
    return joined.fillna(0.0, ["spatial_weight_sum", "spatial_neighbor_count"])
