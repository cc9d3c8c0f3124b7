"""Sensor tables made of the benchmark's `events`, by integer arithmetic that SQL can repeat.

Ids: posts 1 to 4 measure, post 5 sends hourly readings, post 6 has no place,
post 7 is out of service. Instants are built from the epoch, so no session
time zone matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.operators.hourly import build_hourly, from_aggregated, union_hourly
from zephyrframe.sources.readings import WEATHER

CODES = {"click": "CO", "view": "NO", "purchase": "NO2", "signup": "O3", "error": "SO2"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, post, code, at (instant), value."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    codes = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    return table.select("event_id", (F.col("user_id") % 4 + 1).alias("post"), F.try_element_at(codes, F.col("event_type")).alias("code"), at.alias("at"), (F.col("value") - 100).alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples: monitoring_post_id, substance_code, timestamp, value, event_id; 87 in 100 values are negative."""
    return events(spark, sf_dir).filter("value is not null and code is not null").select(F.col("post").alias("monitoring_post_id"), F.col("code").alias("substance_code"), F.col("at").alias("timestamp"), "value", "event_id")


def sensor_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same samples behind devices and controllers: sensors, device_state, plc_state."""
    e = events(spark, sf_dir)
    sensors = e.select(F.lower("code").alias("substance_code"), F.floor(F.unix_micros("at") / 1000).alias("device_timestamp_ms"), "value", (F.col("event_id") % 40).alias("device_state_id"))
    devices = spark.range(36).select("id", (F.col("id") % 9).alias("plc_state_id"))
    controllers = spark.range(8).select("id", (F.col("id") % 4 + 1).alias("monitoring_post_id"))
    return sensors, devices, controllers


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings of post 5; some codes are in lower case."""
    e = events(spark, sf_dir).filter("event_id % 5 = 0 and code is not null and value is not null")
    hour = F.floor(F.unix_micros("at") / 3_600_000_000).cast("long")
    sums = e.groupBy("code", hour.alias("hour")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    code = F.when(F.col("hour") % 7 == 0, F.lower("code")).otherwise(F.col("code"))
    return sums.select(F.lit(5).cast("long").alias("monitoring_post_id"), code.alias("substance_code"), (F.col("hour") * 3_600_000).alias("bucket_ms"), (F.col("total") / F.col("n")).alias("value"))


def posts(spark: SparkSession) -> DataFrame:
    """id, latitude, longitude, active_to, source."""
    ids = spark.range(1, 8)
    known = F.col("id") != 6
    return ids.select(
        "id",
        F.when(known, 55.75 + 0.03 * F.col("id")).alias("latitude"),
        F.when(known, 37.60 + 0.04 * (F.col("id") * F.col("id") % 5)).alias("longitude"),
        F.when(F.col("id") == 7, F.timestamp_micros(F.lit(1_704_067_200_000_000))).alias("active_to"),
        F.when(F.col("id") == 5, "mosecom").otherwise("own").alias("source"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for each customer: id, field (a hundred ids each), latitude, longitude, active_to. Every eleventh has no place, every thirteenth is out of service."""
    key = F.col("c_custkey")
    known = key % 11 != 0
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("id"),
        F.floor(key / 100).alias("field"),
        F.when(known, 55.6 + (key * 7919 % 3000) / 10000.0).alias("latitude"),
        F.when(known, 37.3 + (key * 104_729 % 6000) / 10000.0).alias("longitude"),
        F.when(key % 13 == 0, F.timestamp_micros(F.lit(1_704_067_200_000_000))).alias("active_to"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier of each order line, once: two posts by id."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("to_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("from_id"))
    return lines.join(orders, "o_orderkey").select("from_id", "to_id").distinct()


def active(spark: SparkSession) -> DataFrame:
    """Posts in service as the frame wants them."""
    return posts(spark).filter("active_to is null").select(F.col("id").alias("monitoring_post_id"), "latitude", "longitude")


def hour_number(ts: Column) -> Column:
    """Hours since the epoch."""
    return F.floor(F.unix_micros(ts) / 3_600_000_000).cast("long")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of posts 1 to 5 over the events' time and three hours more, in both kinds."""
    span = events(spark, sf_dir).agg(hour_number(F.min("at")).alias("a"), hour_number(F.max("at")).alias("b"))
    hours = span.select(F.explode(F.sequence("a", F.col("b") + 3)).alias("h"))
    rows = hours.select("h", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p")).select("h", "p", F.explode(F.array(F.lit("live_forecast"), F.lit("historical_forecast"))).alias("data_kind"))
    h, p = F.col("h"), F.col("p")
    k = F.when(F.col("data_kind") == "live_forecast", 0).otherwise(1)
    windless = (h + p) % 11 == 0
    rain = F.when((h + p) % 6 == 0, (3 * h % 10) / 10.0).otherwise(0.0)
    value = {
        "air_temp": (h + p) % 30 - 10.0,
        "air_hum": 40.0 + (h + 2 * p) % 60,
        "atm_press": 990.0 + (h + p) % 40,
        "hor_win_spd": F.when(~windless, 2.0 + ((7 * h + 3 * p + k) % 50) / 10.0),
        "hor_win_dir": F.when(~windless, ((37 * h + 53 * p + k) % 360).cast("double")),
        "precipitation": rain,
        "cloud_cover": ((h * p) % 101).cast("double"),
        "cloud_cover_low": ((h + p) % 101).cast("double"),
        "wind_speed_100m": F.when((h + p) % 13 != 0, 3.0 + ((5 * h + 2 * p + k) % 60) / 10.0),
        "wind_direction_100m": F.when((h + p) % 17 != 0, ((31 * h + 47 * p + k) % 360).cast("double")),
        "wind_gusts_10m": 5.0 + ((3 * h + p) % 40) / 10.0,
        "boundary_layer_height": F.when((h + p) % 19 != 0, 300.0 + (13 * h + 17 * p + k) % 1500),
        "shortwave_radiation": ((11 * h) % 700).cast("double"),
    }
    return rows.select(p.cast("long").alias("monitoring_post_id"), F.timestamp_seconds(h * 3600).alias("bucket_start"), "data_kind", *[value[c].cast("double").alias(c) for c in WEATHER])


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather of kind live_forecast."""
    return weather(spark, sf_dir).filter("data_kind = 'live_forecast'").drop("data_kind")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly features of all posts."""
    internal = build_hourly(samples(spark, sf_dir), tie="event_id")
    coming = readings(spark, sf_dir).filter(F.col("substance_code") == F.upper("substance_code"))
    aggregated = from_aggregated(coming.select("monitoring_post_id", "substance_code", F.timestamp_millis("bucket_ms").alias("bucket_start"), F.abs("value").alias("value")))
    return union_hourly(internal, aggregated)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions an hour ahead of each measured hour's cutoff, in several states."""
    return predictions_of(hourly(spark, sf_dir))


def predictions_of(features: DataFrame) -> DataFrame:
    """The predictions that belong to these hourly features; each is made of its own hour alone."""
    h = features.filter("filtered_hourly_mean is not null")
    n = hour_number(F.col("bucket_start")) + F.col("monitoring_post_id")
    status = F.when(n % 7 == 0, "failed").when(n % 7 == 1, "running").otherwise("ready")
    value = F.when(n % 5 != 0, F.col("filtered_hourly_mean") * 0.9)
    # Every ninth is for a later cutoff, whose measurement may be missing.
    late = F.when(n % 9 == 0, 1).otherwise(0)
    cutoff = shift_hours(F.col("bucket_start"), 1 + late)
    return h.select(
        "monitoring_post_id",
        "substance_code",
        cutoff.alias("data_cutoff"),
        shift_hours(cutoff, 1).alias("target_start"),
        shift_hours(cutoff, 2).alias("target_end"),
        value.alias("predicted_value"),
        (value * 0.5).alias("lower_bound"),
        (value * 1.5).alias("upper_bound"),
        status.alias("status"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of stored frames, with gaps: substance_code, hour_start, data_kind, generated_at."""
    h = hourly(spark, sf_dir).select("substance_code", "bucket_start").distinct()
    n = hour_number(F.col("bucket_start"))
    kinds = F.array(
        F.struct(F.lit("analysis").alias("data_kind"), F.lit(0).alias("ahead"), (n % 29 != 0).alias("there"), F.lit(0).alias("minutes")),
        F.struct(F.lit("forecast").alias("data_kind"), F.lit(1).alias("ahead"), (n % 23 != 0).alias("there"), F.lit(-5).alias("minutes")),
        F.struct(F.lit("forecast").alias("data_kind"), F.lit(2).alias("ahead"), (n % 31 != 0).alias("there"), F.lit(5).alias("minutes")),
    )
    rows = h.select("substance_code", "bucket_start", F.explode(kinds).alias("k")).filter("k.there")
    return rows.select("substance_code", shift_hours(F.col("bucket_start"), F.col("k.ahead")).alias("hour_start"), "k.data_kind", F.timestamp_micros(F.unix_micros("bucket_start") + F.col("k.minutes") * 60_000_000).alias("generated_at"))
