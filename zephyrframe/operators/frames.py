"""The feature frame: dense hours, lags, rolling statistics, weather and labels for all gases in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.functions.expressions import cyclic_features, shift_hours
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources.readings import WEATHER

LAGS = (0, 1, 2, 3, 6, 12, 24)
WINDOWS = (3, 6, 12, 24)
STATS = ("raw_hourly_mean", "raw_hourly_median", "hourly_min", "hourly_max", "hourly_p95", "hourly_std", "samples_count")
#: Columns of a frame that are no features.
META = ("source_bucket", "data_cutoff", "target_start", "target_end", "target_value", "substance_code", "correction_target")


def calendar(hourly: DataFrame, posts: DataFrame | None = None, end: Column | None = None, ahead: int = 0) -> DataFrame:
    """monitoring_post_id, source_bucket: every hour from a post's first to its last (or to `end`).

    With `posts`, all of them get a calendar; those without data begin at the first hour of all.
    With `ahead`, so many hours follow, and `is_due` tells the calendar's own hours from them.
    """
    spans = hourly.groupBy("monitoring_post_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
    if posts is not None:
        earliest = spans.agg(F.min("first").alias("__earliest"))
        spans = posts.select("monitoring_post_id").join(spans, "monitoring_post_id", "left").join(F.broadcast(earliest), F.lit(True), "left")
        spans = spans.withColumn("first", F.coalesce("first", "__earliest"))
    stop = F.col("last") if end is None else end
    spans = spans.withColumn("stop", stop).filter(F.col("first") <= F.col("stop"))
    hours = F.explode(F.sequence(F.col("first"), shift_hours(F.col("stop"), ahead), F.expr("INTERVAL 1 HOUR"))).alias("source_bucket")
    if not ahead:
        return spans.select("monitoring_post_id", hours)
    return spans.select("monitoring_post_id", "stop", hours).select("monitoring_post_id", "source_bucket", (F.col("source_bucket") <= F.col("stop")).alias("is_due"))


def pivot_gases(hourly: DataFrame, gases: Sequence[str] = DEFAULTS.gases, value: str = "filtered_hourly_mean") -> DataFrame:
    """One column gas_<code> for each gas, also for gases without rows."""
    wide = hourly.groupBy("monitoring_post_id", "bucket_start").pivot("substance_code", list(gases)).agg(F.max(value))
    return wide.select("monitoring_post_id", F.col("bucket_start").alias("source_bucket"), *[F.col(f"`{g}`").alias(f"gas_{g}") for g in gases])


def add_lags(dense: DataFrame, gases: Sequence[str] = DEFAULTS.gases, lags: Sequence[int] = LAGS) -> DataFrame:
    """gas_<code>_lag_<n> over a dense calendar, where n rows are n hours."""
    hours = Window.partitionBy("monitoring_post_id").orderBy("source_bucket")
    return dense.select("*", *[F.lag(f"gas_{g}", n).over(hours).alias(f"gas_{g}_lag_{n}") for g in gases for n in lags])


def rolling(column: str, window: int) -> tuple[Column, Column]:
    """Mean (of one value at least) and population deviation (of two) of the last hours."""
    frame = Window.partitionBy("monitoring_post_id").orderBy("source_bucket").rowsBetween(1 - window, 0)
    c = F.col(column)
    return F.avg(c).over(frame), F.when(F.count(c).over(frame) >= 2, F.stddev_pop(c).over(frame))


def add_rolling(dense: DataFrame, gas: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """target_rolling_mean_<w> and target_rolling_std_<w> of one gas."""
    pairs = [(w, *rolling(f"gas_{gas}", w)) for w in windows]
    return dense.select("*", *[c for w, m, s in pairs for c in (m.alias(f"target_rolling_mean_{w}"), s.alias(f"target_rolling_std_{w}"))])


def add_times(frame: DataFrame) -> DataFrame:
    """data_cutoff, target_start and target_end: one, two and three hours after the source bucket."""
    hour = lambda n: shift_hours(F.col("source_bucket"), n)
    return frame.withColumns({"data_cutoff": hour(1), "target_start": hour(2), "target_end": hour(3)})


def add_weather(frame: DataFrame, weather: DataFrame, measures: Sequence[str] = tuple(WEATHER)) -> DataFrame:
    """The same weather in three roles: at the source bucket, at the cutoff and at the target."""
    for role, at in (("source", "source_bucket"), ("transport", "data_cutoff"), ("target", "target_start")):
        side = weather.select("monitoring_post_id", F.col("bucket_start").alias(at), *[F.col(m).alias(f"{role}_weather_{m}") for m in measures])
        frame = frame.join(side, ["monitoring_post_id", at], "left")
    return frame


def add_labels(frame: DataFrame, hourly: DataFrame) -> DataFrame:
    """target_value: the filtered mean of the row's gas and post at the target hour."""
    labels = hourly.select("monitoring_post_id", "substance_code", F.col("bucket_start").alias("target_start"), F.col("filtered_hourly_mean").alias("target_value"))
    return frame.join(labels, ["monitoring_post_id", "substance_code", "target_start"], "left")


def own_gas(gases: Sequence[str], suffix: str) -> Column:
    """The column gas_<code><suffix> of the row's own gas."""
    pairs = [x for g in gases for x in (F.lit(g), F.col(f"gas_{g}{suffix}"))]
    return F.try_element_at(F.create_map(*pairs), F.col("substance_code"))


def dense_frame(hourly: DataFrame, settings: Settings = DEFAULTS, targets: Sequence[str] | None = None, posts: DataFrame | None = None, end: Column | None = None, weather: DataFrame | None = None) -> DataFrame:
    """One row for a post's hour: lags of all gases and, for each target gas, a struct of its statistics, rolling features and label.

    Values and weather meet the calendar on the same keys, and all windows share
    one shuffle by post. Weather, which has one row for a post's hour, is joined once: its roles at the
    cutoff and the target are those of one and two rows on, and so is the label; the calendar has two hours more for them.
    """
    gases, targets = settings.gases, tuple(targets or settings.gases)
    keys = ["monitoring_post_id", "source_bucket"]
    known = hourly.filter(F.col("substance_code").isin(*gases))
    of = lambda g, c: F.max(F.when(F.col("substance_code") == g, F.col(c)))
    wide = known.groupBy("monitoring_post_id", F.col("bucket_start").alias("source_bucket")).agg(
        *[of(g, "filtered_hourly_mean").alias(f"gas_{g}") for g in gases],
        *[F.struct(*[of(g, s).alias(s) for s in STATS]).alias(f"stats_{g}") for g in targets],
    )
    dense = calendar(known, posts, end, ahead=2).join(wide, keys, "left")
    measures = [] if weather is None else list(WEATHER)
    if measures:
        dense = dense.join(weather.select("monitoring_post_id", F.col("bucket_start").alias("source_bucket"), *[F.col(m).alias(f"source_weather_{m}") for m in measures]), keys, "left")
    hours = Window.partitionBy("monitoring_post_id").orderBy("source_bucket")
    roles = [F.lead(f"source_weather_{m}", n).over(hours).alias(f"{role}_weather_{m}") for role, n in (("transport", 1), ("target", 2)) for m in measures]
    lags = [F.lag(f"gas_{g}", n).over(hours).alias(f"gas_{g}_lag_{n}") for g in gases for n in LAGS]
    rolled = [c.alias(f"rolled_{g}_{k}_{w}") for g in targets for w in WINDOWS for k, c in zip(("mean", "std"), rolling(f"gas_{g}", w))]
    labels = [F.lead(f"gas_{g}", 2).over(hours).alias(f"label_{g}") for g in targets]
    dense = dense.select("*", *lags, *rolled, *labels, *roles).filter("is_due")

    def own(g: str) -> Column:
        rolls = [F.col(f"rolled_{g}_{k}_{w}").alias(f"target_rolling_{k}_{w}") for w in WINDOWS for k in ("mean", "std")]
        return F.struct(F.lit(g).alias("substance_code"), F.col(f"gas_{g}").alias("value"), F.col(f"stats_{g}").alias("stats"), F.struct(*rolls).alias("rolled"), F.col(f"label_{g}").alias("target_value")).alias(f"own_{g}")

    shown = [f"{role}_weather_{m}" for role in ("source", "transport", "target") for m in measures]
    return dense.select(*keys, *[f"gas_{g}_lag_{n}" for g in gases for n in LAGS], *shown, *[own(g) for g in targets])


def deal_targets(dense: DataFrame, measured: bool = False) -> DataFrame:
    """Each row of a dense frame once for each target gas, with that gas' struct as columns; `measured`: only gases with a value at the hour."""
    structs = [c for c in dense.columns if c.startswith("own_")]
    each = F.array(*structs)
    each = F.filter(each, lambda own: own["value"].isNotNull()) if measured else each
    rows = dense.withColumn("own", F.explode(each)).drop(*structs)
    rest = [c for c in rows.columns if c not in ("monitoring_post_id", "source_bucket", "own")]
    return rows.select("monitoring_post_id", "source_bucket", "own.substance_code", "own.stats.*", *rest, "own.rolled.*", "own.target_value")


def gas_frames(hourly: DataFrame, settings: Settings = DEFAULTS, targets: Sequence[str] | None = None, posts: DataFrame | None = None, end: Column | None = None) -> DataFrame:
    """Lags of all gases, statistics and rolling features of the target: one row for post, hour and target gas."""
    return deal_targets(dense_frame(hourly, settings, targets, posts, end)).drop("target_value")


def local_frame(hourly: DataFrame, posts: DataFrame, weather: DataFrame, settings: Settings = DEFAULTS, training: bool = True, targets: Sequence[str] | None = None, end: Column | None = None) -> DataFrame:
    """The whole local frame. Training: labelled, and only rows with a current value. Else: all posts, up to `end`.

    What all targets of an hour share (times, place, weather, calendar) is computed before they are dealt out.
    """
    dense = add_times(dense_frame(hourly, settings, targets, None if training else posts, end, weather))
    dense = dense.join(posts.select("monitoring_post_id", "latitude", "longitude"), "monitoring_post_id", "left")
    frame = deal_targets(dense.withColumns(cyclic_features(F.col("target_start"), settings.timezone)), measured=training)
    return frame if training else frame.drop("target_value")


def feature_columns(frame: DataFrame, with_post: bool = True) -> list[str]:
    """Every column that is no key, time or label."""
    return [c for c in frame.columns if c not in META and (with_post or c != "monitoring_post_id")]


def history_until(frame: DataFrame, cutoff: Column) -> DataFrame:
    """Rows up to a cutoff; earlier hours stay, as neighbours look back."""
    return frame.filter(F.col("data_cutoff") <= cutoff)
