"""Lags, rolling features and weather roles of hourly rows as they stream in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.operators.frames import LAGS, WINDOWS, add_times
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources.readings import WEATHER

#: Hours a post's state keeps: as far as the longest lag and window look back.
DEPTH = max(max(LAGS), max(WINDOWS) - 1)
STATE = "last long, ring array<double>, waiting array<long>, held array<double>"
HOUR = 3600


def rolled(history: np.ndarray, hours: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (of one value at least) and population deviation (of two) over the last `window` hours, for the last `hours` of a history; else NaN."""
    padded = np.concatenate((np.full(window - 1, np.nan), history))
    views = np.lib.stride_tricks.sliding_window_view(padded, window)[-hours:]
    there = ~np.isnan(views)
    n = there.sum(axis=1)
    mean = np.where(there, views, 0.0).sum(axis=1) / np.where(n > 0, n, np.nan)
    spread = np.where(there, views - mean[:, None], 0.0)
    return mean, np.where(n >= 2, np.sqrt((spread * spread).sum(axis=1) / np.maximum(n, 1)), np.nan)


def stream_features(hourly: DataFrame, gas: str, settings: Settings = DEFAULTS, lateness: str | None = "2 hours") -> DataFrame:
    """monitoring_post_id, source_bucket, gas_<code>_lag_<n> and target_rolling_<mean|std>_<w> of `gas`, from a stream of hourly rows.

    The rows are those of `frames.add_lags` and `frames.add_rolling` over each post's dense calendar: silent hours between
    two measured ones get rows as well. An hour goes out once the watermark has passed it, so batches and restarts may split
    the stream anywhere; a row later than the watermark is dropped, and hours above it wait. Of a post's rows of one gas and hour
    the greatest value counts. A post's state is its last hours' values and what waits. `lateness` None: the stream has a watermark already.
    """
    gases = list(settings.gases)
    lagged = [f"gas_{g}_lag_{n}" for g in gases for n in LAGS]
    rolling = [f"target_rolling_{k}_{w}" for w in WINDOWS for k in ("mean", "std")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring, waiting, held = state.get if state.exists else (None, [], [], [])
        ring = np.array(ring, float).reshape(-1, len(gases))
        wide = pd.DataFrame(np.array(held, float).reshape(-1, len(gases)), index=np.array(waiting, "int64"), columns=gases)
        for rows in batches:
            fresh = rows if last is None else rows[rows["second"] > last]
            cells = fresh.groupby(["second", "substance_code"])["value"].max().unstack()
            wide = pd.concat([wide, cells.reindex(columns=gases)]).groupby(level=0).max()
        due = wide.index.to_numpy() * 1000 < state.getCurrentWatermarkMs()
        ready, wide = wide[due], wide[~due]
        if len(ready):
            start = int(ready.index[0]) if last is None else last + HOUR
            seconds = np.arange(start, int(ready.index[-1]) + 1, HOUR)
            history = np.concatenate((np.full((DEPTH, len(gases)), np.nan), ring, ready.reindex(seconds).to_numpy(float)))
            first = len(history) - len(seconds)
            out = {"monitoring_post_id": key[0], "second": seconds}
            out |= {f"gas_{g}_lag_{n}": history[first - n : len(history) - n, k] for k, g in enumerate(gases) for n in LAGS}
            for w in WINDOWS:
                out[f"target_rolling_mean_{w}"], out[f"target_rolling_std_{w}"] = rolled(history[:, gases.index(gas)], len(seconds), w)
            last, ring = int(seconds[-1]), history[-DEPTH:]
            yield pd.DataFrame(out)
        state.update((last, ring.ravel().tolist(), [int(s) for s in wide.index], wide.to_numpy(float).ravel().tolist()))
        if len(wide):
            state.setTimeoutTimestamp(int(wide.index[0]) * 1000 + 1)

    kind = hourly.schema["monitoring_post_id"].dataType.simpleString()
    known = hourly if lateness is None else hourly.withWatermark("bucket_start", lateness)
    rows = known.filter(F.col("substance_code").isin(gases) & F.col("filtered_hourly_mean").isNotNull())
    slim = rows.select("monitoring_post_id", "substance_code", "bucket_start", F.unix_seconds("bucket_start").alias("second"), F.col("filtered_hourly_mean").alias("value"))
    schema = f"monitoring_post_id {kind}, second long, " + ", ".join(f"{c} double" for c in [*lagged, *rolling])
    made = slim.groupBy("monitoring_post_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    whole = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in [*lagged, *rolling]]
    return made.select("monitoring_post_id", F.timestamp_seconds("second").alias("source_bucket"), *whole)


def stream_weather_roles(frame: DataFrame, weather: DataFrame, measures: Sequence[str] = tuple(WEATHER), lateness: str = "2 hours") -> DataFrame:
    """`frames.add_weather` where both sides are streams: a row with the weather at its source bucket, cutoff and target.

    One outer join: each weather row is dealt to the three source buckets that it serves, and the roles of a row are
    gathered from one join instead of three. A row goes out once both watermarks have passed the hours that it needs, with null for weather
    that hadn't come by then; state on both sides is dropped by the watermarks. `weather` has one row for a post's hour.
    `frame` has monitoring_post_id and source_bucket (unique together, without a watermark) and columns that go along.
    """
    keys = ["monitoring_post_id", "source_bucket"]
    rest = [c for c in frame.columns if c not in keys]
    roles = ("source", "transport", "target")
    values = F.struct(*[F.col(m).cast("double").alias(m) for m in measures])
    dealt = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shift_hours(F.col("bucket_start"), -k).alias("at")) for k in range(len(roles))]))
    side = weather.withWatermark("bucket_start", lateness).select(F.col("monitoring_post_id").alias("__post"), "bucket_start", values.alias("__w"), dealt.alias("__r"))
    # The hour that a dealt row serves is bound to its own, so the join's state ends by the watermark of either side.
    near = (F.col("bucket_start") >= F.col("source_bucket")) & (F.col("bucket_start") <= shift_hours(F.col("source_bucket"), len(roles) - 1))
    known = frame.withWatermark("source_bucket", lateness)
    met = known.join(side, (F.col("monitoring_post_id") == F.col("__post")) & (F.col("source_bucket") == F.col("__r.at")) & near, "left")
    one = lambda k: F.max_by("__w", F.when(F.col("__r.k") == k, F.lit(k))).alias(f"__{k}")
    gathered = met.groupBy("monitoring_post_id", "source_bucket").agg(*[F.first(c).alias(c) for c in rest], *[one(k) for k in range(len(roles))])
    shown = [F.col(f"__{k}.{m}").alias(f"{role}_weather_{m}") for k, role in enumerate(roles) for m in measures]
    return add_times(gathered).select(*keys, *rest, "data_cutoff", "target_start", "target_end", *shown)
