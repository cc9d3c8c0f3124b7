"""The hourly job as Structured Streaming: late data, causal filtering with state, and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from zephyrframe.operators.hourly import SERIES, unsigned
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources import readings, store


def hourly_windows(samples: DataFrame, settings: Settings = DEFAULTS, value: str = "value", filtered: str | None = None) -> DataFrame:
    """All hourly measures of a stream; samples later than the lookback time are ignored.

    `filtered` names the filtered value where it was computed before, else the raw one
    counts. Windows begin at whole hours of UTC, which are local hours in zones of whole hours.
    """
    c = F.col(value)
    late = samples.withWatermark("timestamp", f"{settings.lookback_hours} hours")
    sums = late.groupBy(*SERIES, F.window("timestamp", "1 hour").alias("w")).agg(
        F.avg(c).alias("raw_hourly_mean"),
        F.percentile(c, F.lit(0.5)).alias("raw_hourly_median"),
        F.avg(filtered or value).alias("filtered_hourly_mean"),
        F.min(c).alias("hourly_min"),
        F.max(c).alias("hourly_max"),
        F.percentile(c, F.lit(0.95)).alias("hourly_p95"),
        F.stddev_pop(c).alias("hourly_std"),
        F.count(c).alias("samples_count"),
    )
    return sums.select(*SERIES, F.col("w.start").alias("bucket_start"), *readings.MEASURES, "samples_count")


def median_of_three(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The median of each value and the two before it, of so many as its place in the segment allows (0 the first)."""
    one, two = np.roll(values, 1), np.roll(values, 2)
    three = np.median(np.stack([values, one, two]), axis=0)
    return np.where(places >= 2, three, np.where(places == 1, (values + one) / 2, values))


def causal_median_stream(samples: DataFrame, gap_seconds: float, idle: str = "72 hours") -> DataFrame:
    """filtered_value of a stream: the median of a sample and the two before it, without bridging gaps.

    The state of a series is its last two samples and their time; it leaves once the
    series was silent for `idle`, and samples later than that are ignored. A stream can't know its median interval beforehand,
    so the gap is given. Samples older than the last one seen are passed on unfiltered
    and leave the state alone.
    """
    hours = int(idle.split()[0])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        at = rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        value = rows["value"].to_numpy(float)
        last, one, two, n = state.get if state.exists else (0.0, 0.0, 0.0, 0)
        known = [two, one][2 - n :]  # what the segment has already, the older first
        fresh = at >= last if n else np.ones(len(at), bool)
        out = value.copy()
        if fresh.any():
            times, values = np.concatenate((np.full(n, last), at[fresh])), np.concatenate((known, value[fresh]))
            begins = np.diff(times, prepend=times[0]) > gap_seconds
            order = np.arange(len(times))
            places = order - np.maximum.accumulate(np.where(begins, order, 0))
            out[fresh] = median_of_three(values, places)[n:]
            size = min(int(places[-1]) + 1, 2)
            state.update((float(times[-1]), float(values[-1]), float(values[-2]) if size > 1 else 0.0, size))
        newest = state.get[0] if state.exists else float(at[-1])
        state.setTimeoutTimestamp(int((newest + hours * 3600) * 1000))
        yield pd.DataFrame({"monitoring_post_id": key[0], "substance_code": key[1], "timestamp": rows["timestamp"].to_numpy(), "value": value, "filtered_value": out})

    kind = samples.schema["monitoring_post_id"].dataType.simpleString()
    schema = f"monitoring_post_id {kind}, substance_code string, timestamp timestamp, value double, filtered_value double"
    late = unsigned(samples).withWatermark("timestamp", idle)
    return late.groupBy(*SERIES).applyInPandasWithState(run, schema, "last double, one double, two double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_hourly(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream of hourly rows into a stored table; a batch that is run again writes the same rows."""
    rest = [c for c in stream.columns if c not in readings.HOURLY_KEY]

    def batch(rows: DataFrame, epoch: int) -> None:
        one = rows.groupBy(*readings.HOURLY_KEY).agg(F.max_by(F.struct(*rest), "samples_count").alias("r")).select(*readings.HOURLY_KEY, "r.*")
        day = F.floor(F.unix_micros("bucket_start") / 86_400_000_000).cast("int")
        store.upsert(rows.sparkSession, path, one.withColumn("day", day), readings.HOURLY_KEY, ("day",))

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
