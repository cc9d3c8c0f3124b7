"""Features of a stream equal those of the stored rows, however the rows are split into batches."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from zephyrframe.operators import frames
from zephyrframe.settings import Settings
from zephyrframe.streaming.feature_stream import rolled, stream_features, stream_weather_roles

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "monitoring_post_id long, substance_code string, bucket_start timestamp, filtered_hourly_mean double"
SMALL = Settings(gases=("CO", "NO2"))


def measured(seed):
    """Two posts over 80 hours: silent hours, one gap longer than a day, one gas alone, repeated and null values; in order of time."""
    draw = random.Random(seed)
    out = []
    for h in range(80):
        for p in (1, 2):
            if (p == 2 and 20 <= h < 50) or draw.random() < 0.2:
                continue
            out += [(p, g, T0 + timedelta(hours=h), round(draw.random(), 6)) for g in ("CO", "NO2") if draw.random() < 0.8]
    return out + [(1, "CO", out[0][2], None), (1, "XX", T0, 9.0)]


def plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 7])
def test_stream_equals_stored_rows(spark, tmp_path, batches):
    rows = sorted(measured(3), key=lambda r: r[2])
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    end = [(9, "CO", T0 + timedelta(hours=h), 1.0) for h in (200, 400)]  # another post, whose rows move the watermark
    cuts = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
    for k, part in enumerate([*cuts, end[:1], end[1:]]):
        # Each part runs as a query of its own that starts again from the checkpoint; within it rows come in any order.
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stream_features(spark.readStream.schema(SCHEMA).parquet(source), "NO2", SMALL)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    hourly = spark.createDataFrame(rows, SCHEMA).filter("substance_code <> 'XX' and filtered_hourly_mean is not null")
    dense = frames.calendar(hourly).join(frames.pivot_gases(hourly, SMALL.gases), ["monitoring_post_id", "source_bucket"], "left")
    wanted = frames.add_rolling(frames.add_lags(dense, SMALL.gases), "NO2").drop("gas_CO", "gas_NO2")
    got = spark.read.parquet(target).filter("monitoring_post_id <> 9").select(*wanted.columns)
    assert plain(got.na.fill(-1.0)) == plain(wanted.na.fill(-1.0)) and got.count() > 140


def test_rolled_windows():
    nan = np.nan
    mean, std = rolled(np.array([1.0, nan, 3.0, nan, nan, nan]), 5, 3)
    assert np.allclose(mean, [1, 2, 3, 3, nan], equal_nan=True) and np.allclose(std, [nan, 1, nan, nan, nan], equal_nan=True)


def test_weather_roles_equal_the_stored_join(spark, tmp_path):
    """Weather comes before and after its rows, some hours have none; parts run as queries of their own."""
    hour = lambda h: T0 + timedelta(hours=h)
    left = [(p, hour(h), float(10 * h + p)) for h in range(30) for p in (1, 2)]
    right = [(p, hour(h), float(h), float(p)) for h in range(33) for p in (1, 2) if (h + p) % 5]
    kinds = "monitoring_post_id long, source_bucket timestamp, v double", "monitoring_post_id long, bucket_start timestamp, a double, b double"
    names = [str(tmp_path / n) for n in ("left", "right", "out", "mark")]
    # The first part has rows without their weather, the second the rest of both; then rows of another post move the watermarks.
    parts = [(left[:30], right[:20]), (left[30:], right[20:]), ([(9, hour(200), 0.0)], [(9, hour(200), 0.0, 0.0)]), ([(9, hour(400), 0.0)], [(9, hour(400), 0.0, 0.0)])]
    for part in parts:
        for rows, kind, name in zip(part, kinds, names):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(name)
        streams = [spark.readStream.schema(k).parquet(n) for k, n in zip(kinds, names)]
        out = stream_weather_roles(*streams, ("a", "b"), "24 hours")
        out.writeStream.format("parquet").option("path", names[2]).option("checkpointLocation", names[3]).trigger(availableNow=True).start().awaitTermination()
    wanted = frames.add_weather(frames.add_times(spark.createDataFrame(left, kinds[0])), spark.createDataFrame(right, kinds[1]), ("a", "b"))
    got = spark.read.parquet(names[2]).filter("monitoring_post_id <> 9").select(*wanted.columns)
    assert got.count() == 60 and plain(got.na.fill(-1.0)) == plain(wanted.na.fill(-1.0))
