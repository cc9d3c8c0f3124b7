from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from zephyrframe.settings import Settings
from zephyrframe.sources import store
from zephyrframe.streaming import hourly_stream

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "monitoring_post_id long, substance_code string, timestamp timestamp, value double"


def feed(spark, path, rows, name):
    spark.createDataFrame([(1, "CO", T0 + timedelta(minutes=m), v) for m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_of_hours_is_upserted(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "hourly")
    feed(spark, source, [(0, 1.0), (5, 3.0), (70, 5.0)], "a")
    stream = hourly_stream.hourly_windows(spark.readStream.schema(SCHEMA).parquet(source), Settings(timezone="UTC"))
    hourly_stream.upsert_hourly(stream, target, str(tmp_path / "cp")).awaitTermination()
    feed(spark, source, [(10, 5.0)], "b")
    stream = hourly_stream.hourly_windows(spark.readStream.schema(SCHEMA).parquet(source), Settings(timezone="UTC"))
    hourly_stream.upsert_hourly(stream, target, str(tmp_path / "cp")).awaitTermination()
    got = {r["bucket_start"].hour: (r["filtered_hourly_mean"], r["samples_count"]) for r in store.read(spark, target).collect()}
    assert got == {0: (3.0, 3), 1: (5.0, 1)}
    first = store.read(spark, target).filter(F.hour("bucket_start") == 0).first()
    assert (first["raw_hourly_mean"], first["raw_hourly_median"], first["hourly_p95"], first["hourly_min"]) == pytest.approx((3.0, 3.0, 4.8, 1.0))


def test_median_of_three_equals_brute_force():
    import random
    from statistics import median

    import numpy as np

    r = random.Random(1)
    values = [r.random() for _ in range(200)]
    place, places = 0, []
    for _ in values:
        place = 0 if r.random() < 0.2 else place + 1 if places else 0
        places.append(place)
    want = [median(values[i - min(p, 2) : i + 1]) for i, p in enumerate(places)]
    assert hourly_stream.median_of_three(np.array(values), np.array(places)).tolist() == want


def test_causal_median_keeps_state_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    feed(spark, source, [(0, 1.0), (5, -100.0)], "a")
    def run():
        out = hourly_stream.causal_median_stream(spark.readStream.schema(SCHEMA).parquet(source), 900.0)
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    feed(spark, source, [(10, 1.0), (120, 50.0)], "b")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").select(F.minute("timestamp"), "filtered_value").collect()
    assert [r[1] for r in rows] == [1.0, 50.5, 1.0, 50.0]
