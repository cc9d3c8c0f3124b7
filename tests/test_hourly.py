from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import hourly
from zephyrframe.settings import Settings
from zephyrframe.sources import readings, store

SCHEMA = "monitoring_post_id long, substance_code string, timestamp timestamp, value double"
UTC = Settings(timezone="UTC")


def samples(spark, rows, post=1, code="CO"):
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame([(post, code, day.replace(hour=h, minute=m), v) for h, m, v in rows], SCHEMA)


def test_causal_median_comes_before_the_mean(spark):
    row = hourly.build_hourly(samples(spark, [(0, 0, 1.0), (0, 5, 100.0), (0, 10, 1.0)]), UTC).first()
    assert row["raw_hourly_mean"] == 34.0 and row["raw_hourly_median"] == 1.0 and row["filtered_hourly_mean"] == 17.5 and row["samples_count"] == 3


def test_gaps_are_not_bridged(spark):
    out = hourly.build_hourly(samples(spark, [(0, 0, 1.0), (0, 5, 2.0), (0, 10, 3.0), (2, 0, 100.0)]), UTC)
    assert out.filter(F.hour("bucket_start") == 2).first()["filtered_hourly_mean"] == 100.0


def test_signs_are_dropped_and_single_samples_have_no_spread(spark):
    row = hourly.build_hourly(samples(spark, [(0, 0, -1.0), (0, 5, -2.0), (0, 10, 3.0), (0, 15, None)]), UTC).first()
    assert (row["raw_hourly_mean"], row["hourly_min"], row["hourly_max"]) == (2.0, 1.0, 3.0)
    assert hourly.build_hourly(samples(spark, [(0, 0, 5.0)]), UTC).first()["hourly_std"] == 0.0
    assert hourly.build_hourly(samples(spark, []), UTC).count() == 0


def test_aggregated_readings_are_not_filtered(spark):
    rows = [(1, "no2", 0, 9.0), (1, "NO2", 0, -0.001), (1, "NO2", 3_600_000, 0.1), (1, "NO2", 7_200_000, 0.002), (1, "XX", 0, 1.0), (1, "NO2", 1, None)]
    table = spark.createDataFrame(rows, "monitoring_post_id long, substance_code string, bucket_ms long, value double")
    out = hourly.from_aggregated(readings.aggregated_readings(table, ["NO2"])).orderBy("bucket_start").collect()
    assert [r["filtered_hourly_mean"] for r in out] == [0.001, 0.1, 0.002] and {r["samples_count"] for r in out} == {1}


def test_upsert_takes_the_later_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], "k int, p string, v double")
    new = spark.createDataFrame([(2, "b", None), (4, "a", 4.0)], "k int, p string, v double")
    got = {r["k"]: r["v"] for r in store.latest_by_key(["k", "p"], old, new).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 4.0}
    path = str(tmp_path / "t")
    store.upsert(spark, path, old, ["k", "p"], ["p"])
    store.upsert(spark, path, new, ["k", "p"], ["p"])
    assert {r["k"]: r["v"] for r in store.read(spark, path).collect()} == got
    assert store.drop_partitions(spark, path, F.col("p") == "a", ["p"]) == 1
    assert {r["k"] for r in store.read(spark, path).collect()} == {2, 3}


def test_negatives_are_normalised(spark):
    columns = ", ".join(f"{m} double" for m in readings.MEASURES)
    rows = [(1.0, 1.0, 1.0, -2.0, 5.0, 4.0, 0.5), (-3.0, -3.0, -3.0, -5.0, -1.0, -1.0, 0.5), (1.0, 1.0, 1.0, 0.5, 2.0, 2.0, 0.1), (None, None, None, None, None, None, None)]
    out = [tuple(r) for r in store.normalize_negatives(spark.createDataFrame(rows, columns)).collect()]
    assert out[0] == (1.0, 1.0, 1.0, 0.0, 5.0, 4.0, 0.5) and out[1] == (3.0, 3.0, 3.0, 1.0, 5.0, 1.0, 0.5) and out[2] == rows[2] and out[3] == rows[3]


def test_local_hours_follow_the_zone(spark):
    from zephyrframe.functions.expressions import local_hour

    at = spark.createDataFrame([(datetime(2026, 1, 1, 10, 20, tzinfo=timezone.utc),)], "t timestamp")
    minute = lambda zone: at.select(F.date_format(local_hour(F.col("t"), zone), "HH:mm")).first()[0]
    assert minute("Europe/Moscow") == "10:00" and minute("Asia/Kolkata") == "09:30"


def test_settings_are_checked(monkeypatch):
    with pytest.raises(ValueError):
        Settings(cell_meters=5)
    monkeypatch.setenv("ZEPHYR_CELL_METERS", "250")
    monkeypatch.setenv("ZEPHYR_GASES", "CO,NO")
    got = Settings.from_environment()
    assert got.cell_meters == 250 and got.gases == ("CO", "NO")


def test_writers_remove_their_own_staged_rows_only(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1.0)], "k int, p string, v double")
    with store.Staging(spark, path) as other:
        held = other.put(rows)
        store.upsert(spark, path, rows, ["k", "p"], ["p"])
        store.rewrite(spark, path, rows.limit(0), rows, ["p"])
        assert held.collect() == rows.collect()
        store.upsert(spark, path, held, ["k", "p"], ["p"])
    with pytest.raises(RuntimeError), store.Staging(spark, path) as failing:
        failing.put(rows)
        raise RuntimeError
    assert os.listdir(f"{path}/_staging") == [] and store.read(spark, path).count() == 1
