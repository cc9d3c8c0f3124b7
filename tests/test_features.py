import json
import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import baseline, evaluation, frames, neighbours, predictions
from zephyrframe.plans import samples as S
from zephyrframe.plans.job import current_cutoff, moment
from zephyrframe.sources import readings, weather_feed

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_upwind_neighbour_is_chosen(spark):
    posts = spark.createDataFrame([(1, 55.75, 37.6), (2, 55.76, 37.6)], "monitoring_post_id long, latitude double, longitude double")
    rows = [(1, "NO2", T0, 1.0, 0.0, 5.0), (2, "NO2", T0, 3.0, 0.0, 5.0)]
    frame = spark.createDataFrame(rows, "monitoring_post_id long, substance_code string, source_bucket timestamp, value double, source_weather_hor_win_dir double, source_weather_hor_win_spd double")
    out = {r["monitoring_post_id"]: r for r in neighbours.summarize_upwind(neighbours.upwind_values(frame, posts), 10_000).collect()}
    assert set(out) == {1} and out[1]["spatial_upwind_value"] == pytest.approx(3.0) and out[1]["spatial_neighbor_count"] == 1.0
    assert out[1]["spatial_min_distance_km"] == pytest.approx(1.112, abs=1e-3) and out[1]["backtrajectory_alignment"] == pytest.approx(1.0)


def test_baseline_lies_between_own_and_upwind_value(spark):
    row = [("NO2", 1.0, 3.0, 6.0, 0.0, 500.0, 500.0)]
    frame = spark.createDataFrame(row, "substance_code string, gas_NO2_lag_0 double, spatial_upwind_value double, transport_weather_hor_win_spd double, transport_weather_precipitation double, source_weather_boundary_layer_height double, target_weather_boundary_layer_height double")
    value = baseline.add_baseline(frame).first()["physical_baseline"]
    assert 1.0 < value < 3.0 and value == pytest.approx((0.65 + 1.05) * math.exp(-0.08))
    assert baseline.add_baseline(frame.withColumn("gas_NO2_lag_0", F.lit(None).cast("double"))).first()["physical_baseline"] is None


def test_only_current_measurements_are_eligible(spark):
    cut = T0 + timedelta(hours=5)
    rows = [(1, "NO2", cut, 2.0), (2, "NO2", cut, None), (3, "NO2", cut - timedelta(hours=1), 2.0)]
    frame = spark.createDataFrame(rows, "monitoring_post_id int, substance_code string, data_cutoff timestamp, gas_NO2_lag_0 double")
    assert [r[0] for r in predictions.eligible_rows(frame, moment(cut)).collect()] == [1]
    assert predictions.eligible_rows(frame.drop("gas_NO2_lag_0"), moment(cut)).count() == 0


def test_bounds_come_from_the_unclipped_value(spark):
    frame = spark.createDataFrame([(1, "CO", -0.5, 0.0), (2, "CO", 1.5, 0.0), (3, "XX", 1.0, None)], "id int, substance_code string, physical_baseline double, residual double")
    intervals = spark.createDataFrame([("CO", -0.2, 0.3)], "substance_code string, lower double, upper double")
    out = {r["id"]: r for r in predictions.add_bounds(frame, intervals).collect()}
    assert (out[1]["predicted_value"], out[1]["lower_bound"], out[1]["upper_bound"]) == (0.0, 0.0, 0.0)
    assert out[2]["predicted_value"] == 1.5 and out[2]["lower_bound"] == pytest.approx(1.3) and out[2]["upper_bound"] == pytest.approx(1.8)
    assert out[3]["predicted_value"] == 0.0 and out[3]["lower_bound"] is None


def test_metrics_and_predictors(spark):
    rows = [("CO", 1, 1.0, 1.0, 0.5, 0.75), ("CO", 1, 2.0, 2.0, 2.5, 2.25), ("NO", 2, 3.0, 3.0, 3.0, 2.0)]
    frame = spark.createDataFrame(rows, "substance_code string, monitoring_post_id int, target_value double, persistence double, physical_baseline double, model double")
    out = {r["substance_code"]: r for r in evaluation.compare_predictors(frame, {"persistence": "persistence", "model": "model", "physical": "physical_baseline"}).collect()}
    assert (out["CO"]["persistence_mae"], out["CO"]["model_mae"], out["CO"]["physical_mae"]) == (0.0, 0.25, 0.5)
    assert out["CO"]["persistence_r2"] == 1.0 and out["NO"]["model_r2"] is None
    sets = {(r["scope"], r["substance_code"], r["monitoring_post_id"]): r["mae"] for r in evaluation.metrics_by_sets(frame, "target_value", "model").collect()}
    assert sets["overall", None, None] == pytest.approx(0.5) and sets["gas", "NO", None] == 1.0 and sets["station", None, 1] == 0.25
    assert evaluation.should_activate(None, 1.0) == (True, "initial_model") and evaluation.should_activate(1.0, 1.0)[0] and not evaluation.should_activate(1.0, 1.1)[0]


def test_weather_payload(spark):
    payload = {"latitude": 55.7, "longitude": 38.1, "hourly": {"time": ["2026-09-25T10:00", "2026-09-25T11:00"], "temperature_2m": [9.5, None], "surface_pressure": [1002.4, 1001.0], "wind_speed_10m": [3.2], "wind_direction_10m": [225.0, 230.0]}}
    table = spark.createDataFrame([(622, json.dumps(payload)), (1, "{}")], "monitoring_post_id long, payload string")
    rows = weather_feed.flatten_payloads(table, "live_forecast").orderBy("bucket_start").collect()
    assert len(rows) == 2 and rows[0]["monitoring_post_id"] == 622 and rows[0]["data_kind"] == "live_forecast"
    assert (rows[0]["atm_press"], rows[0]["hor_win_spd"], rows[0]["hor_win_dir"]) == (1002.4, 3.2, 225.0)
    assert rows[1]["hor_win_spd"] is None and rows[1]["air_temp"] is None and rows[0]["cloud_cover"] is None
    assert rows[0]["bucket_start"].replace(tzinfo=None) == datetime(2026, 9, 25, 10)


def test_feed_retries_and_source(spark, tmp_path):
    tries, slept = [], []

    def get(address):
        tries.append(address)
        if len(tries) < 3:
            raise OSError("down")
        return b'{"ok": 1}'

    assert weather_feed.request_json("http://x", {"a": 1}, get=get, sleep=slept.append) == {"ok": 1}
    assert len(tries) == 3 and slept == [1, 2]
    with pytest.raises(OSError):
        weather_feed.request_json("http://x", {}, get=lambda a: (_ for _ in ()).throw(OSError("down")), sleep=lambda s: None)
    for post in (1, 2):
        (tmp_path / f"{post}.json").write_text(json.dumps({"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2026-01-01T00:00"]}}))
    spark.dataSource.register(weather_feed.WeatherFeed)
    feed = spark.read.format("weather_feed").options(url=f"file://{tmp_path}", posts="[[1, 55.0, 37.0], [2, 56.0, 38.0]]").load()
    assert weather_feed.flatten_payloads(feed, "live_forecast").count() == 2


def test_frame_has_all_features_and_times(spark):
    sf = "/root/testdata/sf0.001"
    frame = frames.local_frame(S.hourly(spark, sf), S.active(spark), S.live(spark, sf))
    whole = baseline.add_baseline(neighbours.add_spatial(frame))
    # 7 statistics, 42 lags, 8 rolling, 2 coordinates, 39 weather, 4 calendar, 10 spatial, the baseline and the gas code.
    assert len(frames.feature_columns(whole, with_post=False)) + 1 == 114
    row = whole.first()
    assert row["data_cutoff"] - row["source_bucket"] == timedelta(hours=1) and row["target_end"] - row["target_start"] == timedelta(hours=1)
    assert whole.count() == S.hourly(spark, sf).count()


def test_weather_roles_and_labels_equal_joins(spark):
    """What the frame takes by leads is what three joins of weather and one of labels give, also past the last hour and for posts without data."""
    sf = "/root/testdata/sf0.001"
    hourly, posts, live = S.hourly(spark, sf), S.active(spark), S.live(spark, sf)
    last = hourly.agg(F.max("bucket_start")).first()[0]
    end = F.lit(last)

    def rows(frame, columns):
        return sorted(map(tuple, frame.select(*columns).collect()), key=repr)

    keys = ["monitoring_post_id", "substance_code", "source_bucket", "target_end"]
    measured = [f"{role}_weather_{m}" for role in ("source", "transport", "target") for m in readings.WEATHER]
    plain = frames.add_weather(frames.add_times(frames.gas_frames(hourly, posts=posts, end=end)), live)
    ahead = frames.local_frame(hourly, posts, live, training=False, end=end)
    assert rows(ahead, keys + measured) == rows(plain, keys + measured) and "target_value" not in ahead.columns
    labelled = frames.add_labels(frames.add_times(frames.gas_frames(hourly).filter(frames.own_gas(frames.DEFAULTS.gases, "_lag_0").isNotNull())), hourly)
    trained = frames.local_frame(hourly, posts, live)
    assert rows(trained, keys + ["target_value"]) == rows(labelled, keys + ["target_value"])


def test_calendar_and_cutoffs(spark):
    rows = [(1, T0), (1, T0 + timedelta(hours=3)), (2, T0 + timedelta(hours=1))]
    hourly = spark.createDataFrame(rows, "monitoring_post_id long, bucket_start timestamp")
    assert frames.calendar(hourly).count() == 5
    posts = spark.createDataFrame([(1,), (2,), (3,)], "monitoring_post_id long")
    assert frames.calendar(hourly, posts, moment(T0 + timedelta(hours=2))).count() == 3 + 2 + 3
    assert current_cutoff(datetime(2026, 1, 1, 10, 55, tzinfo=timezone.utc)) == datetime(2026, 1, 1, 10, tzinfo=timezone.utc)


def test_posts_scans(spark):
    assert {r[0] for r in readings.active_posts(S.posts(spark)).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r[0] for r in readings.located_posts(S.posts(spark)).collect()} == {1, 2, 3, 4, 5}
