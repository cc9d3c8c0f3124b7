"""The hourly job end to end over stored tables, and the learned correction."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from zephyrframe import cli
from zephyrframe.operators import baseline, frames, model, neighbours
from zephyrframe.plans import samples as S
from zephyrframe.plans.job import Warehouse, moment, training_frame
from zephyrframe.settings import Settings
from zephyrframe.sources import readings

SF = "/root/testdata/sf0.01"
CUTOFF = datetime(2024, 1, 20, 6, tzinfo=timezone.utc)
FAST = Settings(iterations=20, depth=2, cell_meters=1000, retention_hours=3, gases=("NO2", "O3"))


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")), FAST)
    aggregated = readings.aggregated_readings(S.readings(spark, SF), FAST.gases)
    house.refresh_hourly(S.samples(spark, SF).drop("event_id"), aggregated, CUTOFF)
    live = S.weather(spark, SF).filter(F.col("bucket_start").between(moment(CUTOFF - timedelta(hours=80)), moment(CUTOFF + timedelta(hours=5))))
    house.upsert_weather(live)
    return house


def test_refresh_writes_the_window_and_is_repeatable(spark, house):
    table = house.table("hourly")
    n = table.count()
    ends = table.agg(F.min("bucket_start"), F.max("bucket_start")).select(*[F.unix_seconds(c) for c in table.agg(F.min("bucket_start"), F.max("bucket_start")).columns]).first()
    assert ends[0] >= (CUTOFF - timedelta(hours=72)).timestamp() and ends[1] < CUTOFF.timestamp() and n > 500
    house.refresh_hourly(S.samples(spark, SF).drop("event_id"), readings.aggregated_readings(S.readings(spark, SF), FAST.gases), CUTOFF)
    again = house.table("hourly")
    assert again.count() == n and again.select(*readings.HOURLY_KEY).distinct().count() == n
    assert again.filter("hourly_min < 0 or filtered_hourly_mean < 0").count() == 0


def test_predictions_and_fields(spark, house, tmp_path):
    posts = S.posts(spark)
    house.predict(posts, CUTOFF, None)
    first = house.table("predictions")
    assert {r[0] for r in first.select("status").distinct().collect()} == {"unavailable"} and first.filter("predicted_value is not null").count() == 0
    eligible = first.count()
    frame = training_frame(house.table("hourly"), S.active(spark), readings.weather(house.table("weather"), "historical_forecast"), FAST)
    small = Settings(iterations=20, depth=2, min_train_rows=48, gases=FAST.gases)
    artifact, report = model.train(frame, None, small)
    assert report["activated"] and report["activation_reason"] == "initial_model" and set(report["metrics"]["by_gas"]) <= {"NO2", "O3"}
    assert model.train(frame, 0.0, small)[1]["activation_reason"] == "candidate_mae_is_worse"
    with pytest.raises(ValueError):
        model.train(frame.limit(3), None, small)
    artifact.save(str(tmp_path / "model"))
    back = model.Artifact.load(str(tmp_path / "model"))
    assert back.features == artifact.features and model.compatible(back, small) and not model.compatible(None) and not model.compatible(back, Settings())
    house.predict(posts, CUTOFF, back)
    ready = house.table("predictions").filter("status = 'ready'")
    assert ready.count() == eligible and ready.filter("predicted_value < 0 or lower_bound > upper_bound").count() == 0
    house.build_fields(posts, [CUTOFF])
    stored = house.table("frames")
    kinds = {(r[0], r[1]) for r in stored.select("data_kind", "substance_code").distinct().collect()}
    assert kinds == {(k, g) for k in ("analysis", "forecast") for g in FAST.gases}
    n = stored.count()
    house.build_fields(posts, [CUTOFF])
    assert house.table("frames").count() == n
    assert house.missing_cutoffs(posts, CUTOFF).count() >= 0


def test_inference_frame_lacks_labels_and_keeps_eligible_rows(spark, house):
    from zephyrframe.plans.job import inference_frame

    rows = inference_frame(house.table("hourly"), S.active(spark), readings.weather(house.table("weather"), "live_forecast"), moment(CUTOFF), FAST)
    assert "target_value" not in rows.columns and rows.filter(F.col("data_cutoff") != moment(CUTOFF)).count() == 0
    assert set(neighbours.SPATIAL) <= set(rows.columns) and "physical_baseline" in rows.columns
    assert frames.feature_columns(rows, with_post=False) and baseline.DECAY["CO"] == 0.01


def test_command_line(spark, house, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("ZEPHYR_GASES", "NO2,O3")
    monkeypatch.setenv("ZEPHYR_CELL_METERS", "1000")
    monkeypatch.setenv("ZEPHYR_RETENTION_HOURS", "1")
    S.posts(spark).write.parquet(str(tmp_path / "posts"))
    assert cli.load_model(str(tmp_path)) is None
    report = cli.main(["run", "--warehouse", house.path, "--posts", str(tmp_path / "posts"), "--cutoff", CUTOFF.isoformat()])
    assert report["status"] == "completed" and len(report["rebuilt_cutoffs"]) == 1 and "rebuilt_cutoffs" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
