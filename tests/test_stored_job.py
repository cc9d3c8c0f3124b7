"""Stored tables and the hourly run: nothing is lost, statuses are kept, fields start from what was stored."""

from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import anchors, field, model
from zephyrframe.plans import job
from zephyrframe.plans.job import Warehouse, moment, with_day
from zephyrframe.settings import Settings
from zephyrframe.sources import frame_store, readings, store

T = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
SMALL = Settings(gases=("NO2",), cell_meters=1000, influence_meters=2000, retention_hours=6, timezone="UTC")
PLACES = {1: (55.75, 37.60), 2: (55.76, 37.62)}


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(k, la, lo, None, "own") for k, (la, lo) in PLACES.items()], "id long, latitude double, longitude double, active_to timestamp, source string")


def hourly_rows(spark, hours, value=0.04):
    rows = [(p, "NO2", T + h * HOUR, value * p) for h in hours for p in PLACES]
    out = spark.createDataFrame(rows, "monitoring_post_id long, substance_code string, bucket_start timestamp, v double")
    same = {m: F.col("v") for m in readings.MEASURES}
    return with_day(out.select(*readings.HOURLY_KEY, *[c.alias(m) for m, c in same.items()], F.lit(12).cast("long").alias("samples_count")))


def weather_rows(spark, hours, at=PLACES, speed=2.0):
    rows = [(p, T + h * HOUR) for h in hours for p in at]
    out = spark.createDataFrame(rows, "monitoring_post_id long, bucket_start timestamp")
    value = {"hor_win_spd": speed, "hor_win_dir": 270.0, "wind_speed_100m": speed, "wind_direction_100m": 270.0, "boundary_layer_height": 600.0, "precipitation": 0.0}
    return out.select("monitoring_post_id", "bucket_start", F.lit("live_forecast").alias("data_kind"), *[F.lit(value.get(c)).cast("double").alias(c) for c in readings.WEATHER])


@pytest.fixture
def house(spark, tmp_path):
    out = Warehouse(spark, str(tmp_path), SMALL)
    store.upsert(spark, f"{out.path}/hourly", hourly_rows(spark, range(-30, 0)), readings.HOURLY_KEY, ("day",))
    out.upsert_weather(weather_rows(spark, range(-31, 4)))
    return out


def plain_rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_narrow_upsert_keeps_the_columns_it_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(spark, path, plain_rows(spark, [(1, 0, 1.0, 9.0), (2, 0, 2.0, 8.0), (3, 1, 3.0, 7.0)], "id int, day int, a double, p95 double"), ("id", "day"), ("day",))
    store.upsert(spark, path, plain_rows(spark, [(1, 0, 5.0), (4, 0, 6.0)], "id int, day int, a double"), ("id", "day"), ("day",))
    got = {r["id"]: (r["a"], r["p95"]) for r in store.read(spark, path).collect()}
    assert got == {1: (5.0, 9.0), 2: (2.0, 8.0), 3: (3.0, 7.0), 4: (6.0, None)}
    store.upsert(spark, path, plain_rows(spark, [(2, 0, "new")], "id int, day int, note string"), ("id", "day"), ("day",))
    r = store.read(spark, path).filter("id = 2").first()
    assert (r["a"], r["p95"], r["note"]) == (2.0, 8.0, "new")


def test_failed_upsert_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(spark, path, plain_rows(spark, [(1, 0, 1.0)], "id int, day int, a double"), ("id",), ("day",))
    bad = spark.range(3).select(F.col("id").cast("int"), F.lit(0).alias("day"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(5.0).alias("a"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(spark, path, bad, ("id",), ("day",))
    assert [tuple(r) for r in store.read(spark, path).select("id", "a").collect()] == [(1, 1.0)]


def test_predictions_go_when_their_whole_day_loses_its_measurements(spark, house, posts):
    house.predict(posts, T, None)
    assert house.table("predictions").count() == 2
    gone = house.table("hourly").filter(F.col("bucket_start") == moment(T - HOUR))
    days = house.table("hourly").select("day").distinct()
    store.rewrite(spark, f"{house.path}/hourly", house.table("hourly").join(gone, list(readings.HOURLY_KEY), "left_anti"), days, ("day",))
    house.remove_unmeasured(T)
    assert not store.exists(spark, f"{house.path}/predictions") or house.table("predictions").count() == 0


def test_statuses(spark, house, posts, monkeypatch):
    seen = []
    mark = Warehouse._mark
    monkeypatch.setattr(Warehouse, "_mark", lambda self, rows, status, error=None: seen.append(status) or mark(self, rows, status, error))

    class Broken:
        metadata = {}

        def predict(self, rows):
            raise RuntimeError("no such feature " + "x" * 5000)

    class Fixed:
        metadata = {"residual_intervals": {"NO2": {"lower": -0.01, "upper": 0.02}}}

        def predict(self, rows):
            return rows.withColumn("residual", F.lit(0.0))

    assert house.predict(posts, T, Broken()) == {"NO2": 0}
    rows = house.table("predictions").collect()
    assert {r["status"] for r in rows} == {"failed"} and all(r["error_message"].startswith("no such feature") and len(r["error_message"]) == 4000 for r in rows)
    assert house.predict(posts, T, None) == {"NO2": 0} and {r["status"] for r in house.table("predictions").collect()} == {"unavailable"}
    assert house.predict(posts, T, Fixed()) == {"NO2": 2}
    rows = house.table("predictions").collect()
    assert {r["status"] for r in rows} == {"ready"} and all(r["predicted_value"] > 0 and r["lower_bound"] <= r["upper_bound"] and r["error_message"] is None for r in rows)
    assert seen == ["running", "failed", "running", "unavailable", "running", "ready"]
    assert house.predict(posts, T + 10 * HOUR, Fixed()) == {"NO2": 0}


def comparable(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("lookback", [24, 72])
def test_one_plan_has_the_rows_of_each_cutoff(spark, house, posts, lookback):
    """Post 2 lacks an hour and post 3 has no row at all; cutoffs have gaps between them and lie beyond the data."""
    settings = replace(SMALL, lookback_hours=lookback)
    table = house.table("hourly").filter((F.col("monitoring_post_id") != 2) | (F.col("bucket_start") != moment(T - 5 * HOUR)))
    live = readings.weather(house.table("weather"), "live_forecast")
    more = posts.unionByName(spark.createDataFrame([(3, 55.7, 37.5, None, "own")], posts.schema))
    active = readings.active_posts(more)
    cutoffs = [T - 9 * HOUR, T - 4 * HOUR, T, T + HOUR]
    one = job.inference_frames(table, active, live, cutoffs, settings)
    each = [job.inference_frame(table, active, live, moment(c), settings) for c in cutoffs]
    assert comparable(one) == sorted((r for e in each for r in comparable(e.select(*one.columns))), key=repr)
    assert one.groupBy("data_cutoff").count().orderBy("data_cutoff").select("count").collect() == [(2,), (1,), (2,)]


def test_catch_up_predicts_all_cutoffs_and_fails_only_those_that_raise(spark, house, posts):
    class Half:
        metadata = {}

        def predict(self, rows):
            if rows.filter(F.col("data_cutoff") == moment(T - HOUR)).count():
                raise RuntimeError("bad hour")
            return rows.withColumn("residual", F.lit(0.0))

    got = house.predict_cutoffs(posts, [T, T - HOUR, T - 2 * HOUR, T + 5 * HOUR], Half())
    assert {datetime.fromisoformat(k): v["NO2"] for k, v in got.items()} == {T - 2 * HOUR: 2, T - HOUR: 0, T: 2, T + 5 * HOUR: 0}
    statuses = {(r["data_cutoff"].replace(tzinfo=timezone.utc), r["status"]) for r in house.table("predictions").collect()}
    assert statuses == {(T - 2 * HOUR, "ready"), (T - HOUR, "failed"), (T, "ready")}


def test_fields_start_from_the_stored_forecast(spark, house, posts):
    """With the earlier hour's forecast stored, an hour alone gives what both hours folded together give."""
    house.build_fields(posts, [T - HOUR, T])
    key = (F.col("data_kind") == "analysis") & (F.col("hour_start") == moment(T - HOUR))
    cells = lambda: {(r["grid_x"], r["grid_y"]): r["value"] for r in frame_store.decode(house.table("frames")).filter(key).collect()}
    both = cells()
    counts = house.build_fields(posts, [T])
    assert cells() == pytest.approx(both) and counts["analysis"] > 0 and counts["forecast"] > 0
    recent = house.table("hourly").filter(F.col("bucket_start") == moment(T - HOUR))
    live = readings.weather(house.table("weather"), "live_forecast")
    alone = field.chain_fields(anchors.analysis_anchors(recent, posts, live), anchors.carried_anchors(recent, posts, live), None, live, SMALL).filter(key)
    assert alone.count() < len(both)  # without the prior the field is the stations' surroundings only


def test_stale_nowcast_is_rebuilt(spark, house, posts):
    house.build_fields(posts, [T - HOUR, T], generated_at=T)
    assert house.missing_cutoffs(posts, T).count() > 0  # earlier hours were never built
    made = house.table("frames").select("substance_code", "hour_start", "data_kind", "generated_at").distinct()
    key = (F.col("hour_start") == moment(T)) & (F.col("data_kind") == "forecast")
    fresh = job.catchup.cutoffs_to_rebuild(expected(spark), made, moment(T))
    old = made.withColumn("generated_at", F.when(key, moment(T - 2 * HOUR)).otherwise(F.col("generated_at")))
    assert fresh.count() == 0
    assert [r[0] for r in job.catchup.cutoffs_to_rebuild(expected(spark), old, moment(T)).select(F.unix_seconds("cutoff")).collect()] == [T.timestamp()]


def expected(spark):
    return spark.createDataFrame([(T - HOUR, "NO2", False)], "bucket_start timestamp, substance_code string, forecast_expected boolean")


def test_station_without_weather_keeps_the_earlier_one(spark, posts):
    h = hourly_rows(spark, [-1])
    live = weather_rows(spark, [-1], speed=3.0).unionByName(weather_rows(spark, [0], at=[1], speed=5.0))
    got = {r["monitoring_post_id"]: r["weather_wind_speed"] for r in anchors.carried_anchors(h, posts, readings.weather(live, "live_forecast")).collect()}
    assert got == {1: 5.0, 2: 3.0}
    assert {r["monitoring_post_id"]: r["weather_wind_speed"] for r in anchors.nowcast_anchors(h, posts, readings.weather(live, "live_forecast")).collect()} == {1: 5.0, 2: None}


def test_emptied_analysis_is_deleted_and_a_nowcast_stays(spark, house, posts):
    house.build_fields(posts, [T])
    hours = house.table("hourly").filter(F.col("bucket_start") != moment(T - HOUR))
    store.rewrite(spark, f"{house.path}/hourly", hours, house.table("hourly").select("day").distinct(), ("day",))
    before = {(r["data_kind"], r["hour"]) for r in house.table("frames").select("data_kind", "hour").distinct().collect()}
    house.build_fields(posts, [T])
    after = {(r["data_kind"], r["hour"]) for r in house.table("frames").select("data_kind", "hour").distinct().collect()}
    assert {k for k, _ in before} == {"analysis", "forecast"} and {k for k, _ in after} == {"forecast"}


def test_lost_and_doubled_cells_are_noticed(spark, house, posts):
    house.build_fields(posts, [T])
    stored = house.table("frames")
    assert frame_store.decode(stored).count() == stored.count()
    one = stored.orderBy("grid_x", "grid_y", "hour_start", "data_kind").limit(1)
    for changed in (stored.exceptAll(one), stored.unionAll(one)):
        with pytest.raises(Exception, match="checksum"):
            frame_store.decode(changed).collect()


def test_hourly_run(spark, tmp_path, posts, caplog):
    house = Warehouse(spark, str(tmp_path), replace(SMALL, catchup_hours=2))
    samples = spark.createDataFrame([(p, "NO2", T - 30 * HOUR + timedelta(minutes=10 * k), 0.05, k) for p in PLACES for k in range(180)], "monitoring_post_id long, substance_code string, timestamp timestamp, value double, id long")
    none = spark.createDataFrame([], "monitoring_post_id long, substance_code string, bucket_start timestamp, value double")
    called = []

    def sync():
        called.append(1)
        house.upsert_weather(weather_rows(spark, range(-31, 4)))
        raise OSError("feed is down")

    report = house.run_due(posts, samples, none, T, None, sync, tie="id")
    assert report["status"] == "completed" and called == [1] and "feed is down" in caplog.text
    assert report["rebuilt_cutoffs"][-1] == T.isoformat() and report["cells"]["analysis"] > 0
    assert set(report["predictions"][T.isoformat()]) == {"NO2"}
    again = house.run_due(posts, samples, none, T, None, sync, tie="id")
    assert again["status"] in ("up_to_date", "completed") and len(again["rebuilt_cutoffs"]) <= len(report["rebuilt_cutoffs"])


def test_model_versions(spark, tmp_path):
    from zephyrframe.operators.boosting import Booster

    rows = spark.createDataFrame([(1.0, 2.0, "NO2")], "x double, y double, substance_code string")
    fitted = Booster(["x"], "y", 1, 2, 0.1).fit(rows)
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        model.Artifact.load(path)
    for k in (1, 2):
        model.Artifact(fitted, ["x"], {"k": k}).save(path)
    rows.write.parquet(f"{path}/v00000003/model")  # a save that was cut off before its metadata
    assert model.versions(spark, path) == [1, 2] and model.Artifact.load(path).metadata == {"k": 2}
