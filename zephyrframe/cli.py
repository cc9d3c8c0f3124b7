"""Command line of the hourly job over stored tables.

    python -m zephyrframe.cli refresh --warehouse PATH --samples PATH --aggregated PATH [--cutoff T] [--full]
    python -m zephyrframe.cli weather --warehouse PATH --posts PATH --url URL (--live | --history)
    python -m zephyrframe.cli train --warehouse PATH --posts PATH
    python -m zephyrframe.cli evaluate --warehouse PATH --posts PATH [--holdouts]
    python -m zephyrframe.cli run --warehouse PATH --posts PATH --samples PATH --aggregated PATH [--url URL] [--train-if-missing]
    python -m zephyrframe.cli run --warehouse PATH --posts PATH --cutoff T [--train-if-missing]

`run` refreshes, finds missing cutoffs, syncs live weather, predicts and builds fields;
with a cutoff it predicts and builds that one alone.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from zephyrframe.operators import model
from zephyrframe.plans import backtest
from zephyrframe.plans.job import Warehouse, current_cutoff, training_frame
from zephyrframe.settings import Settings
from zephyrframe.sources import readings, weather_feed


def parser() -> argparse.ArgumentParser:
    """The options of all commands."""
    top = argparse.ArgumentParser(prog="zephyrframe")
    top.add_argument("command", choices=["refresh", "weather", "train", "evaluate", "run"])
    top.add_argument("--warehouse", required=True)
    for name in ("--samples", "--aggregated", "--posts", "--url", "--cutoff", "--start-date", "--end-date"):
        top.add_argument(name)
    for name in ("--full", "--live", "--history", "--holdouts", "--train-if-missing"):
        top.add_argument(name, action="store_true")
    return top


def load_model(path: str) -> model.Artifact | None:
    """The current model, or None where none was stored."""
    try:
        return model.Artifact.load(f"{path}/model")
    except FileNotFoundError:
        return None


def sync_weather(house: Warehouse, posts: DataFrame, url: str, kind: str, params: dict) -> None:
    """Fetch weather of all located posts, one request and partition each, and upsert it."""
    places = [[r[0], r[1], r[2]] for r in readings.located_posts(posts).collect()]  # one request each
    house.spark.dataSource.register(weather_feed.WeatherFeed)
    options = {"url": url, "posts": json.dumps(places), "params": json.dumps(params), "timeout": house.settings.feed_timeout_seconds}
    house.upsert_weather(weather_feed.flatten_payloads(house.spark.read.format("weather_feed").options(**options).load(), kind))


LIVE = ("live_forecast", {"past_days": 2, "forecast_days": 3})


def features(house: Warehouse, posts: DataFrame) -> DataFrame:
    """The labelled training frame of the stored tables."""
    return training_frame(house.table("hourly"), readings.active_posts(posts), readings.weather(house.table("weather"), "historical_forecast"), house.settings)


def train(house: Warehouse, posts: DataFrame) -> dict:
    """Fit a candidate and store it if it may replace the current model; a model of another contract doesn't compete."""
    current = load_model(house.path)
    mae = current.metadata["metrics"]["overall"]["mae"] if model.compatible(current, house.settings) else None
    artifact, found = model.train(features(house, posts), mae, house.settings)
    if artifact is not None:
        artifact.save(f"{house.path}/model")
    return found


def main(arguments: list[str] | None = None) -> dict:
    """Run one command; prints and returns its report."""
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("zephyrframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = Settings.from_environment()
    house = Warehouse(spark, given.warehouse, settings)
    cutoff = datetime.fromisoformat(given.cutoff) if given.cutoff else current_cutoff(settings=settings)
    posts = spark.read.parquet(given.posts) if given.posts else None
    url = given.url or settings.feed_url
    report: dict = {"status": "completed", "data_cutoff": cutoff.isoformat()}
    if given.command == "refresh":
        house.refresh_hourly(spark.read.parquet(given.samples), spark.read.parquet(given.aggregated), cutoff, given.full)
    elif given.command == "weather":
        kind, params = LIVE
        if not given.live:
            span = weather_feed.history_span(house.table("hourly")).first()
            kind, params = "historical_forecast", {"start_date": given.start_date or str(span["start_date"]), "end_date": given.end_date or str(span["end_date"])}
        sync_weather(house, posts, url, kind, params)
    elif given.command == "train":
        report |= train(house, posts)
    elif given.command == "evaluate":
        frame = features(house, posts)
        if given.holdouts:
            report |= {"rolling_windows": backtest.rolling_origins(frame, settings), "station_holdouts": backtest.station_holdouts(frame, settings)}
        else:
            report |= backtest.daily_windows(frame, settings)
    else:
        if given.train_if_missing and not model.compatible(load_model(given.warehouse), settings):
            report["training"] = train(house, posts)
        artifact = load_model(given.warehouse)
        if given.cutoff:
            report |= house.run_cutoffs(posts, [cutoff], artifact)
        else:
            sync = (lambda: sync_weather(house, posts, url, *LIVE)) if url else None
            report |= house.run_due(posts, spark.read.parquet(given.samples), spark.read.parquet(given.aggregated), cutoff, artifact, sync)
    print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
    return report


if __name__ == "__main__":
    main()
