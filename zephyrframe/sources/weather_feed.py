"""The weather feed: JSON documents with one array for each variable."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from zephyrframe.sources.readings import WEATHER

_HOURLY = ", ".join(f"{name}: array<double>" for name in WEATHER.values())
PAYLOAD_SCHEMA = f"latitude double, longitude double, hourly struct<time: array<string>, {_HOURLY}>"


def flatten_payloads(payloads: DataFrame, data_kind: str) -> DataFrame:
    """One row for each time of each payload (monitoring_post_id, payload as JSON text).

    Short or missing arrays give NULL; times without a zone are UTC.
    """
    read = payloads.select("monitoring_post_id", F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    # A missing array would make arrays_zip NULL and drop every row.
    whole = [F.coalesce(F.col(f"p.hourly.{feed}"), F.array().cast("array<double>")).alias(name) for name, feed in WEATHER.items()]
    times = F.coalesce(F.col("p.hourly.time"), F.array().cast("array<string>"))
    listed = read.select("monitoring_post_id", F.col("p.latitude").alias("model_latitude"), F.col("p.longitude").alias("model_longitude"), times.alias("time"), *whole)
    rows = listed.select("monitoring_post_id", "model_latitude", "model_longitude", F.inline(F.arrays_zip("time", *WEATHER)))
    stamped = rows.filter(F.col("time").isNotNull()).withColumn("bucket_start", F.to_utc_timestamp(F.to_timestamp_ntz(F.replace("time", F.lit("Z"), F.lit(""))).cast("timestamp"), F.lit("UTC")))
    return stamped.select("monitoring_post_id", "bucket_start", F.lit(data_kind).alias("data_kind"), "model_latitude", "model_longitude", *WEATHER)


def request_json(url: str, params: dict[str, Any], tries: int = 3, timeout: float = 30, get: Callable | None = None, sleep: Callable = time.sleep) -> dict[str, Any]:
    """A JSON document by GET; waits 1, 2, ... seconds between tries and raises the last error."""
    get = get or (lambda address: urllib.request.urlopen(address, timeout=timeout).read())
    address = url + "?" + urllib.parse.urlencode(params)
    for attempt in range(tries):
        try:
            return json.loads(get(address))
        except Exception:
            if attempt == tries - 1:
                raise
            sleep(attempt + 1)
    raise ValueError("tries must be positive")


class WeatherFeed(DataSource):
    """Payloads for posts, one partition each: options url, posts (JSON list of [id, latitude, longitude]), params (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "weather_feed"

    def schema(self) -> str:
        return "monitoring_post_id long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(dict(self.options))


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in json.loads(self.options["posts"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        post, latitude, longitude = partition.value
        params = json.loads(self.options.get("params", "{}")) | {"latitude": latitude, "longitude": longitude, "hourly": ",".join(WEATHER.values()), "timezone": "UTC"}
        url = self.options["url"]
        if url.startswith("file:"):  # a folder of stored documents stands in for the service
            with open(url.removeprefix("file://") + f"/{post}.json", encoding="utf-8") as f:
                yield (post, f.read())
        else:
            yield (post, json.dumps(request_json(url, params, timeout=float(self.options.get("timeout", 30)))))


def history_span(hourly: DataFrame) -> DataFrame:
    """First and last date that history is wanted for: those of the measurements, the last three hours later."""
    ends = hourly.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b"))
    return ends.select(F.to_date("a").alias("start_date"), F.to_date(F.col("b") + F.expr("INTERVAL 3 HOURS")).alias("end_date"))
