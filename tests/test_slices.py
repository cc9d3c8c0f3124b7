"""Series in slices and quantiles by rank selection, against plain Python and windows over whole series."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.operators import hourly
from zephyrframe.operators.quantiles import group_quantiles

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def whole_series(samples):
    """Segments and medians by windows over whole series."""
    series = Window.partitionBy(*hourly.SERIES)
    ordered = series.orderBy("timestamp", "id")
    micros = F.unix_micros("timestamp")
    out = samples.withColumn("delta_s", (micros - F.lag(micros).over(ordered)) / 1e6)
    out = out.withColumn("cadence_s", F.median(F.when(F.col("delta_s") > 0, F.col("delta_s"))).over(series))
    begins = F.when(F.col("delta_s") > 3 * F.col("cadence_s"), 1).otherwise(0)
    out = out.withColumn("segment", F.sum(begins).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.collect_list("value").over(Window.partitionBy(*hourly.SERIES, "segment").orderBy("timestamp", "id").rowsBetween(-2, 0))
    return out.withColumn("last", last)


def series_rows(seed):
    """Sparse and dense series, gaps that cover slices, slices of one sample, equal instants, one sample alone."""
    r = random.Random(seed)
    rows, k = [], 0
    for post, n, step in ((1, 400, 60), (2, 60, 9000), (3, 40, 40_000), (4, 1, 1), (5, 2, 90_000)):
        at = START
        for _ in range(n):
            at += timedelta(seconds=r.choice([0, step, step, step, step * r.random(), step * 4, step * 30 if r.random() < 0.1 else step]))
            rows.append((post, "CO", at, r.random(), k))
            k += 1
    return rows


@pytest.mark.parametrize("seed, hours", [(1, 6), (2, 1), (3, 48)])
def test_slices_give_what_whole_series_give(spark, seed, hours, monkeypatch):
    monkeypatch.setattr(hourly, "SLICE_HOURS", hours)
    samples = spark.createDataFrame(series_rows(seed), "monitoring_post_id long, substance_code string, timestamp timestamp, value double, id long").repartition(5)
    want = {r["id"]: r for r in whole_series(samples).collect()}
    got = hourly.causal_median(samples, "id").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["id"]]
        assert (r["delta_s"], r["cadence_s"], r["segment"]) == (w["delta_s"], w["cadence_s"], w["segment"])
        assert r["filtered_value"] == pytest.approx(float(np.median(w["last"])), abs=1e-12)
    assert {r["id"]: r["segment"] for r in hourly.segments(samples, "id").collect()} == {k: w["segment"] for k, w in want.items()}


def test_a_hot_series_is_spread_over_tasks(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).cast("long").alias("monitoring_post_id"), F.lit("CO").alias("substance_code"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("timestamp"), F.rand(1).alias("value"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    # Adaptive execution may read the last shuffle by mapper, which says nothing of the windows' tasks.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = hourly.causal_median(rows, "id").filter("monitoring_post_id = 1").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").agg(F.count("*").alias("count"), F.sum("filtered_value"), F.sum("segment")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 54_000 and len(sizes) >= 16 and max(sizes) < 54_000 / 6


def test_quantiles_are_exact(spark):
    r = random.Random(7)
    groups = {
        "many": [r.gauss(0, 1) for _ in range(3000)], "equal": [2.5] * 50, "one": [-7.0], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-12, 12) for _ in range(501)],
        "near": [1 + r.random() * 1e-9 for _ in range(300)], "few": [float(r.randrange(3)) for _ in range(100)], None: [1.0, 2.0, 4.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan")), ("none", None)]
    probabilities = [0.0, 0.05, 0.5, 0.77, 0.95, 1.0]
    found = group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", probabilities).collect()
    assert {x["g"] for x in found} == set(groups)
    for x in found:
        assert x["quantiles"] == pytest.approx([float(np.quantile(groups[x["g"]], p)) for p in probabilities], rel=1e-12, abs=1e-300)


def test_no_rows_no_groups(spark):
    assert group_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
    assert hourly.causal_median(spark.createDataFrame([], "monitoring_post_id long, substance_code string, timestamp timestamp, value double")).count() == 0
