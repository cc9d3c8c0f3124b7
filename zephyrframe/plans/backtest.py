"""Evaluation drivers: models fitted before a time, or without a station, and judged on what follows.

The windows are few (days, fractions, stations), and each fits a model of its own, so
they are looped over on the driver; rows stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.operators import evaluation, model
from zephyrframe.settings import DEFAULTS, Settings

PREDICTORS = {"model": "predicted", "persistence": "persistence", "physical": "physical_baseline"}


def scored_rows(frame: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Labelled rows with a baseline, and the value that persistence predicts."""
    return model.with_correction_target(frame).withColumn("persistence", evaluation.persistence(settings))


def predicted(train: DataFrame, test: DataFrame, settings: Settings) -> DataFrame:
    """Test rows with the prediction of a model fitted on the training rows."""
    return model.evaluate(test, model.fit(train.drop("persistence"), settings))


def by_sets(rows: DataFrame) -> dict:
    """Metrics overall, by gas and by station; one row for each set."""
    found = evaluation.metrics_by_sets(rows, "target_value", "predicted").collect()
    entry = lambda r: {k: r[k] for k in ("n_rows", "mae", "rmse", "r2")}
    return {
        "overall": next(entry(r) for r in found if r["scope"] == "overall"),
        "by_gas": {r["substance_code"]: entry(r) for r in found if r["scope"] == "gas"},
        "by_station": {str(r["monitoring_post_id"]): entry(r) for r in found if r["scope"] == "station"},
    }


def daily_windows(frame: DataFrame, settings: Settings = DEFAULTS) -> dict:
    """The last three days, each by a model of earlier hours, against persistence and the baseline on identical rows."""
    rows = scored_rows(frame, settings).persist()
    try:
        last = rows.agg(F.max("target_start").alias("last_hour"))
        out, tested = [], None
        for window in sorted(evaluation.daily_windows(last).collect()):  # three rows
            train = rows.filter(F.col("target_start") < F.lit(window["train_before"]))
            test = rows.filter((F.col("target_start") >= F.lit(window["start"])) & (F.col("target_start") < F.lit(window["stop"])))
            n = train.count()
            if n < settings.min_train_rows or test.isEmpty():
                raise ValueError(f"too few rows for the window from {window['start']}")
            scored = predicted(train, test, settings).select("substance_code", "target_value", *PREDICTORS.values())
            tested = scored if tested is None else tested.unionByName(scored)
            compared = evaluation.compare_predictors(scored, PREDICTORS).collect()
            out.append({"start": window["start"], "stop": window["stop"], "train_rows": n, "by_gas": [r.asDict() for r in compared]})
        together = evaluation.compare_predictors(tested, PREDICTORS).collect()
        return {"windows": out, "combined_by_gas": [r.asDict() for r in together]}
    finally:
        rows.unpersist()


def rolling_origins(frame: DataFrame, settings: Settings = DEFAULTS) -> list[dict]:
    """A day after each origin by a model of the hours before it; origins with too few rows are left out."""
    rows = scored_rows(frame, settings).persist()
    try:
        out = []
        for origin in sorted(evaluation.rolling_origins(rows).collect()):  # one row for each fraction
            train = rows.filter(F.col("target_start") < F.lit(origin["split_time"]))
            test = rows.filter((F.col("target_start") >= F.lit(origin["split_time"])) & (F.col("target_start") < F.lit(origin["test_end"])))
            n, m = train.count(), test.count()
            if n >= settings.min_train_rows and m:
                out.append({"start": origin["split_time"], "end": origin["test_end"], "train_rows": n, "test_rows": m} | by_sets(predicted(train, test, settings)))
        return out
    finally:
        rows.unpersist()


def station_holdouts(frame: DataFrame, settings: Settings = DEFAULTS) -> dict[str, dict]:
    """Each large enough station's last hours by a model of the other stations' earlier hours."""
    rows = scored_rows(frame, settings).persist()
    try:
        out = {}
        for held in evaluation.station_splits(rows).orderBy("monitoring_post_id").toLocalIterator():
            mine = F.col("monitoring_post_id") == held["monitoring_post_id"]
            train = rows.filter(~mine & (F.col("target_start") < F.lit(held["split_time"])))
            test = rows.filter(mine & (F.col("target_start") >= F.lit(held["split_time"])))
            n, m = train.count(), test.count()
            if n >= settings.min_train_rows and m:
                out[str(held["monitoring_post_id"])] = {"start": held["split_time"], "train_rows": n, "test_rows": m} | by_sets(predicted(train, test, settings))
        return out
    finally:
        rows.unpersist()
