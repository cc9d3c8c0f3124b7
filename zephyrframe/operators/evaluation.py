"""Splits, windows and metrics of forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.operators.frames import own_gas
from zephyrframe.operators.quantiles import group_quantiles
from zephyrframe.settings import DEFAULTS, Settings


def regression_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates mae, rmse and r2 = 1 - SSE / SST.

    NULL r2 for fewer than two rows; constant actual values give 1 without error and else 0.
    """
    error = actual - predicted
    sse = F.sum(error * error)
    n = F.count(error)
    constant = F.min(actual) == F.max(actual)
    r2 = F.when(n > 1, F.when(constant, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, F.var_pop(actual) * n)))
    return {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "r2": r2}


def metrics_by_sets(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Metrics overall, by gas and by station, in one pass by grouping sets.

    scope is "overall", "gas" or "station".
    """
    sets = [[], [F.col("substance_code")], [F.col("monitoring_post_id")]]
    found = regression_metrics(F.col(actual), F.col(predicted))
    out = frame.groupingSets(sets, "substance_code", "monitoring_post_id").agg(
        F.grouping("substance_code").alias("__g"), F.grouping("monitoring_post_id").alias("__s"), F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in found.items()]
    )
    scope = F.when(F.col("__g") == 0, "gas").when(F.col("__s") == 0, "station").otherwise("overall")
    return out.select(scope.alias("scope"), "substance_code", "monitoring_post_id", "n_rows", *found)


def compare_predictors(frame: DataFrame, predictors: Mapping[str, str], actual: str = "target_value") -> DataFrame:
    """For each gas the metrics of several predictors on identical rows."""
    found = [c.alias(f"{name}_{k}") for name, column in predictors.items() for k, c in regression_metrics(F.col(actual), F.col(column)).items()]
    return frame.groupBy("substance_code").agg(F.count(F.lit(1)).alias("n_rows"), *found)


def residual_intervals(frame: DataFrame, actual: str, predicted: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """lower and upper quantile of actual - predicted for each gas."""
    residuals = frame.select("substance_code", (F.col(actual) - F.col(predicted)).alias("residual"))
    found = group_quantiles(residuals, ["substance_code"], "residual", [low, high], write=True)
    return found.select("substance_code", F.col("quantiles")[0].alias("lower"), F.col("quantiles")[1].alias("upper"))


def persistence(settings: Settings = DEFAULTS) -> Column:
    """The last value of the row's own gas."""
    return own_gas(settings.gases, "_lag_0")


def chronological_split(frame: DataFrame, test_fraction: float) -> DataFrame:
    """The first target time of the test rows: split_time, n_hours, from the ordinal of distinct hours.

    Distinct hours are few (time, not rows), so their numbering may run in one task.
    """
    hours = frame.select("target_start").filter("target_start is not null").distinct()
    ranked = hours.withColumn("k", F.row_number().over(Window.orderBy("target_start")) - 1).withColumn("n_hours", F.count("*").over(Window.partitionBy()))
    index = F.greatest(F.lit(1), F.least(F.col("n_hours") - 1, F.floor(F.col("n_hours") * (1.0 - test_fraction))))
    return ranked.filter((F.col("k") == index) & (F.col("n_hours") >= 2)).select(F.col("target_start").alias("split_time"), "n_hours")


def assign_split(frame: DataFrame, test_fraction: float) -> DataFrame:
    """A frame with is_test; needs two distinct hours at least, else no row is returned."""
    split = F.broadcast(chronological_split(frame, test_fraction).select("split_time"))
    return frame.filter("target_start is not null").join(split).withColumn("is_test", F.col("target_start") >= F.col("split_time")).drop("split_time")


def daily_windows(last_hour: DataFrame, count: int = 3) -> DataFrame:
    """The last days before the hour after `last_hour` (one row): window_no, train_before, start, stop, with an hour of embargo."""
    end = shift_hours(F.col("last_hour"), 1)
    number = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = last_hour.select(number.alias("window_no"), end.alias("end"))
    start = shift_hours(F.col("end"), -24 * (F.lit(count) - F.col("window_no")))
    rows = rows.withColumn("start", start)
    return rows.select("window_no", shift_hours(F.col("start"), -1).alias("train_before"), "start", shift_hours(F.col("start"), 24).alias("stop"))


def window_sizes(frame: DataFrame, windows: DataFrame) -> DataFrame:
    """train_rows and test_rows of each window; the windows are a few rows, so the frame is scanned once."""
    t = F.col("target_start")
    joined = frame.select("target_start").join(F.broadcast(windows), (t < F.col("train_before")) | ((t >= F.col("start")) & (t < F.col("stop"))))
    return joined.groupBy("window_no").agg(F.count_if(t < F.col("train_before")).alias("train_rows"), F.count_if((t >= F.col("start")) & (t < F.col("stop"))).alias("test_rows"))


def rolling_origins(frame: DataFrame, fractions: Sequence[float] = (0.45, 0.60, 0.72), hours: int = 24) -> DataFrame:
    """fraction, split_time, test_end: origins at fractions of the distinct hours, each with a day of hours to test."""
    distinct = frame.select("target_start").filter("target_start is not null").distinct()
    ranked = distinct.withColumn("k", F.row_number().over(Window.orderBy("target_start")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    last = F.max(F.struct("k", "target_start")).over(Window.orderBy("k").rowsBetween(0, hours - 1))
    ranked = ranked.withColumn("test_end", shift_hours(last["target_start"], 1))
    picked = ranked.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    index = F.least(F.col("n") - 2, F.greatest(F.lit(1), F.floor(F.col("n") * F.col("fraction"))))
    return picked.filter(F.col("k") == index).select("fraction", F.col("target_start").alias("split_time"), "test_end")


def station_splits(frame: DataFrame, min_rows: int = 100, min_hours: int = 12, share: float = 0.8) -> DataFrame:
    """monitoring_post_id, split_time: the hour at `share` of a station's distinct hours, for stations large enough."""
    hours = frame.groupBy("monitoring_post_id", "target_start").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("monitoring_post_id")
    ranked = hours.withColumn("k", F.row_number().over(mine.orderBy("target_start")) - 1).withColumns({"n_hours": F.count("*").over(mine), "n_rows": F.sum("n").over(mine)})
    index = F.greatest(F.lit(1), F.floor(F.col("n_hours") * share))
    return ranked.filter((F.col("k") == index) & (F.col("n_rows") >= min_rows) & (F.col("n_hours") >= min_hours)).select("monitoring_post_id", F.col("target_start").alias("split_time"))


def should_activate(current_mae: float | None, candidate_mae: float) -> tuple[bool, str]:
    """Whether a candidate model replaces the current one."""
    if current_mae is None:
        return True, "initial_model"
    return (True, "quality_not_worse") if candidate_mae <= current_mae else (False, "candidate_mae_is_worse")
