from datetime import datetime, timedelta, timezone

from zephyrframe.operators import catchup
from zephyrframe.plans.job import moment

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
H = timedelta(hours=1)


def rebuilt(spark, expected, existing, due):
    e = spark.createDataFrame(expected, "bucket_start timestamp, substance_code string, forecast_expected boolean")
    x = spark.createDataFrame(existing, "hour_start timestamp, data_kind string, substance_code string, generated_at timestamp")
    rows = catchup.cutoffs_to_rebuild(e, x, moment(due)).orderBy("cutoff").collect()
    return [r[0].astimezone(timezone.utc) if r[0].tzinfo else r[0].replace(tzinfo=timezone.utc) for r in rows]


def chain(hours, gas="CO", generated=T0):
    return [x for h in hours for x in ((T0 + h * H, "analysis", gas, generated), (T0 + (h + 1) * H, "forecast", gas, generated), (T0 + (h + 2) * H, "forecast", gas, generated))]


def test_suffix_is_rebuilt_from_the_first_missing(spark):
    expected = [(T0 + h * H, "CO", True) for h in range(4)]
    existing = [x for x in chain(range(4)) if not (x[1] == "analysis" and x[0] == T0 + H)]
    assert rebuilt(spark, expected, existing, T0 + 4 * H) == [T0 + 2 * H, T0 + 3 * H, T0 + 4 * H]


def test_nothing_is_missing(spark):
    expected = [(T0 + h * H, "CO", True) for h in range(3)]
    assert rebuilt(spark, expected, chain(range(3)), T0 + 3 * H) == []


def test_forecasts_are_wanted_only_where_predicted(spark):
    existing = [(T0, "analysis", "CO", T0), (T0 + H, "forecast", "CO", T0)]
    assert rebuilt(spark, [(T0, "CO", False)], existing, T0 + H) == []
    assert rebuilt(spark, [(T0, "CO", True)], existing, T0 + H) == [T0 + H]


def test_stale_nowcast_counts_at_the_due_cutoff_only(spark):
    existing = [(T0, "analysis", "CO", T0 + H), (T0 + H, "forecast", "CO", T0)]
    assert rebuilt(spark, [(T0, "CO", False)], existing, T0 + H) == [T0 + H]
    assert rebuilt(spark, [(T0, "CO", False)], existing, T0 + 5 * H) == []
