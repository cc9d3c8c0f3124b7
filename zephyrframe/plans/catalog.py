"""The registered queries of the engine's operators, with DuckDB SQL where SQL can express them.

Instants are reported as hours since the epoch, floating-point values rounded to
six places (sums depend on the order of rows in the last ones).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.functions import expressions as X
from zephyrframe.operators import anchors, baseline, catchup, evaluation, field, frames, grid, hourly, model, neighbours, predictions, weather
from zephyrframe.plans import samples as S
from zephyrframe.plans.oracles import GASES, MEASURES, oracle
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources import readings, store, weather_feed
from zephyrframe.sources.frame_store import expired

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Hours that queries with a fixed time use: 2024-01-10 00:00 and 2024-01-20 06:00.
FROM_HOUR, CUTOFF_HOUR = 473_352, 473_598
STEP = 500.0
CORE = Settings(gases=GASES)


def query(sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *parts)
        return f

    return add


def at(hour: int) -> Column:
    """The instant of an hour number."""
    return F.timestamp_seconds(F.lit(hour * 3600))


#: Means of two-place decimals may lie halfway between six-place decimals, and the order of a sum decides
#: where such a value goes; a small shift before rounding decides it the same way in both engines.
OFF_TIES = 1e-7


def shown(df: DataFrame, **hours: str) -> DataFrame:
    """Instants as hour numbers (by keyword: new name and old) and floats rounded."""
    df = df.withColumns({n: S.hour_number(F.col(o)) for n, o in hours.items()}) if hours else df
    df = df.drop(*[o for n, o in hours.items() if o not in hours])
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.select(*[F.round(F.col(c).cast("double") + OFF_TIES, 6).alias(c) if c in floats else F.col(c) for c in df.columns])


def r(*columns: str) -> str:
    """SQL that rounds columns under their names."""
    return ", ".join(f"round({c.split(' AS ')[0]} + {OFF_TIES!r}::DOUBLE, 6) AS {c.split(' AS ')[-1]}" for c in columns)


KEYS = "post AS monitoring_post_id, code AS substance_code"

# --- ingest ---------------------------------------------------------------


@query(f"SELECT {KEYS}, us // 1000 AS ms, {r('v AS value')} FROM smp WHERE us // 3600000000 >= {FROM_HOUR} AND us // 3600000000 < {CUTOFF_HOUR}", "smp")
def raw_scan_filter(spark, sf_dir):
    kept = readings.within(S.samples(spark, sf_dir), "timestamp", at(FROM_HOUR), at(CUTOFF_HOUR))
    return shown(hourly.unsigned(kept).select("monitoring_post_id", "substance_code", F.floor(F.unix_micros("timestamp") / 1000).alias("ms"), "value"))


@query(
    f"""SELECT d.id % 4 + 1 AS monitoring_post_id, code AS substance_code, us // 1000 AS ms, {r('v AS value')} FROM ev
    JOIN (SELECT id AS did, (id % 9) AS id FROM generate_series(0, 35) t(id)) d ON d.did = ev.event_id % 40 WHERE d.id < 8 AND v IS NOT NULL AND code IS NOT NULL
    AND us // 1000 >= {FROM_HOUR}::BIGINT * 3600000 AND us // 1000 < {CUTOFF_HOUR}::BIGINT * 3600000""",
    "ev",
)
def sensor_chain_join(spark, sf_dir):
    found = readings.raw_samples(*S.sensor_tables(spark, sf_dir), FROM_HOUR * 3_600_000, CUTOFF_HOUR * 3_600_000)
    return shown(found.select("monitoring_post_id", "substance_code", F.floor(F.unix_micros("timestamp") / 1000).alias("ms"), "value"))


@query(f"SELECT {KEYS}, (us + 19800000000) // 3600000000 * 3600 - 19800 AS bucket_s, count(*) AS n FROM smp GROUP BY ALL", "smp")
def hour_bucket_local(spark, sf_dir):
    # A zone off by half an hour: local hours begin between hours of UTC.
    bucket = F.floor(F.unix_micros(X.local_hour(F.col("timestamp"), "Asia/Kolkata")) / 1_000_000).alias("bucket_s")
    return S.samples(spark, sf_dir).groupBy("monitoring_post_id", "substance_code", bucket).agg(F.count("*").alias("n"))


@query(f"SELECT {KEYS}, event_id, {r('delta AS delta_s', 'cadence AS cadence_s')}, segment::BIGINT AS segment FROM seg", "seg")
def segment_ids(spark, sf_dir):
    out = hourly.segments(hourly.unsigned(S.samples(spark, sf_dir)), "event_id")
    return shown(out.select("monitoring_post_id", "substance_code", "event_id", "delta_s", "cadence_s", "segment"))


@query(f"SELECT {KEYS}, event_id, {r('f AS filtered_value')} FROM med", "med")
def causal_median(spark, sf_dir):
    out = hourly.causal_median(hourly.unsigned(S.samples(spark, sf_dir)), "event_id")
    return shown(out.select("monitoring_post_id", "substance_code", "event_id", "filtered_value"))


@query(f"SELECT {KEYS}, h AS hour, {r(*MEASURES)}, samples_count FROM internal", "internal")
def hourly_features(spark, sf_dir):
    return shown(hourly.build_hourly(S.samples(spark, sf_dir), tie="event_id"), hour="bucket_start")


@query(f"SELECT {KEYS}, h AS hour, {r('v AS raw_hourly_mean', 'v AS hourly_p95')}, 0.0 AS hourly_std, 1 AS samples_count FROM rds WHERE code = upper(code)", "rds")
def preagg_features(spark, sf_dir):
    coming = readings.aggregated_readings(S.readings(spark, sf_dir), GASES)
    return shown(hourly.from_aggregated(coming), hour="bucket_start").select("monitoring_post_id", "substance_code", "hour", "raw_hourly_mean", "hourly_p95", "hourly_std", "samples_count")


@query(f"SELECT {KEYS}, h AS hour, {r('filtered_hourly_mean')}, samples_count FROM hourly", "hourly")
def union_sources(spark, sf_dir):
    return shown(S.hourly(spark, sf_dir), hour="bucket_start").select("monitoring_post_id", "substance_code", "hour", "filtered_hourly_mean", "samples_count")


@query(
    f"""SELECT {KEYS}, h AS hour, {r('v AS filtered_hourly_mean')} FROM (
    SELECT post, code, h, filtered_hourly_mean + 1000 AS v FROM hourly WHERE h % 3 = 0 UNION ALL SELECT post, code, h, filtered_hourly_mean FROM hourly WHERE h % 3 <> 0)""",
    "hourly",
)
def upsert_hourly(spark, sf_dir):
    stored = S.hourly(spark, sf_dir)
    n = S.hour_number(F.col("bucket_start"))
    new = stored.filter(n % 3 == 0).withColumn("filtered_hourly_mean", F.col("filtered_hourly_mean") + 1000)
    out = store.latest_by_key(readings.HOURLY_KEY, stored.filter(n % 4 != 3), stored.filter(n % 4 == 3), new)
    return shown(out.select(*readings.HOURLY_KEY, "filtered_hourly_mean"), hour="bucket_start")


@query(
    f"""SELECT {KEYS}, h AS hour, {r('CASE WHEN neg THEN abs(a) ELSE a END AS raw_hourly_mean', 'CASE WHEN NOT neg THEN lo WHEN lo < 0 AND hi > 0 THEN 0 ELSE least(abs(lo), abs(hi)) END AS hourly_min',
    'CASE WHEN neg THEN greatest(abs(lo), abs(hi)) ELSE hi END AS hourly_max')} FROM (
    SELECT post, code, us // 3600000000 AS h, avg(v) AS a, min(v) AS lo, max(v) AS hi, least(avg(v), min(v)) < 0 AS neg FROM ev WHERE code IS NOT NULL AND v IS NOT NULL GROUP BY ALL)""",
    "ev",
)
def normalize_negatives(spark, sf_dir):
    s = S.samples(spark, sf_dir)
    signed = hourly.aggregate_hours(s.withColumn("filtered_value", F.col("value")))
    return shown(store.normalize_negatives(signed).select(*readings.HOURLY_KEY, "raw_hourly_mean", "hourly_min", "hourly_max"), hour="bucket_start")


@query(f"SELECT {KEYS}, h AS hour, {r(*MEASURES)}, samples_count FROM hourly WHERE h >= {FROM_HOUR} AND h < {CUTOFF_HOUR}", "hourly")
def hourly_scan(spark, sf_dir):
    return shown(readings.hourly_features(S.hourly(spark, sf_dir), at(FROM_HOUR), at(CUTOFF_HOUR)), hour="bucket_start")


@query(f"SELECT post AS monitoring_post_id, {r('lat AS latitude', 'lon AS longitude')} FROM plc WHERE NOT retired AND lat IS NOT NULL", "plc")
def located_posts(spark, sf_dir):
    return shown(readings.located_posts(S.places(spark, sf_dir)))


@query(f"SELECT post AS monitoring_post_id, h AS hour, {r('hor_win_spd', 'precipitation')} FROM wxx WHERE kind = 'historical_forecast' AND h >= {FROM_HOUR} AND h < {CUTOFF_HOUR}", "wxx")
def weather_scan(spark, sf_dir):
    found = readings.weather(S.weather(spark, sf_dir), "historical_forecast", at(FROM_HOUR), at(CUTOFF_HOUR), ("hor_win_spd", "precipitation"))
    return shown(found, hour="bucket_start")


@query("SELECT min(h) // 24 AS start_day, (max(h) + 3) // 24 AS end_day FROM hourly", "hourly")
def history_span(spark, sf_dir):
    span = weather_feed.history_span(S.hourly(spark, sf_dir))
    return span.select(*[F.unix_date(f"{c}_date").cast("long").alias(f"{c}_day") for c in ("start", "end")])


def _weather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with an hour's number and what a payload has of it."""
    w = S.live(spark, sf_dir).join(S.posts(spark).select(F.col("id").alias("monitoring_post_id"), "latitude", "longitude"), "monitoring_post_id")
    n = S.hour_number(F.col("bucket_start"))
    return w.select("monitoring_post_id", "latitude", "longitude", n.alias("n"), F.struct(n.alias("h"), F.date_format(F.to_utc_timestamp(F.timestamp_seconds(n * 3600), F.current_timezone()), "yyyy-MM-dd'T'HH:mm").alias("t"), "air_temp", "hor_win_spd").alias("x"))


def _flattened(rows: DataFrame, *part: str) -> DataFrame:
    """One payload for each post and part, flattened again."""
    packed = rows.groupBy("monitoring_post_id", "latitude", "longitude", *part).agg(F.sort_array(F.collect_list("x")).alias("x"))
    hours = F.struct(F.col("x.t").alias("time"), F.col("x.air_temp").alias("temperature_2m"), F.slice(F.col("x.hor_win_spd"), 1, 5).alias("wind_speed_10m"))
    payload = F.to_json(F.struct("latitude", "longitude", hours.alias("hourly")), {"ignoreNullFields": "false"})
    flat = weather_feed.flatten_payloads(packed.select("monitoring_post_id", payload.alias("payload")), "live_forecast")
    return shown(flat.select("monitoring_post_id", "bucket_start", "air_temp", "hor_win_spd", "model_latitude"), hour="bucket_start")


@query(
    f"""SELECT post AS monitoring_post_id, h AS hour, {r('air_temp', 'CASE WHEN k <= 5 THEN hor_win_spd END AS hor_win_spd', 'lat AS model_latitude')} FROM (
    SELECT *, row_number() OVER (PARTITION BY post, h // 24 ORDER BY h) AS k FROM wx) JOIN pst USING (post)""",
    "wx",
    "pst",
)
def weather_json_flatten_all(spark, sf_dir):
    """All hours, in one such payload for each post and day."""
    return _flattened(_weather_rows(spark, sf_dir).withColumn("day", F.expr("n div 24")), "day")


# --- features ---------------------------------------------------------------


@query("SELECT post AS monitoring_post_id, h AS hour FROM cal", "cal")
def dense_calendar(spark, sf_dir):
    return shown(frames.calendar(S.hourly(spark, sf_dir)), hour="source_bucket")


@query(
    f"""SELECT p.post AS monitoring_post_id, unnest(generate_series(coalesce(s.lo, (SELECT min(h) FROM hourly)), {CUTOFF_HOUR} - 1)) AS hour FROM pst p
    LEFT JOIN (SELECT post, min(h) AS lo FROM hourly GROUP BY post) s USING (post) WHERE NOT retired""",
    "hourly",
    "pst",
)
def inference_calendar(spark, sf_dir):
    return shown(frames.calendar(S.hourly(spark, sf_dir), S.active(spark), at(CUTOFF_HOUR - 1)), hour="source_bucket")


@query("SELECT post AS monitoring_post_id, h AS hour, " + r(*[f"g_{g} AS gas_{g}" for g in GASES]) + " FROM pvt", "pvt")
def pivot_gases(spark, sf_dir):
    return shown(frames.pivot_gases(S.hourly(spark, sf_dir)), hour="source_bucket")


_LAGGED = [f"lag(g_{g}, {n}) OVER (PARTITION BY post ORDER BY h) AS gas_{g}_lag_{n}" for g in GASES for n in frames.LAGS]


@query("SELECT post AS monitoring_post_id, h AS hour, " + r(*_LAGGED) + " FROM dns", "dns")
def lag_features(spark, sf_dir):
    h = S.hourly(spark, sf_dir)
    dense = frames.calendar(h).join(frames.pivot_gases(h), ["monitoring_post_id", "source_bucket"], "left")
    return shown(frames.add_lags(dense).drop(*[f"gas_{g}" for g in GASES]), hour="source_bucket")


_OVER = "OVER (PARTITION BY post ORDER BY h ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_ROLLED = [c for w in frames.WINDOWS for o in [_OVER.format(w - 1)] for c in (f"avg(g_NO2) {o} AS target_rolling_mean_{w}", f"CASE WHEN count(g_NO2) {o} >= 2 THEN stddev_pop(g_NO2) {o} END AS target_rolling_std_{w}")]


@query("SELECT post AS monitoring_post_id, h AS hour, " + r(*_ROLLED) + " FROM dns", "dns")
def rolling_features(spark, sf_dir):
    h = S.hourly(spark, sf_dir)
    dense = frames.calendar(h).join(frames.pivot_gases(h), ["monitoring_post_id", "source_bucket"], "left")
    return shown(frames.add_rolling(dense, "NO2").drop(*[f"gas_{g}" for g in GASES]), hour="source_bucket")


_STATS = ("raw_hourly_mean", "raw_hourly_median", "hourly_min", "hourly_max", "hourly_p95", "hourly_std")


@query(
    f"""SELECT o.post AS monitoring_post_id, o.code AS substance_code, o.h AS hour, {r(*_STATS)}, samples_count,
    {r('avg(v) ' + "OVER (PARTITION BY o.post, o.code ORDER BY o.h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)" + ' AS target_rolling_mean_6')} FROM own o
    LEFT JOIN hourly x ON x.post = o.post AND x.code = o.code AND x.h = o.h""",
    "own",
    "hourly",
)
def target_stats_join(spark, sf_dir):
    out = frames.gas_frames(S.hourly(spark, sf_dir))
    return shown(out, hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", *_STATS, "samples_count", "target_rolling_mean_6")


@query(
    f"""SELECT cal.post AS monitoring_post_id, cal.h AS hour, {r('a.hor_win_spd AS source_weather_hor_win_spd', 'b.precipitation AS transport_weather_precipitation', 'c.boundary_layer_height AS target_weather_boundary_layer_height')} FROM cal
    LEFT JOIN wx a ON a.post = cal.post AND a.h = cal.h LEFT JOIN wx b ON b.post = cal.post AND b.h = cal.h + 1 LEFT JOIN wx c ON c.post = cal.post AND c.h = cal.h + 2""",
    "cal",
    "wx",
)
def weather_roles_join(spark, sf_dir):
    frame = frames.add_times(frames.calendar(S.hourly(spark, sf_dir)))
    out = frames.add_weather(frame, S.live(spark, sf_dir), ("hor_win_spd", "precipitation", "boundary_layer_height"))
    return shown(out, hour="source_bucket").select("monitoring_post_id", "hour", "source_weather_hor_win_spd", "transport_weather_precipitation", "target_weather_boundary_layer_height")


@query(
    f"""SELECT o.post AS monitoring_post_id, o.code AS substance_code, o.h AS hour, {r('o.filtered_hourly_mean AS value', 'l.filtered_hourly_mean AS target_value')}
    FROM hourly o LEFT JOIN hourly l ON l.post = o.post AND l.code = o.code AND l.h = o.h + 2""",
    "hourly",
)
def label_join(spark, sf_dir):
    h = S.hourly(spark, sf_dir)
    frame = h.select("monitoring_post_id", "substance_code", F.col("bucket_start").alias("source_bucket"), F.col("filtered_hourly_mean").alias("value"))
    out = frames.add_labels(frames.add_times(frame), h)
    return shown(out, hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", "value", "target_value")


_LOCAL = "((h + 2 + 3) % 24)"
_DAY = "((((h + 2 + 3) // 24) + 3) % 7)"


@query(f"SELECT DISTINCT h AS hour, {r(f'sin(2 * pi() * {_LOCAL} / 24) AS target_hour_sin', f'cos(2 * pi() * {_LOCAL} / 24) AS target_hour_cos', f'sin(2 * pi() * {_DAY} / 7) AS target_weekday_sin', f'cos(2 * pi() * {_DAY} / 7) AS target_weekday_cos')} FROM cal", "cal")
def calendar_features(spark, sf_dir):
    frame = frames.add_times(frames.calendar(S.hourly(spark, sf_dir)))
    hours = frame.select("source_bucket", "target_start").distinct()
    return shown(hours.withColumns(X.cyclic_features(F.col("target_start"), DEFAULTS.timezone)).drop("target_start"), hour="source_bucket")


@query(
    f"""SELECT from_id, to_id, {r('2 * 6371.0088e0 * asin(least(1.0e0, sqrt(a))) AS distance_km', 'fmod(degrees(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl))) + 360.0e0, 360.0e0) AS bearing')} FROM (
    SELECT from_id, to_id, radians(a.lat) AS p1, radians(b.lat) AS p2, radians(b.lon - a.lon) AS dl, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS a
    FROM (SELECT DISTINCT o_custkey AS from_id, l_suppkey AS to_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN plc a ON a.post = from_id JOIN plc b ON b.post = to_id WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL AND from_id <> to_id)""",
    "plc",
)
def haversine_bearing(spark, sf_dir):
    posts = S.places(spark, sf_dir).filter("latitude is not null")
    end = lambda name, k: posts.select(F.col("id").alias(name), F.col("latitude").alias(f"lat{k}"), F.col("longitude").alias(f"lon{k}"))
    pairs = S.routes(spark, sf_dir).filter("from_id <> to_id").join(end("from_id", 1), "from_id").join(end("to_id", 2), "to_id")
    place = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return shown(pairs.select("from_id", "to_id", X.haversine_km(*place).alias("distance_km"), X.bearing_degrees(*place).alias("bearing")))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense values of all gases with the wind at their hour."""
    h = S.hourly(spark, sf_dir)
    dense = frames.calendar(h).join(frames.pivot_gases(h), ["monitoring_post_id", "source_bucket"], "left")
    each = F.array(*[F.struct(F.lit(g).alias("substance_code"), F.col(f"gas_{g}").alias("value")) for g in GASES])
    long = dense.select("monitoring_post_id", "source_bucket", F.inline(each))
    return frames.add_weather(frames.add_times(long), S.live(spark, sf_dir))


def _spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.summarize_upwind(neighbours.upwind_values(_values(spark, sf_dir), S.active(spark)), DEFAULTS.influence_meters)


@query(f"SELECT {KEYS}, h AS hour, {r('upwind AS spatial_upwind_value', 'mean AS spatial_neighbor_mean', 'most AS spatial_neighbor_max', 'weight AS spatial_weight_sum', 'n AS spatial_neighbor_count', 'nearest AS spatial_min_distance_km')} FROM spt", "spt")
def spatial_neighbors(spark, sf_dir):
    return shown(_spatial(spark, sf_dir), hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", *neighbours.SPATIAL[:6])


@query(f"SELECT {KEYS}, h AS hour, {r('bt_v AS backtrajectory_value', 'bt_km AS backtrajectory_distance_km', 'bt_h AS backtrajectory_travel_hours', 'bt_al AS backtrajectory_alignment')} FROM spt", "spt")
def backtrajectory(spark, sf_dir):
    return shown(_spatial(spark, sf_dir), hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", *neighbours.SPATIAL[6:])


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and label of every post, hour and gas with a value."""
    h = S.hourly(spark, sf_dir)
    keys = ["monitoring_post_id", "substance_code", "source_bucket"]
    values = _values(spark, sf_dir).filter("value is not null").join(_spatial(spark, sf_dir).select(*keys, "spatial_upwind_value"), keys, "left")
    c = F.col
    base = baseline.physical_baseline(c("value"), c("spatial_upwind_value"), c("transport_weather_hor_win_spd"), c("transport_weather_precipitation"), c("source_weather_boundary_layer_height"), c("target_weather_boundary_layer_height"), F.lit(2.0), c("substance_code"))
    labelled = frames.add_labels(values.withColumn("physical_baseline", base), h)
    return labelled.select(*keys, "target_start", "data_cutoff", F.col("value").alias("persistence"), "physical_baseline", "target_value")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir).filter("target_value is not null")


@query(f"SELECT {KEYS}, h AS hour, {r('base AS physical_baseline', 'lag0 AS persistence')} FROM bas", "bas")
def physical_baseline(spark, sf_dir):
    return shown(_baseline(spark, sf_dir), hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", "physical_baseline", "persistence")


def _persistence(h: DataFrame) -> DataFrame:
    frame = frames.gas_frames(h).withColumn("persistence", evaluation.persistence()).filter("persistence is not null")
    return shown(frame.select("monitoring_post_id", "substance_code", "source_bucket", "persistence"), hour="source_bucket")


@query(f"SELECT {KEYS}, h AS hour, {r('lag0 AS persistence')} FROM bas", "bas")
def persistence_all_posts(spark, sf_dir):
    return _persistence(S.hourly(spark, sf_dir))


# --- evaluation ---------------------------------------------------------------


@query("SELECT h + 2 AS split_hour, n AS n_hours FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT h FROM evl)) WHERE k = greatest(1, least(n - 1, floor(n * (1 - 0.2))))", "evl")
def chronological_split(spark, sf_dir):
    return shown(evaluation.chronological_split(_labelled(spark, sf_dir), 0.2), split_hour="split_time")


def _metrics(actual: str, predicted: str, prefix: str = "") -> str:
    e = f"({actual} - {predicted})"
    r2 = f"CASE WHEN count(*) > 1 THEN CASE WHEN min({actual}) = max({actual}) THEN CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum({e} * {e}) / (var_pop({actual}) * count(*)) END END"
    return r(f"avg(abs({e})) AS {prefix}mae", f"sqrt(avg({e} * {e})) AS {prefix}rmse", f"{r2} AS {prefix}r2")


@query(
    f"""SELECT CASE WHEN grouping(code) = 0 THEN 'gas' WHEN grouping(post) = 0 THEN 'station' ELSE 'overall' END AS scope, code AS substance_code, post AS monitoring_post_id, count(*) AS n_rows, {_metrics('label', 'base')}
    FROM evl GROUP BY GROUPING SETS ((), (code), (post))""",
    "evl",
)
def regression_metrics_sets(spark, sf_dir):
    return shown(evaluation.metrics_by_sets(_labelled(spark, sf_dir), "target_value", "physical_baseline"))


@query(f"SELECT code AS substance_code, count(*) AS n_rows, {_metrics('label', 'lag0', 'persistence_')}, {_metrics('label', 'base', 'physical_')} FROM evl GROUP BY ALL", "evl")
def compare_predictors(spark, sf_dir):
    return shown(evaluation.compare_predictors(_labelled(spark, sf_dir), {"persistence": "persistence", "physical": "physical_baseline"}))


@query(f"SELECT code AS substance_code, {r('quantile_cont(label - base, 0.05) AS lower', 'quantile_cont(label - base, 0.95) AS upper')} FROM evl GROUP BY ALL", "evl")
def residual_intervals(spark, sf_dir):
    return shown(evaluation.residual_intervals(_labelled(spark, sf_dir), "target_value", "physical_baseline"))


@query(
    """SELECT w AS window_no, count(*) FILTER (t < s - 1) AS train_rows, count(*) FILTER (t >= s AND t < s + 24) AS test_rows FROM (
    SELECT h + 2 AS t FROM evl), (SELECT w, x + 1 - 24 * (3 - w) AS s FROM (SELECT max(h) AS x FROM hourly), generate_series(0, 2) g(w)) GROUP BY w""",
    "evl",
    "hourly",
)
def rolling_windows(spark, sf_dir):
    last = S.hourly(spark, sf_dir).agg(F.max("bucket_start").alias("last_hour"))
    return evaluation.window_sizes(_labelled(spark, sf_dir), evaluation.daily_windows(last)).withColumn("window_no", F.col("window_no").cast("long"))


@query(
    """SELECT fraction::DOUBLE AS fraction, h + 2 AS split_hour, last + 3 AS end_hour FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k, count(*) OVER () AS n, max(h) OVER (ORDER BY h ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS last
    FROM (SELECT DISTINCT h FROM evl)), (VALUES (0.45::DOUBLE), (0.60), (0.72)) f(fraction) WHERE k = least(n - 2, greatest(1, floor(n * fraction)))""",
    "evl",
)
def rolling_origins(spark, sf_dir):
    return shown(evaluation.rolling_origins(_labelled(spark, sf_dir)), split_hour="split_time", end_hour="test_end")


@query(
    """SELECT post AS monitoring_post_id, h + 2 AS split_hour FROM (SELECT post, h, row_number() OVER (PARTITION BY post ORDER BY h) - 1 AS k, count(*) OVER (PARTITION BY post) AS n, sum(c) OVER (PARTITION BY post) AS total
    FROM (SELECT post, h, count(*) AS c FROM evl GROUP BY ALL)) WHERE k = greatest(1, floor(n * 0.8)) AND total >= 100 AND n >= 12""",
    "evl",
)
def station_splits(spark, sf_dir):
    return shown(evaluation.station_splits(_labelled(spark, sf_dir)), split_hour="split_time")


# --- predictions ---------------------------------------------------------------


@query(
    f"""SELECT {KEYS}, h AS hour, {r('greatest(0, base + res) AS predicted_value', 'CASE WHEN lo IS NOT NULL THEN greatest(0, base + res + lo) END AS lower_bound', 'CASE WHEN hi IS NOT NULL THEN greatest(0, base + res + hi) END AS upper_bound')} FROM (
    SELECT post, b.code, h, base, (h % 41) - 30.0 AS res, lo, hi FROM bas b LEFT JOIN (SELECT code, quantile_cont(label - base, 0.05) AS lo, quantile_cont(label - base, 0.95) AS hi FROM evl GROUP BY code) i ON i.code = b.code AND b.code <> 'SO2')""",
    "bas",
    "evl",
)
def prediction_bounds(spark, sf_dir):
    intervals = evaluation.residual_intervals(_labelled(spark, sf_dir), "target_value", "physical_baseline").filter("substance_code <> 'SO2'")
    rows = _baseline(spark, sf_dir).withColumn("residual", (S.hour_number(F.col("source_bucket")) % 41) - 30.0)
    out = predictions.add_bounds(rows, intervals)
    return shown(out, hour="source_bucket").select("monitoring_post_id", "substance_code", "hour", "predicted_value", "lower_bound", "upper_bound")


@query(f"SELECT post AS monitoring_post_id, code AS substance_code, {r('v AS value')} FROM own WHERE h + 1 = {CUTOFF_HOUR} AND v IS NOT NULL", "own")
def eligible_rows(spark, sf_dir):
    rows = predictions.eligible_rows(frames.add_times(frames.gas_frames(S.hourly(spark, sf_dir))), at(CUTOFF_HOUR))
    return shown(rows.select("monitoring_post_id", "substance_code", evaluation.persistence().alias("value")))


_LATEST = f"SELECT post, code FROM hourly WHERE h = {CUTOFF_HOUR} - 1"


@query(f"SELECT {KEYS}, cut AS cutoff_hour, target AS target_hour, status FROM prd WHERE target = {CUTOFF_HOUR} + 1 AND (post, code) NOT IN ({_LATEST})", "prd")
def anti_join_delete(spark, sf_dir):
    out = predictions.unmeasured(S.predictions(spark, sf_dir), S.hourly(spark, sf_dir), at(CUTOFF_HOUR))
    return shown(out, cutoff_hour="data_cutoff", target_hour="target_start").select("monitoring_post_id", "substance_code", "cutoff_hour", "target_hour", "status")


@query(f"SELECT {KEYS}, cut AS cutoff_hour, target AS target_hour, status FROM prd WHERE target <> {CUTOFF_HOUR} + 1 OR (post, code) IN ({_LATEST})", "prd")
def kept_predictions(spark, sf_dir):
    out = predictions.without_unmeasured(S.predictions(spark, sf_dir), S.hourly(spark, sf_dir), at(CUTOFF_HOUR))
    return shown(out, cutoff_hour="data_cutoff", target_hour="target_start").select("monitoring_post_id", "substance_code", "cutoff_hour", "target_hour", "status")


@query(f"SELECT {KEYS}, target AS target_hour, {r('v AS predicted_value')}, status, left('failed ' || repeat('x', 5000), 4000) AS error_message FROM (SELECT post, code, target, NULL::DOUBLE AS v, 'failed' AS status FROM prd WHERE cut = {CUTOFF_HOUR})", "prd")
def mark_failed(spark, sf_dir):
    rows = S.predictions(spark, sf_dir).filter(F.col("data_cutoff") == at(CUTOFF_HOUR))
    out = predictions.with_status(rows, "failed", "failed " + "x" * 5000)
    return shown(out, target_hour="target_start").select("monitoring_post_id", "substance_code", "target_hour", "predicted_value", "status", "error_message")


# --- catch-up ---------------------------------------------------------------

_EXPECTED = f"""SELECT DISTINCT code, h, EXISTS (SELECT 1 FROM prd p WHERE p.code = x.code AND p.cut = x.h + 1 AND p.target = x.h + 2 AND p.status = 'ready') AS wanted
    FROM hourly x JOIN pst USING (post) WHERE h >= {FROM_HOUR} AND h < {CUTOFF_HOUR} AND lat IS NOT NULL"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catchup.expected_outputs(S.hourly(spark, sf_dir), S.posts(spark), S.predictions(spark, sf_dir), at(FROM_HOUR), at(CUTOFF_HOUR))


@query(f"SELECT code AS substance_code, h AS hour, wanted AS forecast_expected FROM ({_EXPECTED})", "hourly", "prd", "pst")
def expected_outputs(spark, sf_dir):
    return shown(_expected(spark, sf_dir), hour="bucket_start")


@query(f"SELECT h AS hour, kind AS data_kind, code AS substance_code, max(minute) AS generated_minute FROM frm WHERE h >= {FROM_HOUR} AND h <= {CUTOFF_HOUR} + 1 GROUP BY ALL", "frm")
def latest_frames(spark, sf_dir):
    out = catchup.latest_frames(S.frames(spark, sf_dir), at(FROM_HOUR), at(CUTOFF_HOUR + 1))
    return shown(out.withColumn("generated_minute", F.floor(F.unix_micros("generated_at") / 60_000_000)).drop("generated_at"), hour="hour_start")


@query(
    f"""SELECT DISTINCT h + 1 AS cutoff_hour FROM (SELECT *, min(CASE WHEN missing THEN h END) OVER () AS first FROM (
    SELECT e.h, a.g IS NULL OR (e.wanted AND f.g IS NULL) OR (e.h + 1 = {CUTOFF_HOUR} AND (n.g IS NULL OR n.g < a.g)) AS missing FROM ({_EXPECTED}) e
    LEFT JOIN ex a ON a.code = e.code AND a.h = e.h AND a.kind = 'analysis' LEFT JOIN ex n ON n.code = e.code AND n.h = e.h + 1 AND n.kind = 'forecast' LEFT JOIN ex f ON f.code = e.code AND f.h = e.h + 2 AND f.kind = 'forecast')) WHERE h >= first""".replace(
        "ex ", "(SELECT code, h, kind, max(minute) AS g FROM frm GROUP BY ALL) "
    ),
    "hourly",
    "prd",
    "pst",
    "frm",
)
def missing_cutoffs(spark, sf_dir):
    existing = catchup.latest_frames(S.frames(spark, sf_dir), at(FROM_HOUR), at(CUTOFF_HOUR + 1))
    return shown(catchup.cutoffs_to_rebuild(_expected(spark, sf_dir), existing, at(CUTOFF_HOUR)), cutoff_hour="cutoff")


@query(f"SELECT h AS hour, kind AS data_kind, code AS substance_code, minute AS generated_minute FROM frm WHERE h < {CUTOFF_HOUR} - 24", "frm")
def ttl_filter(spark, sf_dir):
    out = expired(S.frames(spark, sf_dir), at(CUTOFF_HOUR), DEFAULTS.retention_hours)
    return shown(out.withColumn("generated_minute", F.floor(F.unix_micros("generated_at") / 60_000_000)).drop("generated_at"), hour="hour_start")


# --- weather means and anchors ---------------------------------------------------

_DIRECTION = "fmod(degrees(atan2(avg(sin(radians({0}))), avg(cos(radians({0}))))) + 360, 360)"


@query(f"SELECT h AS hour, {r('avg(hor_win_spd) AS wind_speed', _DIRECTION.format('hor_win_dir') + ' AS wind_direction')} FROM wx WHERE hor_win_spd IS NOT NULL AND hor_win_dir IS NOT NULL GROUP BY h", "wx")
def circular_wind_mean(spark, sf_dir):
    return shown(weather.mean_wind(S.live(spark, sf_dir), ["bucket_start"]), hour="bucket_start")


@query(
    f"""SELECT h AS hour, {r('avg(CASE WHEN d IS NOT NULL THEN s END) AS wind_speed', _DIRECTION.format('CASE WHEN s IS NOT NULL THEN d END') + ' AS wind_direction', 'avg(boundary_layer_height) AS boundary_layer_height', 'avg(precipitation) AS precipitation')} FROM (
    SELECT *, coalesce(wind_speed_100m, hor_win_spd) AS s, coalesce(wind_direction_100m, hor_win_dir) AS d FROM wx) GROUP BY h""",
    "wx",
)
def mean_weather_fallback(spark, sf_dir):
    return shown(weather.mean_weather(S.live(spark, sf_dir), ["bucket_start"]), hour="bucket_start")


@query(
    f"""SELECT a.post AS monitoring_post_id, a.h AS hour, {r('coalesce(b.wind_speed_100m, a.wind_speed_100m) AS weather_wind_speed', 'coalesce(b.boundary_layer_height, a.boundary_layer_height) AS weather_boundary_layer_height')}
    FROM wx a LEFT JOIN wx b ON b.post = a.post AND b.h = a.h + 1""",
    "wx",
)
def prefer_live_weather(spark, sf_dir):
    live = S.live(spark, sf_dir)
    old = weather.anchor_columns(live, "hour_start")
    next_hour = live.withColumn("hour_start", X.shift_hours(F.col("bucket_start"), -1))
    return shown(weather.prefer_live(old, next_hour, ("monitoring_post_id", "hour_start")), hour="hour_start").select("monitoring_post_id", "hour", "weather_wind_speed", "weather_boundary_layer_height")


def _anchors(df: DataFrame) -> DataFrame:
    out = shown(df, hour="hour_start")
    return out.select("monitoring_post_id", "substance_code", "hour", "latitude", "longitude", "value", "samples_count", "weather_wind_speed", "weather_wind_direction", "weather_boundary_layer_height", "weather_precipitation")


_WX = r("w.wind_speed_100m AS weather_wind_speed", "w.wind_direction_100m AS weather_wind_direction", "w.boundary_layer_height AS weather_boundary_layer_height", "w.precipitation AS weather_precipitation")


@query(f"SELECT x.post AS monitoring_post_id, code AS substance_code, x.h AS hour, {r('lat AS latitude', 'lon AS longitude', 'filtered_hourly_mean AS value')}, samples_count, {_WX} FROM hourly x JOIN pst p ON p.post = x.post AND lat IS NOT NULL LEFT JOIN wx w ON w.post = x.post AND w.h = x.h", "hourly", "pst", "wx")
def analysis_anchors(spark, sf_dir):
    return _anchors(anchors.analysis_anchors(S.hourly(spark, sf_dir), S.posts(spark), S.live(spark, sf_dir)))


@query(f"SELECT x.post AS monitoring_post_id, code AS substance_code, x.h + 1 AS hour, {r('lat AS latitude', 'lon AS longitude', 'filtered_hourly_mean AS value')}, samples_count, {_WX} FROM hourly x JOIN pst p ON p.post = x.post AND lat IS NOT NULL LEFT JOIN wx w ON w.post = x.post AND w.h = x.h + 1", "hourly", "pst", "wx")
def nowcast_anchors(spark, sf_dir):
    return _anchors(anchors.nowcast_anchors(S.hourly(spark, sf_dir), S.posts(spark), S.live(spark, sf_dir)))


@query(
    f"""SELECT f.post AS monitoring_post_id, f.code AS substance_code, target AS hour, {r('lat AS latitude', 'lon AS longitude', 'f.v AS value')}, NULL::BIGINT AS samples_count, {_WX} FROM prd f JOIN pst p ON p.post = f.post AND lat IS NOT NULL
    JOIN hourly x ON x.post = f.post AND x.code = f.code AND x.h = f.cut - 1 LEFT JOIN wx w ON w.post = f.post AND w.h = f.cut WHERE f.status = 'ready' AND f.v IS NOT NULL""",
    "prd",
    "pst",
    "hourly",
    "wx",
)
def forecast_anchors(spark, sf_dir):
    return _anchors(anchors.forecast_anchors(S.predictions(spark, sf_dir), S.hourly(spark, sf_dir), S.posts(spark), S.live(spark, sf_dir)))


@query("SELECT code AS substance_code, target AS target_hour, max(cut) AS cutoff_hour, (target - max(cut)) * 3600.0 AS duration_seconds FROM prd WHERE status = 'ready' GROUP BY code, target", "prd")
def forecast_cutoffs(spark, sf_dir):
    return shown(anchors.forecast_cutoffs(S.predictions(spark, sf_dir)), target_hour="target_start", cutoff_hour="data_cutoff")


# --- grid ---------------------------------------------------------------

_LAT0, _LON0 = 55.84, 37.66
_XY = f"SELECT post, lat, lon, (lon - {_LON0}) * 111320e0 * cos({_LAT0}e0 * pi() / 180) AS x, (lat - {_LAT0}) * 111320e0 AS y FROM pst WHERE lat IS NOT NULL"


def _placed(spark: SparkSession) -> DataFrame:
    x, y = X.project(F.col("latitude"), F.col("longitude"), F.lit(_LAT0), F.lit(_LON0))
    return S.posts(spark).filter("latitude is not null").select(F.col("id").alias("monitoring_post_id"), "latitude", "longitude", x.alias("x"), y.alias("y"))


_PLACED = f"SELECT post, field, (lon - {_LON0}) * 111320e0 * cos({_LAT0}e0 * pi() / 180) AS x, (lat - {_LAT0}) * 111320e0 AS y FROM plc WHERE lat IS NOT NULL"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' posts on the plane; a hundred ids make a field."""
    x, y = X.project(F.col("latitude"), F.col("longitude"), F.lit(_LAT0), F.lit(_LON0))
    return S.places(spark, sf_dir).filter("latitude is not null").select(F.col("id").alias("monitoring_post_id"), "field", x.alias("x"), y.alias("y"))


@query(f"SELECT post AS monitoring_post_id, {r('x', 'y', f'{_LAT0}e0 + y / 111320 AS latitude', f'{_LON0}e0 + x / (111320 * cos({_LAT0}e0 * pi() / 180)) AS longitude')} FROM ({_PLACED})", "plc")
def project_points(spark, sf_dir):
    back = X.unproject(F.col("x"), F.col("y"), F.lit(_LAT0), F.lit(_LON0))
    return shown(_customers(spark, sf_dir).drop("field").withColumns({"latitude": back[0], "longitude": back[1]}))


@query(
    f"""SELECT post AS monitoring_post_id, h AS hour, {r('u AS wind_u', 'v AS wind_v', 'CASE WHEN sqrt(u * u + v * v) > 0 THEN fmod(degrees(atan2(u, v)) + 540, 360) END AS wind_from')} FROM (
    SELECT post, h, coalesce(sin(radians(fmod(hor_win_dir + 180, 360))) * hor_win_spd, 0) AS u, coalesce(cos(radians(fmod(hor_win_dir + 180, 360))) * hor_win_spd, 0) AS v FROM wx)""",
    "wx",
)
def wind_vectors(spark, sf_dir):
    u, v = X.wind_vector(F.col("hor_win_spd"), F.col("hor_win_dir"))
    out = S.live(spark, sf_dir).select("monitoring_post_id", "bucket_start", u.alias("wind_u"), v.alias("wind_v"))
    return shown(out.withColumn("wind_from", X.wind_from_vector(F.col("wind_u"), F.col("wind_v"))), hour="bucket_start")


_PAD = 2000.0
_MESH = f"""SELECT (c - lx)::INT AS grid_x, (r - ly)::INT AS grid_y, c * 500.0e0 AS x, r * 500.0e0 AS y FROM (SELECT *, unnest(generate_series(lx, hx)) AS c FROM (SELECT *, unnest(generate_series(ly, hy)) AS r FROM (
    SELECT floor((min(x) - {_PAD}) / 500)::BIGINT AS lx, ceil((max(x) + {_PAD}) / 500)::BIGINT AS hx, floor((min(y) - {_PAD}) / 500)::BIGINT AS ly, ceil((max(y) + {_PAD}) / 500)::BIGINT AS hy FROM ({_XY}))))"""


def _mesh(spark: SparkSession) -> DataFrame:
    return grid.mesh(_placed(spark).withColumn("field", F.lit(1)), ["field"], STEP, _PAD)


_CELLS = f"""SELECT field, (c - lx)::INT AS grid_x, (r - ly)::INT AS grid_y, c * 500.0e0 AS x, r * 500.0e0 AS y FROM (SELECT *, unnest(generate_series(lx, hx)) AS c FROM (SELECT *, unnest(generate_series(ly, hy)) AS r FROM (
    SELECT field, floor((min(x) - {_PAD}) / 500)::BIGINT AS lx, ceil((max(x) + {_PAD}) / 500)::BIGINT AS hx, floor((min(y) - {_PAD}) / 500)::BIGINT AS ly, ceil((max(y) + {_PAD}) / 500)::BIGINT AS hy FROM ({_PLACED}) GROUP BY field)))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh of each field of customers' posts."""
    return grid.mesh(_customers(spark, sf_dir), ["field"], STEP, _PAD)


@query(f"SELECT field, grid_x, grid_y, {r('x', 'y')} FROM ({_CELLS})", "plc")
def grid_mesh(spark, sf_dir):
    return shown(_cells(spark, sf_dir))


@query(f"SELECT field, grid_x, grid_y, {r(f'{_LAT0}e0 + y / 111320 AS latitude', f'{_LAT0}e0 + (y - 250) / 111320 AS south', f'{_LON0}e0 + (x + 250) / (111320 * cos({_LAT0}e0 * pi() / 180)) AS east')} FROM ({_CELLS})", "plc")
def cell_geometry(spark, sf_dir):
    return shown(grid.cell_geometry(_cells(spark, sf_dir), STEP, F.lit(_LAT0), F.lit(_LON0)).select("field", "grid_x", "grid_y", "latitude", "south", "east"))


def _weathered(spark: SparkSession, w: DataFrame) -> DataFrame:
    """Posts with weather, as stations of field 1."""
    u, v = X.wind_vector(F.col("hor_win_spd"), F.col("hor_win_dir"))
    return _placed(spark).join(w, "monitoring_post_id").withColumns({"field": F.lit(1), "u": u, "v": v, "innovation": F.col("monitoring_post_id") * 1.5 - 3, "confidence": 1.0 / F.col("monitoring_post_id")})


HOURS = ["field", "hour"]


def _stations_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of every hour, which is a key of the field."""
    return _weathered(spark, S.live(spark, sf_dir).withColumn("hour", S.hour_number(F.col("bucket_start"))))


def _mesh_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh of all posts for every hour of the weather."""
    hours = S.live(spark, sf_dir).select(S.hour_number(F.col("bucket_start")).alias("hour")).distinct()
    return grid.mesh(hours.crossJoin(F.broadcast(_placed(spark))).withColumn("field", F.lit(1)), HOURS, STEP, _PAD)


_STATIONS = f"""SELECT s.*, w.h, w.hor_win_spd, w.hor_win_dir, w.boundary_layer_height, coalesce(sin(radians(fmod(hor_win_dir + 180, 360))) * hor_win_spd, 0) AS u, coalesce(cos(radians(fmod(hor_win_dir + 180, 360))) * hor_win_spd, 0) AS v,
    s.post * 1.5e0 - 3 AS innovation, 1.0e0 / s.post AS confidence FROM ({_XY}) s JOIN wx w ON w.post = s.post"""


@query(
    f"""SELECT h AS hour, grid_x, grid_y, {r('CASE WHEN count(*) = 1 OR min(d) <= 1e-9 THEN arg_min(val, rk) ELSE sum(val / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2)) END AS interpolated')} FROM (
    SELECT *, row_number() OVER (PARTITION BY h, grid_x, grid_y ORDER BY d, post) AS rk FROM (SELECT s.h, grid_x, grid_y, s.post, s.boundary_layer_height AS val, sqrt(pow(m.x - s.x, 2) + pow(m.y - s.y, 2)) AS d FROM ({_MESH}) m, ({_STATIONS}) s WHERE s.boundary_layer_height IS NOT NULL))
    WHERE rk <= 4 GROUP BY ALL""",
    "pst",
    "wx",
)
def knn_idw_hours(spark, sf_dir):
    out = grid.nearest_idw(_mesh_hours(spark, sf_dir), _stations_hours(spark, sf_dir), HOURS, ["grid_x", "grid_y"], "boundary_layer_height")
    return shown(out.drop("field"))


@query(
    f"""SELECT field, post AS monitoring_post_id, {r('CASE WHEN d <= 400 THEN val ELSE -1 END AS sampled')} FROM (SELECT p.field, p.post, arg_min(m.grid_x * 1.0 + m.grid_y, sqrt(pow(m.x - p.x, 2) + pow(m.y - p.y, 2))) AS val, min(sqrt(pow(m.x - p.x, 2) + pow(m.y - p.y, 2))) AS d
    FROM ({_PLACED}) p JOIN (SELECT * FROM ({_CELLS}) WHERE (grid_x + grid_y) % 3 <> 0) m ON m.field = p.field GROUP BY p.field, p.post)""",
    "plc",
)
def nearest_within_radius(spark, sf_dir):
    """Every third cell is empty, so some posts have none near enough."""
    cells = _cells(spark, sf_dir).filter("(grid_x + grid_y) % 3 <> 0").withColumn("value", F.col("grid_x") * 1.0 + F.col("grid_y"))
    return shown(grid.sample_nearest(_customers(spark, sf_dir), cells, ["field"], ["monitoring_post_id"], "value", STEP, -1.0))


_LOW = f"(SELECT min(x) FROM ({_MESH}))", f"(SELECT min(y) FROM ({_MESH}))"


@query(
    f"""SELECT {KEYS}, h AS hour, {r('greatest(0.05, least(1, CASE WHEN h % 5 = 0 THEN 0.37 ELSE greatest(0.05, least(1, s / greatest(m, 1))) END)) AS confidence')} FROM (
    SELECT *, max(s) OVER (PARTITION BY code, h) AS m FROM (SELECT post, code, h, CASE WHEN source = 'mosecom' THEN 3.0e0 ELSE samples_count END AS s FROM hourly JOIN pst USING (post)))""",
    "hourly",
    "pst",
)
def observation_confidence(spark, sf_dir):
    rows = anchors.analysis_anchors(S.hourly(spark, sf_dir), S.posts(spark), S.live(spark, sf_dir))
    rows = rows.withColumn("observation_confidence", F.when(S.hour_number(F.col("hour_start")) % 5 == 0, 0.37))
    out = rows.withColumn("confidence", grid.observation_confidence(rows, ["substance_code", "hour_start"]))
    return shown(out.select("monitoring_post_id", "substance_code", "hour_start", "confidence"), hour="hour_start")


@query(
    f"""SELECT {KEYS}, target AS hour, {r('greatest(0.05, least(1, 1 / (1 + v / greatest(abs(v), 1e-9)))) AS confidence', 'least(v * 0.5, v * 0.4) AS lower_bound')} FROM prd WHERE v IS NOT NULL""",
    "prd",
)
def interval_confidence(spark, sf_dir):
    p = S.predictions(spark, sf_dir).filter("predicted_value is not null").withColumn("value", F.col("predicted_value"))
    low, _ = grid.bound_envelope(F.col("value") * 0.4, F.col("lower_bound"), F.col("upper_bound"))
    out = p.withColumn("confidence", grid.observation_confidence(p, ["substance_code"])).withColumn("lower_bound", low)
    return shown(out, hour="target_start").select("monitoring_post_id", "substance_code", "hour", "confidence", "lower_bound")


@query(
    f"""SELECT post AS monitoring_post_id, h AS hour, {r('CASE WHEN ok THEN greatest(wind_speed_100m, 0) ELSE 4 END AS speed', 'CASE WHEN ok THEN wind_direction_100m ELSE 90 END AS direction', 'CASE WHEN boundary_layer_height IS NULL THEN 700 ELSE greatest(50, least(4000, boundary_layer_height)) END AS height', 'coalesce(precipitation, 0) AS rain')} FROM (
    SELECT *, wind_speed_100m IS NOT NULL AND wind_direction_100m IS NOT NULL AS ok FROM wx)""",
    "wx",
)
def anchor_weather_defaults(spark, sf_dir):
    c = F.col
    found = grid.anchor_weather(c("wind_speed_100m"), c("wind_direction_100m"), c("boundary_layer_height"), c("precipitation"), (F.lit(4.0), F.lit(90.0), F.lit(700.0), F.lit(0.0)))
    return shown(S.live(spark, sf_dir).select("monitoring_post_id", "bucket_start", *[v.alias(k) for k, v in found.items()]), hour="bucket_start")


_RHO = """exp(-0.5 * (pow((dx * eu + dy * ev) / lo, 2) + pow((dy * eu - dx * ev) / na, 2)))"""
_PAIRS = f"""SELECT *, CASE WHEN sp > 0.1 THEN u / sp ELSE 0 END AS eu, CASE WHEN sp > 0.1 THEN v / sp ELSE 1 END AS ev, 10000 / sqrt(2.0e0) AS lo, CASE WHEN sp > 0.1 THEN 10000 / sqrt(2.0e0) / (1 + least(sp / 5, 2)) ELSE 10000 / sqrt(2.0e0) END AS na FROM (
    SELECT s.h, m.grid_x, m.grid_y, s.post, m.x - s.x AS dx, m.y - s.y AS dy, s.u, s.v, sqrt(s.u * s.u + s.v * s.v) AS sp FROM ({_MESH}) m, ({_STATIONS}) s)"""


def _correlated(cells: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    s = stations.select(*keys, "monitoring_post_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "u", "v")
    rho = grid.correlation(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("u"), F.col("v"), DEFAULTS.influence_meters)
    return cells.hint("merge").join(s, keys).withColumn("rho", rho)


def _pairs_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlated(_mesh_hours(spark, sf_dir), _stations_hours(spark, sf_dir), HOURS)


def _single() -> dict[str, Column]:
    """Updates by post 2, the single observation."""
    bg, bc = (F.col("grid_x") % 5).cast("double"), (F.col("grid_y") % 4) / 4.0
    return grid.single_update(bg, bc, F.lit(2.0), F.lit(0.3), F.lit(7.5), F.lit(0.8), F.col("rho"))


@query(f"SELECT h AS hour, grid_x, grid_y, post AS monitoring_post_id, {r(_RHO + ' AS rho')} FROM ({_PAIRS})", "pst", "wx")
def anisotropic_correlation_hours(spark, sf_dir):
    return shown(_pairs_hours(spark, sf_dir).select("hour", "grid_x", "grid_y", "monitoring_post_id", "rho"))


@query(
    f"""SELECT h AS hour, grid_x, grid_y, {r('greatest(0, bg + inc) AS value', 'greatest(0, least(1, greatest(bc, 1 - greatest(0, least(1, sv - cov * cov / sys))))) AS confidence', 'inc AS increment')} FROM (
    SELECT *, cov * (7.5 - 2.0) / sys AS inc FROM (SELECT *, rho * sqrt(sv * 0.7e0) AS cov, 0.7e0 + 0.2e0 AS sys FROM (
    SELECT h, grid_x, grid_y, {_RHO} AS rho, (grid_x % 5)::DOUBLE AS bg, (grid_y % 4) / 4.0e0 AS bc, greatest(0.05, least(1, 1 - (grid_y % 4) / 4.0e0)) AS sv FROM ({_PAIRS}) WHERE post = 2)))""",
    "pst",
    "wx",
)
def oi_single_observation_hours(spark, sf_dir):
    rows = _pairs_hours(spark, sf_dir).filter("monitoring_post_id = 2")
    return shown(rows.select("hour", "grid_x", "grid_y", *[v.alias(k) for k, v in _single().items()]))


@query(
    f"""SELECT h AS hour, grid_x, grid_y, {r('coalesce(sum(st * innovation) / nullif(sum(st), 0), 0) AS correction', 'least(1, greatest(0, sum(st))) AS weight')} FROM (
    SELECT h, grid_x, grid_y, innovation, CASE WHEN sqrt(dx * dx + dy * dy) > 10000 THEN 0 ELSE exp(-0.5 * (pow((dx * eu + dy * ev) / lo, 2) + pow((dy * eu - dx * ev) / (lo / (1 + least(sp / 5, 2))), 2))) * exp(-fr) * confidence END AS st FROM (
    SELECT *, rx - px * fr AS dx, ry - py * fr AS dy, u / sp AS eu, v / sp AS ev, 10000 / sqrt(-2 * ln(0.05e0)) AS lo FROM (
    SELECT *, greatest(500 / wy, least(1, (rx * px + ry * py) / (wy * wy))) AS fr FROM (
    SELECT s.h, m.grid_x, m.grid_y, m.x - s.x AS rx, m.y - s.y AS ry, -u * 3600 AS px, -v * 3600 AS py, sqrt(u * u + v * v) * 3600 AS wy, sqrt(u * u + v * v) AS sp, u, v, innovation, confidence FROM ({_MESH}) m, ({_STATIONS}) s WHERE sqrt(u * u + v * v) * 3600 >= 500)))) GROUP BY ALL""",
    "pst",
    "wx",
)
def backward_innovation_hours(spark, sf_dir):
    out = grid.backward_correction(_mesh_hours(spark, sf_dir), _stations_hours(spark, sf_dir), HOURS, ["grid_x", "grid_y"], STEP)
    return shown(out.drop("field"))


_FIELD = "SELECT x AS grid_x, y AS grid_y, ((x * 7 + y * 13) % 17)::DOUBLE AS value, ((x + y) % 7) - 3.0e0 AS wind_u, ((x * 2 + y) % 5) - 2.0e0 AS wind_v, 4.0e0 + (x * y) % 36 AS diffusivity FROM generate_series(0, 29) a(x), generate_series(0, 19) b(y)"


def _slope(axis: str, line: str) -> str:
    over = f"OVER (PARTITION BY {line} ORDER BY {axis})"
    b, a = f"(value - lag(value) {over})", f"(lead(value) {over} - value)"
    return f"coalesce(CASE WHEN {b} * {a} > 0 THEN sign({b}) * least(abs({b}), abs({a})) END, 0)"


def _flux(wind: str, slope: str, axis: str, line: str) -> str:
    o = f"OVER (PARTITION BY {line} ORDER BY {axis})"
    face = f"(({wind} + lead({wind}) {o}) / 2)"
    return f"coalesce({face} * CASE WHEN {face} >= 0 THEN value + 0.5 * {slope} ELSE lead(value) {o} - 0.5 * lead({slope}) {o} END - (diffusivity + lead(diffusivity) {o}) / 2 * (lead(value) {o} - value) / 500, greatest({wind}, 0) * value)"


# --- the same over fields of every hour of the tables ---------------------------------------------

_U = "coalesce({}(radians(fmod(hor_win_dir + 180, 360))) * hor_win_spd, 0)"
_FIELD_H = f"""SELECT h, x AS grid_x, y AS grid_y, air_temp + 10 AS value, {_U.format('sin')} AS wind_u, {_U.format('cos')} AS wind_v, coalesce(boundary_layer_height / 100, 5) AS diffusivity, hor_win_spd, air_hum, precipitation
    FROM wx JOIN (SELECT x, y, 1 + (x + y) % 5 AS post FROM generate_series(0, 11) a(x), generate_series(0, 7) b(y)) USING (post)"""


def _field_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of 12 by 8 cells for every hour of the weather; each cell has that of one post."""
    x, y = F.col("grid_x"), F.col("grid_y")
    cells = spark.range(12 * 8).select((F.col("id") % 12).cast("int").alias("grid_x"), F.expr("cast(id div 12 as int)").alias("grid_y")).withColumn("monitoring_post_id", ((x + y) % 5 + 1).cast("long"))
    u, v = X.wind_vector(F.col("hor_win_spd"), F.col("hor_win_dir"))
    rows = S.live(spark, sf_dir).join(F.broadcast(cells), "monitoring_post_id")
    height = F.coalesce(F.col("boundary_layer_height") / 100, F.lit(5.0))
    return rows.select(S.hour_number(F.col("bucket_start")).alias("hour"), x, y, (F.col("air_temp") + 10).alias("value"), u.alias("wind_u"), v.alias("wind_v"), height.alias("diffusivity"), "hor_win_spd", "air_hum", "precipitation")


@query(
    f"""SELECT code AS substance_code, h AS hour, (floor(fx) + dx)::INT AS grid_x, (floor(fy) + dy)::INT AS grid_y, {r('sum(v * abs(1 - dx - (fx - floor(fx))) * abs(1 - dy - (fy - floor(fy)))) AS value')} FROM (
    SELECT code, h, filtered_hourly_mean AS v, (x + 137 - {_LOW[0]}) / 500 AS fx, (y - 5000 - {_LOW[1]}) / 500 AS fy FROM hourly JOIN ({_XY}) USING (post)), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)
    WHERE v IS NOT NULL AND floor(fx) + dx BETWEEN 0 AND 29 AND floor(fy) + dy BETWEEN 0 AND 19 GROUP BY ALL""",
    "hourly",
    "pst",
)
def bilinear_deposit_hours(spark, sf_dir):
    """Every hourly value of a located post, split over the cells around a point beside it."""
    low = _mesh(spark).agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    values = S.hourly(spark, sf_dir).join(F.broadcast(_placed(spark)), "monitoring_post_id").join(F.broadcast(low))
    points = values.select("substance_code", S.hour_number(F.col("bucket_start")).alias("hour"), (F.col("x") + 137).alias("x"), (F.col("y") - 5000).alias("y"), F.col("filtered_hourly_mean").alias("value"), "lx", "ly")
    return shown(grid.deposit(points, ["substance_code", "hour"], STEP, (F.col("lx"), F.col("ly")), (F.lit(30), F.lit(20))))


_SLOPES_H = f"SELECT *, {_slope('grid_x', 'h, grid_y')} AS slope_x, {_slope('grid_y', 'h, grid_x')} AS slope_y FROM ({_FIELD_H})"


@query(f"SELECT h AS hour, grid_x::INT AS grid_x, grid_y::INT AS grid_y, {r('slope_x', 'slope_y')} FROM ({_SLOPES_H})", "wx")
def minmod_slope_hours(spark, sf_dir):
    return shown(grid.limited_slope(_field_hours(spark, sf_dir), ["hour"]).select("hour", "grid_x", "grid_y", "slope_x", "slope_y"))


@query(
    f"""SELECT h AS hour, grid_x::INT AS grid_x, grid_y::INT AS grid_y,
    {r('value - 30.0 / 500 * (ux - coalesce(lag(ux) OVER (PARTITION BY h, grid_y ORDER BY grid_x), least(wind_u, 0) * value) + uy - coalesce(lag(uy) OVER (PARTITION BY h, grid_x ORDER BY grid_y), least(wind_v, 0) * value)) AS value')}
    FROM (SELECT *, {_flux('wind_u', 'slope_x', 'grid_x', 'h, grid_y')} AS ux, {_flux('wind_v', 'slope_y', 'grid_y', 'h, grid_x')} AS uy FROM ({_SLOPES_H}))""",
    "wx",
)
def transport_one_step_hours(spark, sf_dir):
    return shown(grid.transport_step(_field_hours(spark, sf_dir), ["hour"], STEP, 30.0))


_MASKED_H = """SELECT h, grid_x, grid_y, CASE WHEN hor_win_spd IS NOT NULL THEN value * 5e-8 END AS v, (air_hum - 40) / 600 AS c, ((h + grid_x) % 7) / 100.0e0 AS b, precipitation / 12 AS w, grid_y % 5 = 0 AS p"""


@query(
    f"""SELECT h AS hour, grid_x::INT AS grid_x, grid_y::INT AS grid_y, coalesce(v IS NOT NULL AND c >= 0.02 AND (p OR c - b >= 0.02 OR w >= 0.02), FALSE) AS analysis,
    coalesce(v IS NOT NULL AND c >= 0.02 AND (c - b >= 0.02 OR (b >= 0.02 AND v >= 1e-6)), FALSE) AS forecast, coalesce(v IS NOT NULL AND c >= 0.02 AND (c - b >= 0.02 OR b >= 0.02), FALSE) AS nowcast FROM ({_MASKED_H} FROM ({_FIELD_H}))""",
    "wx",
)
def grid_keep_mask_hours(spark, sf_dir):
    cells = _field_hours(spark, sf_dir)
    v, c = F.when(F.col("hor_win_spd").isNotNull(), F.col("value") * 5e-8), (F.col("air_hum") - 40) / 600
    b, w = ((F.col("hour") + F.col("grid_x")) % 7) / 100.0, F.col("precipitation") / 12
    masks = {"analysis": grid.analysis_keep(v, c, b, w, F.col("grid_y") % 5 == 0), "forecast": grid.forecast_keep(v, c, b, F.lit(True)), "nowcast": grid.forecast_keep(v, c, b, F.lit(False))}
    return cells.select("hour", "grid_x", "grid_y", *[m.alias(k) for k, m in masks.items()])


@query(
    f"""SELECT h AS hour, count(*) AS cell_count, {r('min(grid_y * 500.0e0 - 250) AS south', 'min(grid_x * 500.0e0 - 250) AS west', 'max(grid_y * 500.0e0 + 250) AS north', 'max(grid_x * 500.0e0 + 250) AS east', 'min(value) AS value_min', 'max(value) AS value_max')}, max(grid_x % 4)::INT AS source_station_count,
    {r('sqrt(pow(avg(wind_u), 2) + pow(avg(wind_v), 2)) AS wind_speed', 'CASE WHEN sqrt(pow(avg(wind_u), 2) + pow(avg(wind_v), 2)) > 0 THEN fmod(degrees(atan2(avg(wind_u), avg(wind_v))) + 540, 360) END AS wind_direction')} FROM ({_FIELD_H}) GROUP BY h""",
    "wx",
)
def frame_summary_hours(spark, sf_dir):
    x, y = F.col("grid_x") * STEP, F.col("grid_y") * STEP
    sides = {"south": y - 250, "north": y + 250, "west": x - 250, "east": x + 250}
    return shown(grid.frame_summary(_field_hours(spark, sf_dir).withColumns(sides | {"source_station_count": F.col("grid_x") % 4}), ["hour"]))


#: Two stations on cells of the field: post, grid_x, grid_y, trust in what they observe.
_TWO = ((1, 3, 2, 0.8), (2, 8, 5, 0.6))


def _rho_sql(x: str, y: str, k: str) -> str:
    """Correlation of a place with station k, whose unit wind, length and width are columns."""
    return f"exp(-0.5 * (pow((({x}) * eu{k} + ({y}) * ev{k}) / lo, 2) + pow((({y}) * eu{k} - ({x}) * ev{k}) / na{k}, 2)))"


_TWO_SIDE = " JOIN ".join(
    f"""(SELECT h, CASE WHEN sp > 0.1 THEN u / sp ELSE 0 END AS eu{k}, CASE WHEN sp > 0.1 THEN v / sp ELSE 1 END AS ev{k}, CASE WHEN sp > 0.1 THEN 10000 / sqrt(2.0e0) / (1 + least(sp / 5, 2)) ELSE 10000 / sqrt(2.0e0) END AS na{k}, obs AS obs{k}
    FROM (SELECT *, sqrt(u * u + v * v) AS sp FROM (SELECT h, {_U.format('sin')} AS u, {_U.format('cos')} AS v, air_hum / 10 AS obs FROM wx WHERE post = {post}))) s{k}{'' if k == 1 else ' USING (h)'}"""
    for k, (post, _, _, _) in enumerate(_TWO, 1)
)
_TWO_AT = " ".join(f"JOIN (SELECT h, value AS bg{k}, sqrt(greatest(0.05, least(1, 1 - (grid_y % 4) / 4.0e0))) AS own{k} FROM fld WHERE grid_x = {x} AND grid_y = {y}) c{k} USING (h)" for k, (_, x, y, _) in enumerate(_TWO, 1))


@query(
    f"""SELECT h AS hour, grid_x::INT AS grid_x, grid_y::INT AS grid_y, {r('greatest(0, bg + inc) AS value', 'greatest(0, least(1, greatest(bc, 1 - greatest(0, least(1, sv * sv - red))))) AS confidence', 'inc AS increment')} FROM (
    SELECT *, c1 * (a22 * d1 - a12 * d2) / det + c2 * (a11 * d2 - a12 * d1) / det AS inc, (c1 * c1 * a22 - 2 * c1 * c2 * a12 + c2 * c2 * a11) / det AS red FROM (
    SELECT *, a11 * a22 - a12 * a12 AS det, r1 * sv * own1 AS c1, r2 * sv * own2 AS c2 FROM (
    SELECT *, own1 * own1 + 0.2e0 AS a11, own2 * own2 + 0.4e0 AS a22, (r12 + r21) / 2 * own1 * own2 AS a12, obs1 - bg1 AS d1, obs2 - bg2 AS d2 FROM (
    SELECT h, grid_x, grid_y, value AS bg, (grid_y % 4) / 4.0e0 AS bc, sqrt(greatest(0.05, least(1, 1 - (grid_y % 4) / 4.0e0))) AS sv, own1, own2, bg1, bg2, obs1, obs2,
    {_rho_sql('500.0e0 * (grid_x - 3)', '500.0e0 * (grid_y - 2)', '1')} AS r1, {_rho_sql('500.0e0 * (grid_x - 8)', '500.0e0 * (grid_y - 5)', '2')} AS r2,
    {_rho_sql('500.0e0 * (3 - 8)', '500.0e0 * (2 - 5)', '2')} AS r12, {_rho_sql('500.0e0 * (8 - 3)', '500.0e0 * (5 - 2)', '1')} AS r21
    FROM (SELECT *, 10000 / sqrt(2.0e0) AS lo FROM ({_FIELD_H})) JOIN ({"SELECT * FROM " + _TWO_SIDE}) USING (h) {_TWO_AT.replace("FROM fld", f"FROM ({_FIELD_H})")}))))""",
    "wx",
)
def oi_two_observations_hours(spark, sf_dir):
    """The solver's interpolation with two stations, for every hour; SQL has the inverse of their 2 by 2 system written out."""
    u, v = X.wind_vector(F.col("hor_win_spd"), F.col("hor_win_dir"))
    listed = F.array(*[F.struct(F.lit(p).cast("long").alias("monitoring_post_id"), F.lit(x * STEP).alias("x"), F.lit(y * STEP).alias("y"), F.lit(t).alias("trust")) for p, x, y, t in _TWO])
    places = spark.range(1).select(F.inline(listed))
    stations = S.live(spark, sf_dir).join(F.broadcast(places), "monitoring_post_id").select(S.hour_number(F.col("bucket_start")).alias("hour"), "monitoring_post_id", "x", "y", "trust", (F.col("air_hum") / 10).alias("observed"), u.alias("u"), v.alias("v"))
    cells = _field_hours(spark, sf_dir).select("hour", "grid_x", "grid_y", "value", ((F.col("grid_y") % 4) / 4.0).alias("confidence"))

    def update(mine, theirs):
        theirs = theirs.sort_values("monitoring_post_id")
        at = mine[["grid_x", "grid_y"]].to_numpy(float) * STEP
        got = field.optimal_interpolation(at, mine["value"].to_numpy(), mine["confidence"].to_numpy(), theirs[["x", "y"]].to_numpy(), theirs["observed"].to_numpy(), theirs["trust"].to_numpy(), theirs[["u", "v"]].to_numpy(), DEFAULTS)
        return mine[["hour", "grid_x", "grid_y"]].assign(value=got[0], confidence=got[1], increment=got[2])

    out = cells.groupBy("hour").cogroup(stations.groupBy("hour")).applyInPandas(update, "hour long, grid_x int, grid_y int, value double, confidence double, increment double")
    return shown(out)


# --- solvers and models: no SQL form ---------------------------------------------


@query()
def transport_field(spark, sf_dir):
    fields = _field_hours(spark, sf_dir).withColumns({"confidence": F.col("value") / 40, "decay": F.lit(0.05)})
    return shown(field.transport_fields(fields, ["hour"], 3600.0))


def _day_before(spark: SparkSession, sf_dir: str, first: int) -> tuple[DataFrame, DataFrame]:
    """Hourly features from an hour before `first` to the cutoff, and the weather around them, each worked out and stored once.

    Three sets of anchors, their predictions and mean weather are made of these few rows. As parts of one plan they
    would work out the features of all events again for each. A cutoff comes one hour or two after the hour its prediction is made of, so
    predictions for the cutoffs after the hours from `first` on begin an hour earlier; weather is asked for up to the cutoff itself.
    """
    store.checkpoint_dir(spark)
    known = readings.within(S.hourly(spark, sf_dir), "bucket_start", at(first - 1), at(CUTOFF_HOUR))
    live = readings.within(S.live(spark, sf_dir), "bucket_start", at(first), at(CUTOFF_HOUR + 1))
    return known.checkpoint(), live.checkpoint()


@query()
def field_chain(spark, sf_dir):
    """Analyses, nowcasts and forecasts of the day before the cutoff, for all gases."""
    first = CUTOFF_HOUR - DEFAULTS.retention_hours - 2
    known, live = _day_before(spark, sf_dir, first)
    h, posts = readings.within(known, "bucket_start", at(first), at(CUTOFF_HOUR)), S.posts(spark)
    ahead = anchors.forecast_anchors(S.predictions_of(known), h, posts, live)
    cells = field.chain_fields(anchors.analysis_anchors(h, posts, live), anchors.nowcast_anchors(h, posts, live), ahead, live)
    return shown(grid.frame_summary(cells), hour="hour_start")


_ALL_LAGS = [f"gas_{g}_lag_{n}" for g in GASES for n in frames.LAGS]
_LAGS_SQL = "SELECT post, h, " + ", ".join(f"lag(g_{g}, {n}) OVER (PARTITION BY post ORDER BY h) AS gas_{g}_lag_{n}" for g in GASES for n in frames.LAGS) + " FROM dns"
_ROLL = "OVER (PARTITION BY post, code ORDER BY h ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_ROLLS_SQL = "SELECT post, code, h, v, " + ", ".join(f"avg(v) {o} AS target_rolling_mean_{w}, CASE WHEN count(v) {o} >= 2 THEN stddev_pop(v) {o} END AS target_rolling_std_{w}" for w in frames.WINDOWS for o in [_ROLL.format(w - 1)]) + " FROM own"
_WX_ALL = "SELECT *, ((h * post) % 101)::DOUBLE AS cloud_cover, ((h + post) % 101)::DOUBLE AS cloud_cover_low, 5.0e0 + ((3 * h + post) % 40) / 10.0e0 AS wind_gusts_10m, ((11 * h) % 700)::DOUBLE AS shortwave_radiation FROM wx"
_ROLES = [f"{t}.{m} AS {role}_weather_{m}" for t, role in (("a", "source"), ("b", "transport"), ("c", "target")) for m in readings.WEATHER]
_SPATIAL = {"spatial_upwind_value": "upwind", "spatial_neighbor_mean": "mean", "spatial_neighbor_max": "most", "spatial_min_distance_km": "nearest", "backtrajectory_value": "bt_v", "backtrajectory_distance_km": "bt_km", "backtrajectory_travel_hours": "bt_h", "backtrajectory_alignment": "bt_al"}
_HOUR_L, _DAY_L = "((o.h + 2 + 3) % 24)", "((((o.h + 2 + 3) // 24) + 3) % 7)"


@query(
    f"""SELECT o.post AS monitoring_post_id, o.code AS substance_code, o.h AS source_hour, o.h + 1 AS cutoff_hour, o.h + 2 AS target_hour, o.h + 3 AS end_hour, x.samples_count,
    {r(*[f'x.{c} AS {c}' for c in _STATS], *[f'l.{c} AS {c}' for c in _ALL_LAGS], *[f'o.target_rolling_{k}_{w} AS target_rolling_{k}_{w}' for w in frames.WINDOWS for k in ('mean', 'std')], *_ROLES)},
    {r('p.lat AS latitude', 'p.lon AS longitude', f'sin(2 * pi() * {_HOUR_L} / 24) AS target_hour_sin', f'cos(2 * pi() * {_HOUR_L} / 24) AS target_hour_cos', f'sin(2 * pi() * {_DAY_L} / 7) AS target_weekday_sin', f'cos(2 * pi() * {_DAY_L} / 7) AS target_weekday_cos')},
    {r('y.filtered_hourly_mean AS target_value', *[f's.{c} AS {n}' for n, c in _SPATIAL.items()], 'coalesce(s.weight, 0) AS spatial_weight_sum', 'coalesce(s.n, 0) AS spatial_neighbor_count', 'bas.base AS physical_baseline')}
    FROM ({_ROLLS_SQL}) o JOIN ({_LAGS_SQL}) l ON l.post = o.post AND l.h = o.h JOIN bas ON bas.post = o.post AND bas.code = o.code AND bas.h = o.h
    LEFT JOIN hourly x ON x.post = o.post AND x.code = o.code AND x.h = o.h LEFT JOIN hourly y ON y.post = o.post AND y.code = o.code AND y.h = o.h + 2
    LEFT JOIN ({_WX_ALL}) a ON a.post = o.post AND a.h = o.h LEFT JOIN ({_WX_ALL}) b ON b.post = o.post AND b.h = o.h + 1 LEFT JOIN ({_WX_ALL}) c ON c.post = o.post AND c.h = o.h + 2
    LEFT JOIN (SELECT * FROM pst WHERE NOT retired) p ON p.post = o.post LEFT JOIN spt s ON s.post = o.post AND s.code = o.code AND s.h = o.h WHERE o.v IS NOT NULL""",
    "bas",
    "pst",
)
def local_frame(spark, sf_dir):
    """The whole training frame of all gases."""
    posts = S.active(spark)
    out = baseline.add_baseline(neighbours.add_spatial(frames.local_frame(S.hourly(spark, sf_dir), posts, S.live(spark, sf_dir)), posts=posts))
    return shown(out, source_hour="source_bucket", cutoff_hour="data_cutoff", target_hour="target_start", end_hour="target_end")


@query()
def residual_forecast(spark, sf_dir):
    """Held-out predictions of boosted trees on the baseline's residual."""
    from zephyrframe.plans.job import training_frame

    rows = model.with_correction_target(training_frame(S.hourly(spark, sf_dir), S.active(spark), S.live(spark, sf_dir))).persist()
    split = evaluation.assign_split(rows, DEFAULTS.test_fraction)
    artifact = model.fit(split.filter("not is_test").drop("is_test"))
    out = model.evaluate(split.filter("is_test").drop("is_test"), artifact)
    return shown(out.select("monitoring_post_id", "substance_code", "target_start", "target_value", "physical_baseline", "predicted"), hour="target_start")
