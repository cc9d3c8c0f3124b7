"""DuckDB text for the parts that oracle queries share. Hours are numbers since the epoch."""

from __future__ import annotations

GASES = ("CO", "NO", "NO2", "O3", "SO2", "H2S")
MEASURES = ("raw_hourly_mean", "raw_hourly_median", "filtered_hourly_mean", "hourly_min", "hourly_max", "hourly_p95", "hourly_std")

#: Common table expressions by name, each with the names it builds on.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT event_id, user_id % 4 + 1 AS post, epoch_us(ts) AS us, value - 100 AS v,
        CASE event_type WHEN 'click' THEN 'CO' WHEN 'view' THEN 'NO' WHEN 'purchase' THEN 'NO2' WHEN 'signup' THEN 'O3' WHEN 'error' THEN 'SO2' END AS code FROM events"""),
    "smp": (("ev",), "SELECT event_id, post, code, us, abs(v) AS v FROM ev WHERE v IS NOT NULL AND code IS NOT NULL"),
    "dlt": (("smp",), "SELECT *, (us - lag(us) OVER (PARTITION BY post, code ORDER BY us, event_id)) / 1e6 AS delta FROM smp"),
    "cad": (("dlt",), "SELECT *, median(CASE WHEN delta > 0 THEN delta END) OVER (PARTITION BY post, code) AS cadence FROM dlt"),
    "seg": (("cad",), "SELECT *, sum(CASE WHEN delta > 3 * cadence THEN 1 ELSE 0 END) OVER (PARTITION BY post, code ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM cad"),
    "med": (("seg",), "SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY post, code, segment ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM seg"),
    "internal": (("med",), """SELECT post, code, us // 3600000000 AS h, avg(v) AS raw_hourly_mean, quantile_cont(v, 0.5) AS raw_hourly_median, avg(f) AS filtered_hourly_mean,
        min(v) AS hourly_min, max(v) AS hourly_max, quantile_cont(v, 0.95) AS hourly_p95, stddev_pop(v) AS hourly_std, count(*) AS samples_count FROM med GROUP BY ALL"""),
    "rds": (("ev",), """SELECT 5 AS post, CASE WHEN h % 7 = 0 THEN lower(code) ELSE code END AS code, h, abs(t / n) AS v FROM (
        SELECT code, us // 3600000000 AS h, sum(v) AS t, count(*) AS n FROM ev WHERE event_id % 5 = 0 AND code IS NOT NULL AND v IS NOT NULL GROUP BY ALL)"""),
    "hourly": (("internal", "rds"), "SELECT * FROM internal UNION ALL SELECT post, code, h, v, v, v, v, v, v, 0.0, 1 FROM rds WHERE code = upper(code)"),
    "pst": ((), """SELECT id AS post, CASE WHEN id <> 6 THEN 55.75e0 + 0.03e0 * id END AS lat, CASE WHEN id <> 6 THEN 37.60e0 + 0.04e0 * ((id * id) % 5) END AS lon,
        id = 7 AS retired, CASE WHEN id = 5 THEN 'mosecom' ELSE 'own' END AS source FROM generate_series(1, 7) t(id)"""),
    "plc": ((), """SELECT c_custkey AS post, c_custkey // 100 AS field, CASE WHEN c_custkey % 11 <> 0 THEN 55.6e0 + (c_custkey * 7919 % 3000) / 10000e0 END AS lat,
        CASE WHEN c_custkey % 11 <> 0 THEN 37.3e0 + (c_custkey * 104729 % 6000) / 10000e0 END AS lon, c_custkey % 13 = 0 AS retired FROM customer"""),
    "wxx": (("ev",), """SELECT p AS post, h, kind,
        (h + p) % 30 - 10.0e0 AS air_temp, 40.0e0 + (h + 2 * p) % 60 AS air_hum, 990.0e0 + (h + p) % 40 AS atm_press,
        CASE WHEN (h + p) % 11 <> 0 THEN 2.0e0 + ((7 * h + 3 * p + k) % 50) / 10.0e0 END AS hor_win_spd,
        CASE WHEN (h + p) % 11 <> 0 THEN ((37 * h + 53 * p + k) % 360)::DOUBLE END AS hor_win_dir,
        CASE WHEN (h + p) % 6 = 0 THEN ((3 * h) % 10) / 10.0e0 ELSE 0.0e0 END AS precipitation,
        CASE WHEN (h + p) % 13 <> 0 THEN 3.0e0 + ((5 * h + 2 * p + k) % 60) / 10.0e0 END AS wind_speed_100m,
        CASE WHEN (h + p) % 17 <> 0 THEN ((31 * h + 47 * p + k) % 360)::DOUBLE END AS wind_direction_100m,
        CASE WHEN (h + p) % 19 <> 0 THEN 300.0e0 + (13 * h + 17 * p + k) % 1500 END AS boundary_layer_height
        FROM (SELECT unnest(generate_series(min(us) // 3600000000, max(us) // 3600000000 + 3)) AS h FROM ev), generate_series(1, 5) t(p),
        (VALUES ('live_forecast', 0), ('historical_forecast', 1)) v(kind, k)"""),
    "wx": (("wxx",), "SELECT * FROM wxx WHERE kind = 'live_forecast'"),
    "prd": (("hourly",), """SELECT post, code, h + 1 + late AS cut, h + 2 + late AS target, CASE WHEN n % 5 <> 0 THEN f * 0.9e0 END AS v,
        CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 7 = 1 THEN 'running' ELSE 'ready' END AS status
        FROM (SELECT post, code, h, filtered_hourly_mean AS f, h + post AS n, CASE WHEN (h + post) % 9 = 0 THEN 1 ELSE 0 END AS late FROM hourly)"""),
    "frm": (("hourly",), """SELECT code, h + ahead AS h, kind, h * 60 + minutes AS minute FROM (SELECT DISTINCT code, h FROM hourly),
        (VALUES ('analysis', 0, 29, 0), ('forecast', 1, 23, -5), ('forecast', 2, 31, 5)) k(kind, ahead, m, minutes) WHERE h % m <> 0"""),
    "cal": (("hourly",), "SELECT post, unnest(generate_series(min(h), max(h))) AS h FROM hourly GROUP BY post"),
    "pvt": (("hourly",), "SELECT post, h, " + ", ".join(f"max(CASE WHEN code = '{g}' THEN filtered_hourly_mean END) AS g_{g}" for g in GASES) + " FROM hourly GROUP BY ALL"),
    "dns": (("cal", "pvt"), "SELECT cal.post, cal.h, " + ", ".join(f"g_{g}" for g in GASES) + " FROM cal LEFT JOIN pvt USING (post, h)"),
    "own": (("dns",), " UNION ALL ".join(f"SELECT post, h, '{g}' AS code, g_{g} AS v FROM dns" for g in GASES)),
    "prs": (("pst",), """SELECT *, 2 * 6371.0088e0 * asin(least(1.0e0, sqrt(a))) AS km, fmod(degrees(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl))) + 360.0e0, 360.0e0) AS bearing FROM (
        SELECT a.post, b.post AS other, radians(a.lat) AS p1, radians(b.lat) AS p2, radians(b.lon - a.lon) AS dl,
        pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS a
        FROM pst a JOIN pst b ON a.post <> b.post WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL)"""),
    "upw": (("own", "prs", "wx"), """SELECT x.post, x.code, x.h, x.km, x.al, x.hours, o.v FROM (
        SELECT n.*, greatest(0.0e0, cos(radians(fmod(wd - bearing + 180.0e0 + 360.0e0, 360.0e0) - 180.0e0))) AS al, km / greatest(ws * 3.6e0, 0.1e0) AS hours FROM (
            SELECT o.post, o.code, o.h, p.other, p.km, p.bearing, w.hor_win_dir AS wd, w.hor_win_spd AS ws FROM own o
            JOIN wx w ON w.post = o.post AND w.h = o.h AND w.hor_win_dir IS NOT NULL AND w.hor_win_spd IS NOT NULL JOIN prs p ON p.post = o.post AND p.post < 6 AND p.other < 6) n) x
        JOIN own o ON o.post = x.other AND o.code = x.code AND o.h = x.h - least(round_even(x.hours, 0), 3)::BIGINT AND o.v IS NOT NULL WHERE x.al > 0"""),
    "spt": (("upw",), """SELECT post, code, h, sum(v * w) / sum(w) AS upwind, avg(v) AS mean, max(v) AS most, sum(w) AS weight, count(*)::DOUBLE AS n, min(km) AS nearest,
        sum(v * b) / sum(b) AS bt_v, sum(km * b) / sum(b) AS bt_km, sum(hours * b) / sum(b) AS bt_h, sum(al * b) / sum(b) AS bt_al FROM (
        SELECT *, al * exp(-km / 20) AS w, CASE WHEN km <= 10 THEN al * exp(-0.5 * pow(km / 10, 2)) END AS b FROM upw) GROUP BY ALL"""),
    "bas": (("own", "wx", "spt"), """SELECT post, code, h, lag0, label, greatest(0.0e0, (l * (1 - b) + n * b) * m * e) AS base FROM (
        SELECT x.*, greatest(lag0, 0) AS l, greatest(coalesce(upwind, lag0), 0) AS n, greatest(0.0e0, least(0.35e0, greatest(coalesce(wind, 0), 0) / 12)) AS b,
        greatest(0.45e0, least(1.8e0, sqrt(s / t))) AS m, exp(-2 * (d + r * greatest(coalesce(rain, 0), 0))) AS e FROM (
            SELECT o.post, o.code, o.h, o.v AS lag0, lb.v AS label, spt.upwind, tr.hor_win_spd AS wind, tr.precipitation AS rain,
            greatest(50.0e0, least(4000.0e0, coalesce(sr.boundary_layer_height, 500))) AS s,
            greatest(50.0e0, least(4000.0e0, coalesce(tg.boundary_layer_height, sr.boundary_layer_height, 500))) AS t,
            CASE o.code WHEN 'CO' THEN 0.01e0 WHEN 'NO' THEN 0.18e0 WHEN 'NO2' THEN 0.08e0 WHEN 'O3' THEN 0.04e0 WHEN 'SO2' THEN 0.07e0 ELSE 0.05e0 END AS d,
            CASE o.code WHEN 'CO' THEN 0.002e0 WHEN 'NO' THEN 0.004e0 WHEN 'NO2' THEN 0.012e0 WHEN 'O3' THEN 0.004e0 WHEN 'SO2' THEN 0.025e0 ELSE 0.008e0 END AS r
            FROM own o LEFT JOIN spt ON spt.post = o.post AND spt.code = o.code AND spt.h = o.h
            LEFT JOIN wx sr ON sr.post = o.post AND sr.h = o.h LEFT JOIN wx tr ON tr.post = o.post AND tr.h = o.h + 1 LEFT JOIN wx tg ON tg.post = o.post AND tg.h = o.h + 2
            LEFT JOIN own lb ON lb.post = o.post AND lb.code = o.code AND lb.h = o.h + 2
            WHERE o.v IS NOT NULL) x)"""),
    "evl": (("bas",), "SELECT * FROM bas WHERE label IS NOT NULL"),
}


def oracle(body: str, *parts: str) -> str:
    """SQL of a query over shared parts, in the order they build on each other."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in PARTS[name][0]:
            add(below)
        if name not in ordered:
            ordered.append(name)

    for p in parts:
        add(p)
    # Values that several parts use are computed once.
    heads = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in ordered)
    return f"WITH {heads}\n{body}" if heads else body
