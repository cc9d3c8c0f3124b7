"""Registered queries do the whole job: no hours, posts or trees are left out."""

import math

import pytest
from pyspark.sql import functions as F

from zephyrframe.plans import samples as S
from zephyrframe.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_hours_of_weather_are_flattened(spark):
    want = {(r.monitoring_post_id, r.hour): round(r.air_temp, 6) for r in S.live(spark, SF).select("monitoring_post_id", S.hour_number(F.col("bucket_start")).alias("hour"), "air_temp").collect()}
    found = QUERIES["weather_json_flatten_all"](spark, SF).collect()
    assert len(found) == len(want) > 5 * 48
    assert {(r.monitoring_post_id, r.hour): r.air_temp for r in found} == want


def test_persistence_has_the_posts_of_the_baseline(spark):
    columns = ["monitoring_post_id", "substance_code", "hour", "persistence"]
    found = {tuple(r) for r in QUERIES["persistence_all_posts"](spark, SF).select(columns).collect()}
    assert found == {tuple(r) for r in QUERIES["physical_baseline"](spark, SF).select(columns).collect()}
    assert {r[0] for r in found} == {1, 2, 3, 4, 5}


def test_neighbours_take_every_active_post(spark, monkeypatch):
    from zephyrframe.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.neighbours, "upwind_values", lambda values, places: seen.append(places) or values)
    monkeypatch.setattr(catalog.neighbours, "summarize_upwind", lambda values, radius: values)
    catalog._spatial(spark, SF)
    assert {r.monitoring_post_id for r in seen[0].collect()} == {1, 2, 3, 4, 5, 6}


def test_forecast_is_of_the_whole_model(spark, monkeypatch):
    from zephyrframe.operators import model
    from zephyrframe.settings import DEFAULTS, Settings

    used = []

    def stopped(features, settings=DEFAULTS):
        used.append(settings)
        raise RuntimeError("no need to fit")

    monkeypatch.setattr(model, "estimator", stopped)
    with pytest.raises(RuntimeError, match="no need to fit"):
        QUERIES["residual_forecast"](spark, SF)
    assert used == [Settings()] and (used[0].iterations, used[0].depth) == (300, 6)


PLACES = {p: (55.75 + 0.03 * p, 37.60 + 0.04 * (p * p % 5)) for p in (1, 2, 3, 4, 5, 7)}
XY = {p: ((lon - 37.66) * 111320 * math.cos(math.radians(55.84)), (lat - 55.84) * 111320) for p, (lat, lon) in PLACES.items()}


def weather_of(hour):
    """By post: wind to the east and the north, and mixing height, from the sample's rule."""
    out = {}
    for p in range(1, 6):
        calm = (hour + p) % 11 == 0
        speed, to = 2.0 + ((7 * hour + 3 * p) % 50) / 10.0, math.radians((37 * hour + 53 * p) % 360 + 180)
        height = 300.0 + (13 * hour + 17 * p) % 1500 if (hour + p) % 19 else None
        out[p] = (0.0, 0.0, height) if calm else (speed * math.sin(to), speed * math.cos(to), height)
    return out


def cells():
    low = [math.floor((min(v[i] for v in XY.values()) - 2000) / 500) for i in (0, 1)]
    high = [math.ceil((max(v[i] for v in XY.values()) + 2000) / 500) for i in (0, 1)]
    return {(c - low[0], r - low[1]): (c * 500.0, r * 500.0) for c in range(low[0], high[0] + 1) for r in range(low[1], high[1] + 1)}


def rho(dx, dy, u, v):
    speed = math.hypot(u, v)
    eu, ev = (u / speed, v / speed) if speed > 0.1 else (0.0, 1.0)
    long = 10_000 / math.sqrt(2)
    narrow = long / (1 + min(speed / 5, 2)) if speed > 0.1 else long
    return math.exp(-0.5 * (((dx * eu + dy * ev) / long) ** 2 + ((dy * eu - dx * ev) / narrow) ** 2))


def expected(name, hour):
    w = weather_of(hour)
    for (i, j), (x, y) in cells().items():
        if name == "knn_idw_hours":
            near = sorted((math.hypot(x - XY[p][0], y - XY[p][1]), p, h) for p, (_, _, h) in w.items() if h is not None)[:4]
            parts = [(1 / max(d, 1) ** 2, h) for d, _, h in near]
            yield (hour, i, j), [sum(a * h for a, h in parts) / sum(a for a, _ in parts)]
        elif name == "anisotropic_correlation_hours":
            for p, (u, v, _) in w.items():
                yield (hour, i, j, p), [rho(x - XY[p][0], y - XY[p][1], u, v)]
        elif name == "oi_single_observation_hours":
            bc = j % 4 / 4
            spread = min(1, max(0.05, 1 - bc))
            cov = rho(x - XY[2][0], y - XY[2][1], *w[2][:2]) * math.sqrt(spread * 0.7)
            inc = cov * 5.5 / 0.9
            yield (hour, i, j), [max(0, i % 5 + inc), min(1, max(bc, 1 - min(1, max(0, spread - cov * cov / 0.9)))), inc]
        else:
            a = b = 0.0
            for p, (u, v, _) in w.items():
                way = math.hypot(u, v) * 3600
                if way < 500:
                    continue
                rx, ry, px, py = x - XY[p][0], y - XY[p][1], -u * 3600, -v * 3600
                part = min(1, max(500 / way, (rx * px + ry * py) / way**2))
                dx, dy, speed = rx - px * part, ry - py * part, way / 3600
                if math.hypot(dx, dy) > 10_000:
                    continue
                long = 10_000 / math.sqrt(-2 * math.log(0.05))
                along, across = (dx * u + dy * v) / speed, (dy * u - dx * v) / speed
                st = math.exp(-0.5 * ((along / long) ** 2 + (across * (1 + min(speed / 5, 2)) / long) ** 2)) * math.exp(-part) / p
                a, b = a + st * (p * 1.5 - 3), b + st
            yield (hour, i, j), [a / b if b else 0.0, min(1, b)]


VALUES = {
    "knn_idw_hours": ["interpolated"],
    "anisotropic_correlation_hours": ["rho"],
    "oi_single_observation_hours": ["value", "confidence", "increment"],
    "backward_innovation_hours": ["correction", "weight"],
}


@pytest.mark.parametrize("name", VALUES)
def test_grid_queries_of_other_hours_equal_brute_force(spark, name):
    hours = [r.h for r in S.live(spark, SF).select(S.hour_number(F.col("bucket_start")).alias("h")).distinct().collect()]
    # An hour where post 2 has no wind, and one where post 3 has no mixing height.
    chosen = [next(h for h in sorted(hours) if (h + 2) % 11 == 0), next(h for h in sorted(hours, reverse=True) if (h + 3) % 19 == 0)]
    keys = ["hour", "grid_x", "grid_y"] + ["monitoring_post_id"] * (name == "anisotropic_correlation_hours")
    rows = QUERIES[name](spark, SF).filter(F.col("hour").isin(chosen)).collect()
    want = dict(x for h in chosen for x in expected(name, h))
    found = {tuple(r[k] for k in keys): [r[c] for c in VALUES[name]] for r in rows}
    assert len(rows) == len(found) and found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=2e-6)


def test_grid_stations_and_cells_have_all_hours(spark):
    from zephyrframe.plans import catalog

    n = S.live(spark, SF).select("bucket_start").distinct().count()
    assert n > 600
    for df in (catalog._mesh_hours(spark, SF), catalog._stations_hours(spark, SF)):
        assert df.select("hour").distinct().count() == n
