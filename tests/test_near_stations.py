"""Nearest stations by squares and swept paths by squares, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import grid

CELLS = "key int, grid_x int, grid_y int, x double, y double"
STATIONS = "key int, monitoring_post_id long, x double, y double, value double"


def places(seed):
    """Clusters, far stations, ties, one place twice, keys with fewer stations than asked for, one without any."""
    r = random.Random(seed)
    stations = [(1, k, r.gauss(0, 50), r.gauss(0, 50), r.random()) for k in range(60)] + [(1, 100 + k, r.uniform(-9e4, 9e4), r.uniform(-9e4, 9e4), r.random()) for k in range(15)]
    stations += [(2, k, 1000.0 * (k % 3), 1000.0 * (k // 3), float(k)) for k in range(9)] + [(2, 20, 0.0, 0.0, 5.0)]
    stations += [(3, 1, 5.0, 5.0, 1.0), (3, 2, -7.0, 1e5, 3.0), (4, 1, 0.0, 0.0, None), (4, 2, None, 0.0, 1.0)]
    cells = [(key, i, j, x, y) for key in (1, 2, 3, 4) for i in range(8) for j in range(8) for x, y in [(500.0 * i, 500.0 * j)]]
    cells += [(1, 99, k, r.uniform(-2e5, 2e5), r.uniform(-2e5, 2e5)) for k in range(20)]
    return cells, stations


def idw(cell, stations, k):
    near = sorted((math.hypot(cell[3] - x, cell[4] - y), p, v) for key, p, x, y, v in stations if key == cell[0] and v is not None and x is not None)[:k]
    if len(near) == 1 or near[0][0] <= 1e-9:
        return near[0][2]
    weights = [1 / max(d, 1) ** 2 for d, *_ in near]
    return sum(w * n[2] for w, n in zip(weights, near)) / sum(weights)


@pytest.mark.parametrize("k", [1, 4])
def test_rings_give_what_all_pairs_give(spark, k):
    cells, stations = places(3)
    out = grid.nearest_idw(spark.createDataFrame(cells, CELLS).repartition(3), spark.createDataFrame(stations, STATIONS), ["key"], ["grid_x", "grid_y"], "value", k).collect()
    got = {(r["key"], r["grid_x"], r["grid_y"]): r["interpolated"] for r in out}
    want = {c[:3]: idw(c, stations, k) for c in cells if c[0] != 4}
    assert len(out) == len(want) and got == pytest.approx(want, rel=1e-12)


def test_cells_meet_few_stations(spark, monkeypatch):
    n, met = 10_000, []
    stations = spark.createDataFrame([(1, k, *random.Random(k).sample(range(100_000), 2), 1.0) for k in range(n)], "key int, monitoring_post_id long, x long, y long, value double")
    cells = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").cast("int").alias("grid_x"), F.lit(0).alias("grid_y"), (F.col("id") % 141 * 709.0).alias("x"), (F.expr("id div 141") * 703.0).alias("y"))
    hypot = F.hypot

    def counted(a, b):
        met.append(1)
        return hypot(a, b)

    monkeypatch.setattr(grid.F, "hypot", counted)
    near = grid.nearest_stations(cells, stations.select("key", "monitoring_post_id", F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"), F.col("value").alias("v")), ["key"], ["grid_x", "grid_y"], 4)
    assert near.count() == 20_000 and near.filter(F.size("near") != 4).isEmpty()
    # A block of nine squares holds 12 stations on average; twice the side, 48.
    assert len(met) <= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_swept_paths_give_what_all_pairs_give(spark, seed):
    r = random.Random(seed)
    stations = [(key, k, r.uniform(-6e4, 6e4), r.uniform(-6e4, 6e4), r.choice([None, r.gauss(0, 2)]) if k else 1.0, r.random(), r.uniform(-12, 12), r.choice([0.0, r.uniform(-12, 12)])) for key in (1, 2) for k in range(12)] + [(3, 1, 0.0, 0.0, 1.0, 1.0, 0.01, 0.0)]
    cells = [(key, i, j, i * 4000.0 - 80_000, j * 4000.0 - 80_000) for key in (1, 2, 3) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(stations, "key int, monitoring_post_id long, x double, y double, innovation double, confidence double, u double, v double")
    out = grid.backward_correction(spark.createDataFrame(cells, CELLS), df, ["key"], ["grid_x", "grid_y"], 500.0).collect()
    got = {(x["key"], x["grid_x"], x["grid_y"]): (x["correction"], x["weight"]) for x in out}
    assert len(out) == len(got) == 3200
    for key, i, j, x, y in cells[:3200]:
        a = b = 0.0
        for k, _, sx, sy, innovation, trust, u, v in stations:
            way = math.hypot(u, v) * 3600
            if k != key or innovation is None or way < 500:
                continue
            px, py = -u * 3600, -v * 3600
            part = min(1, max(500 / way, ((x - sx) * px + (y - sy) * py) / way**2))
            dx, dy, speed = x - sx - px * part, y - sy - py * part, way / 3600
            if math.hypot(dx, dy) <= 10_000:
                long = 10_000 / math.sqrt(-2 * math.log(0.05))
                along, across = (dx * u + dy * v) / speed, (dy * u - dx * v) / speed
                st = math.exp(-0.5 * ((along / long) ** 2 + (across * (1 + min(speed / 5, 2)) / long) ** 2)) * math.exp(-part) * trust
                a, b = a + st * innovation, b + st
        assert got[key, i, j] == pytest.approx((a / b if b else 0.0, min(1, b)), abs=1e-9)
