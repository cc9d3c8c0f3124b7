"""Meshes are far larger than the boxes they are made of: many tasks make them, and no join holds them whole."""

import math
import random

from pyspark.sql import functions as F

from zephyrframe.operators import grid

QUERIES = "field long, monitoring_post_id long, x double, y double"


def made(seed=5):
    """Queries of three fields: inside, outside, on edges of squares, twice at one place, without a place."""
    r = random.Random(seed)
    rows = [(f, 100 * f + k, r.uniform(-9000, 9000), r.uniform(-9000, 9000)) for f in (1, 2) for k in range(60)]
    rows += [(1, 190, -2000.0, 2000.0), (1, 191, -2000.0, 2000.0), (1, 192, -1999.9, 250.0), (2, 290, 5e4, 0.0), (2, 291, None, 0.0), (9, 900, 0.0, 0.0)]
    return rows


def boxes(spark):
    return spark.createDataFrame([(f, k, x, y) for f in (1, 2) for k, (x, y) in enumerate([(-9000.0, -8000.0), (9000.0, 8500.0)])], QUERIES)


def plan(df):
    """The plan that adaptive execution ended with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_mesh_is_made_by_many_tasks(spark):
    cells = grid.mesh(boxes(spark), ["field"], 500.0, 1000.0)
    tasks = [r["n"] for r in cells.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 1 and max(tasks) < 0.6 * sum(tasks)


def test_nearest_cells_are_those_of_all_pairs_and_are_not_broadcast(spark):
    cells = grid.mesh(boxes(spark), ["field"], 500.0, 1000.0).filter("(grid_x + grid_y) % 3 <> 0")
    cells = cells.withColumn("value", F.when(F.col("grid_x") % 5 != 0, F.col("grid_x") * 1.0 + F.col("grid_y")))
    rows = made()
    out = grid.sample_nearest(spark.createDataFrame(rows, QUERIES), cells, ["field"], ["monitoring_post_id"], "value", 500.0, -1.0)
    assert "BroadcastHashJoin" not in plan(out)
    known = [tuple(c) for c in cells.select("field", "x", "y", "value").collect()]
    want = {}
    for f, post, x, y in rows:
        near = min(((math.hypot(x - cx, y - cy), cx, cy, v) for g, cx, cy, v in known if g == f), default=None, key=lambda n: n[:3]) if x is not None else None
        want[f, post] = near[3] if near and near[0] <= 400 and near[3] is not None else -1.0
    got = {(r["field"], r["monitoring_post_id"]): r["sampled"] for r in out.collect()}
    assert got == want and len(set(want.values())) > 20
