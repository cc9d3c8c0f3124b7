import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import boosting as B

NAMES = ["a", "b", "c", "empty"]


def table(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = r.random(), r.choice([None, r.random(), float("nan")]), float(r.randrange(4))
        missing = b is None or b != b
        rows.append((a, b, c, None, (3.0 if missing else 2 * b) + (a > 0.4) * c))
    return spark.createDataFrame(rows, "a double, b double, c double, empty double, y double").repartition(3)


def error(df):
    return df.agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]


@pytest.mark.parametrize("block", [B.BLOCK, 100])
def test_trees_learn_and_missing_values_have_a_side(spark, block, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "CUT", 4)
    trees = B.Booster(NAMES, "y", 30, 4, 0.3).fit(table(spark))
    assert trees.feature.shape == (30, 31) and not (trees.feature == 3).any()
    held = table(spark, 300, 2).withColumn("p", trees.column())
    plain = held.agg(F.avg(F.abs(F.col("y") - F.lit(trees.base)))).first()[0]
    assert error(held) < 0.15 * plain
    assert error(held.filter("b is null or isnan(b)")) < 0.2 * plain
    back = B.Trees.from_json(trees.to_json())
    assert [r["p"] for r in held.withColumn("p", back.column()).orderBy("a").collect()] == [r["p"] for r in held.orderBy("a").collect()]


def test_one_block_and_many_grow_the_same_trees(spark, monkeypatch):
    df = table(spark).persist()
    one = B.Booster(NAMES, "y", 6, 3, 0.3).fit(df)
    monkeypatch.setattr(B, "BLOCK", 200)
    many = B.Booster(NAMES, "y", 6, 3, 0.3).fit(df)
    assert one.edges == many.edges
    x = np.random.default_rng(1).random((4, 50)) * 3
    assert np.allclose(one.predict(one.bins(x)), many.predict(many.bins(x)), atol=0.05)


def test_first_cut_equals_brute_force(spark):
    df = table(spark, 200)
    trees = B.Booster(NAMES, "y", 1, 1, 1.0).fit(df)
    rows = np.array([[np.nan if v is None else v for v in r] for r in df.collect()], float).T
    bins, y = trees.bins(rows[:4]), rows[4] - trees.base
    best = max(
        (sum(y[m].sum() ** 2 / (m.sum() + B.SHRINK) for m in (left, ~left)), f, b, side)
        for f in range(4) for b in range(B.BINS) for side in (False, True)
        for left in [np.where(bins[f] == B.BINS, side, bins[f] <= b)] if left.any() and (~left).any()
    )
    f, b, side = trees.feature[0, 0], trees.bin[0, 0], trees.missing_left[0, 0]
    left = np.where(bins[f] == B.BINS, side, bins[f] <= b)
    assert np.isclose(sum(y[m].sum() ** 2 / (m.sum() + B.SHRINK) for m in (left, ~left)), best[0])
    assert np.allclose(trees.value[0, 1:], [y[left].sum() / (left.sum() + B.SHRINK), y[~left].sum() / ((~left).sum() + B.SHRINK)])


def test_tables_without_rows_or_differences(spark):
    df = table(spark, 20)
    empty = B.Booster(NAMES, "y", 3, 2, 0.3).fit(df.limit(0))
    assert [r[0] for r in df.select(empty.column()).distinct().collect()] == [0.0]
    same = B.Booster(NAMES, "y", 3, 2, 0.3).fit(df.withColumn("y", F.lit(2.0)))
    assert (same.feature < 0).all() and [r[0] for r in df.select(same.column()).distinct().collect()] == [2.0]
