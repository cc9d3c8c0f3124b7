import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import as_set
from zephyrframe.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def make_vectors(seed=3, n=150, dimension=32):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dimension)] for _ in range(12)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(centres)], r.choice([0, 1, 2, None])) for k in range(n)]
    rows += [(n, rows[3][1], 1), (n + 1, rows[3][1], None), rows[5], rows[5], (None, rows[7][1], 2)]  # ties, repeated rows, no id
    rows += [(-1, None, 1), (-2, [], 1), (-3, [math.nan] + [0.0] * (dimension - 1), 0), (-4, [math.inf] + [0.0] * (dimension - 1), 0), (-5, [None] + [0.5] * (dimension - 1), 0)]
    return [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in rows]


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * x) for x in v], c) for k, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    lowest = {}
    for k, v, _ in kept:
        if k is not None:
            lowest[k] = min(v, lowest.get(k, v))
    starts = [lowest[k] for k in sorted(lowest)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in starts] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                mine.setdefault(near(x, books[p])[1], []).append(x)
            for i, xs in mine.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for k, v, c in kept:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), c))
        total[c] = total.get(c, 0) + out[-1][2]
    return sorted(((k, code, e, total[c], digest) for k, code, e, c in out), key=repr)


@pytest.mark.parametrize("chunk", [V.CHUNK, 40])
@pytest.mark.parametrize("entries", [64, 5])
def test_codes_equal_brute_force(spark, chunk, entries):
    rows = make_vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("id", "v", "known", "none", "code", "error")})
    assert as_set(V.compress(table, chunk=chunk, entries=entries), *COLUMNS) == brute(rows, entries=entries)


def test_one_vector_many_times_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr("zephyrframe.llm.common.HOT_ROWS", 20)
    rows = make_vectors(4, 60)
    rows += [(1000 + k, rows[0][1], 7) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert as_set(V.compress(table), *COLUMNS) == brute(rows)


def test_filtering_equals_all_distances():
    r = np.random.default_rng(1)
    for n, width, spread in ((1, 4, 9), (15, 2, 3), (1000, 4, 6), (3000, 3, 200)):
        points, entries = r.integers(-spread, spread, (n, width)), r.integers(-spread, spread, (64, width))
        away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        tree = V.KdTree(points)
        found, error = V.nearest(tree, entries)
        assert (found == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
        sums, counts = V.sums_by_entry(tree, entries)
        assert (counts == np.bincount(found, minlength=64)).all() and all((sums[k] == points[found == k].sum(axis=0)).all() for k in range(64))


def test_whole_subtrees_are_assigned():
    r = np.random.default_rng(2)
    entries = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    points = entries[r.integers(0, 4, 20_000)] + r.integers(-300, 300, (20_000, 2))
    looked = sum(len(items) for items, _, whole in V.filtered(V.KdTree(points), entries) if not whole)
    assert looked < 400


def test_empty_tables_and_missing_ids(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    only = V.compress(spark.createDataFrame([(None, [0.5] * 16, 1)], SCHEMA)).collect()
    assert [(r["code"], r["error"], r["codebooks_sha256"]) for r in only] == [(None, None, None)]


@pytest.mark.parametrize("rows", [[(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], [(1, [0.5] * 20, 1)], [(1, [1e30] * 16, 1)]])
def test_unfit_vectors_are_refused(spark, rows):
    with pytest.raises(Exception, match="dimensions differ|equal parts|64 bits"):
        V.compress(spark.createDataFrame(rows, SCHEMA)).count()
