"""Versions of stored tables: a failure at any step leaves the version before, and no writer's rows are lost."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators.field import FRAME_TYPES
from zephyrframe.sources import frame_store, snapshots, store

ROW = "k int, day int, v double"
PUT = (["k", "day"], ["day"])


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def content(df):
    return sorted(tuple(r) for r in df.select("k", "day", "v").collect())


@pytest.fixture
def path(spark, tmp_path):
    out = str(tmp_path / "t")
    assert store.upsert(spark, out, rows(spark, (1, 0, 1.0), (2, 1, 2.0)), *PUT) == 1
    return out


@pytest.mark.parametrize("step", ["write", "list", "move", "after the move"])
def test_a_failure_between_steps_leaves_a_whole_version(spark, path, monkeypatch, step):
    real, moved = snapshots.publish, step == "after the move"

    def broken(*given):
        if moved:
            real(*given)
        raise OSError(step)

    new = rows(spark, (1, 0, 5.0), (3, 2, 3.0))
    if step == "write":
        new = new.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit(step)).cast("double")).otherwise(F.col("v")))
    elif step == "list":
        monkeypatch.setattr(snapshots.Staging, "put", lambda self, df, real=snapshots.Staging.put: broken() if "writer" in df.columns else real(self, df))
    else:
        monkeypatch.setattr(snapshots, "publish", broken)
    with pytest.raises(Exception, match=step):
        store.upsert(spark, path, new, *PUT)
    monkeypatch.undo()
    assert content(store.read(spark, path)) == ([(1, 0, 5.0), (2, 1, 2.0), (3, 2, 3.0)] if moved else [(1, 0, 1.0), (2, 1, 2.0)])
    folders = [n for n in os.listdir(path) if n.startswith("written_by=")]
    assert len(folders) == (2 if moved else 1) and os.listdir(f"{path}/_staging") == []
    store.upsert(spark, path, rows(spark, (1, 0, 6.0)), *PUT)
    assert (1, 0, 6.0) in content(store.read(spark, path))


def test_the_second_of_two_writers_is_refused(spark, path):
    base = snapshots.version(spark, path)
    assert snapshots.put(spark, path, rows(spark, (7, 0, 7.0)), ["day"], base) == 2
    before = set(os.listdir(path))
    with pytest.raises(snapshots.Conflict):
        snapshots.put(spark, path, rows(spark, (8, 1, 8.0)), ["day"], base)
    with pytest.raises(snapshots.Conflict):
        store.rewrite(spark, path, rows(spark).limit(0), rows(spark, (2, 1, 2.0)), ["day"], base=1)
    assert content(store.read(spark, path)) == [(2, 1, 2.0), (7, 0, 7.0)] and set(os.listdir(path)) == before


def test_writers_at_once_lose_no_rows(spark, path):
    failed = []

    def write(k):
        try:
            store.upsert(spark, path, rows(spark, (k, 0, float(k)), (k, k, float(k))), *PUT)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in (10, 11, 12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    expected = [(1, 0, 1.0), (2, 1, 2.0)] + [(k, d, float(k)) for k in (10, 11, 12) for d in (0, k)]
    assert not failed and content(store.read(spark, path)) == sorted(expected) and snapshots.latest(spark, path) == 4


def test_readers_keep_their_version(spark, path):
    held, first = store.read(spark, path), store.read(spark, path, 1)
    store.upsert(spark, path, rows(spark, (1, 0, 9.0)), *PUT)
    store.drop_partitions(spark, path, F.col("day") == 1, ["day"])
    assert content(held) == content(first) == [(1, 0, 1.0), (2, 1, 2.0)]
    assert content(store.read(spark, path)) == [(1, 0, 9.0)] and content(store.read(spark, path, 2)) == [(1, 0, 9.0), (2, 1, 2.0)]


def test_vacuum_removes_what_no_version_left_names(spark, path):
    for v in (5.0, 6.0):
        store.upsert(spark, path, rows(spark, (1, 0, v)), *PUT)
    assert snapshots.vacuum(spark, path) == 0  # all is younger than a day
    os.makedirs(f"{path}/written_by=wcrashed")
    assert snapshots.vacuum(spark, path, hours=-1) == 2  # what 5.0 wrote and the crashed writer's
    assert snapshots.latest(spark, path) == 3 and content(store.read(spark, path)) == [(1, 0, 6.0), (2, 1, 2.0)]
    assert os.listdir(f"{path}/_versions") == ["v00000003"]


def test_names_nulls_types_and_an_emptied_table(spark, tmp_path):
    path = str(tmp_path / "t")
    values = [(1, "a b:c", 1.0), (2, None, 2.0), (3, "007", 3.0)]
    store.upsert(spark, path, spark.createDataFrame(values, "k int, p string, v double"), ["k", "p"], ["p"])
    assert sorted(tuple(r) for r in store.read(spark, path).select("k", "p", "v").collect()) == sorted(values, key=lambda r: r[0])
    store.upsert(spark, path, spark.createDataFrame([(3, "007", 4)], "k int, p string, v int"), ["k", "p"], ["p"])
    assert store.read(spark, path).schema["v"].dataType.simpleString() == "double"
    assert store.drop_partitions(spark, path, F.col("p") == "a b:c", ["p"]) == 1
    rest = store.read(spark, path)
    store.rewrite(spark, path, rest.limit(0), rest, ["p"])
    assert store.exists(spark, path) and store.read(spark, path).count() == 0 and store.read(spark, path).schema == rest.schema
    store.upsert(spark, path, spark.createDataFrame(values[:1], "k int, p string, v double"), ["k", "p"], ["p"])
    assert store.read(spark, path).count() == 1


def test_a_folder_without_versions_is_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not store.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    rows(spark, (1, 0, 1.0)).write.partitionBy("day").parquet(path)
    with pytest.raises(ValueError, match="without versions"):
        store.upsert(spark, path, rows(spark, (1, 0, 1.0)), *PUT)


def test_frame_hashes_add_up(spark):
    """Order and split don't matter, every lost, doubled or exchanged cell does, and no frame is gathered."""
    coded = frame_store.encode(spark.range(200).select(*[F.lit(k).alias(k) for k in ("substance_code", "data_kind")], F.timestamp_seconds(F.lit(0)).alias("hour_start"), *[F.col("id").cast(t).alias(c) for c, t in FRAME_TYPES.items()])).persist()
    of = lambda cells: cells.select("content_sha256").first()[0]
    whole = of(frame_store.frame_hash(coded))
    assert of(frame_store.frame_hash(coded.repartition(7).orderBy(F.desc("grid_x")))) == whole
    one = coded.filter("grid_x = 3")
    for other in (coded.filter("grid_x <> 3"), coded.unionAll(one), coded.filter("grid_x <> 4").unionAll(one)):
        assert of(frame_store.frame_hash(other)) != whole
    plan = frame_store.frame_hash(coded)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan
    coded.unpersist()
