import zlib
from collections import defaultdict

import pytest
import xxhash

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import sharding as S


def test_places_and_balance(docs, doc_rows):
    out = S.shard_rows(clashing(docs), shards=4)
    raw = [(t or "").encode() for _, t, *_ in doc_rows]
    assert as_set(out, "doc_id", "size", "text_crc32") == sorted(((r[0], len(b) + 1, zlib.crc32(b)) for r, b in zip(doc_rows, raw)), key=repr)
    loads, places, owner = defaultdict(int), defaultdict(list), {}
    for r in out.collect():
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert owner.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert set(loads) == set(range(4)) and max(loads.values()) - min(loads.values()) <= max(len(b) + 1 for b in raw)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = S.shard_rows(docs.repartition(7), shards=4)
    assert as_set(out, "doc_id", "shard", "slot") == as_set(again, "doc_id", "shard", "slot")


def test_growing_moves_rows_to_the_new_shard_only(spark, docs, tmp_path):
    rows = S.materialize(S.sized_rows(docs))
    sums = S.materialize(S.slot_bytes(rows))
    first = S.materialize(S.slot_map(sums, 3))
    second = S.grow_map(first, sums, 3)
    before, after = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (first, second))
    assert before.keys() == after.keys() == set(range(S.SLOTS)) and all(after[k] in (v, 3) for k, v in before.items()) and 3 in after.values()
    for m in (first, second):
        S.write_map(m, str(tmp_path / "map"))
    assert {r["version"] for r in spark.read.parquet(str(tmp_path / "map")).select("version").distinct().collect()} == {1, 2}
    placed = S.shard_rows(docs, 4, mapping=second.drop("version"))
    assert placed.count() == docs.count()


def test_empty_table(no_docs):
    assert S.shard_rows(no_docs).count() == 0


def test_stored_map_loses_and_doubles_no_rows(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    few = S.materialize(S.slot_bytes(S.sized_rows(docs.orderBy("doc_id").limit(5))))
    first = S.materialize(S.slot_map(few, 3))
    second = S.materialize(S.grow_map(first, few, 3))
    for m in (first, second):
        S.write_map(m, path)
    placed = S.shard_rows(docs, 4, mapping=spark.read.parquet(path)).collect()
    assert len(placed) == docs.count()
    latest = {r["virtual_slot"]: r["shard"] for r in second.collect()}
    assert len(latest) == S.SLOTS and all(r["shard"] == latest[r["virtual_slot"]] for r in placed)
    part = spark.read.parquet(path).filter("virtual_slot < 2000")
    held = {k: v for k, v in latest.items() if k < 2000}
    assert all(r["shard"] == held.get(r["virtual_slot"], r["virtual_slot"] % 4) for r in S.shard_rows(docs, 4, mapping=part).collect())
    for k in range(4):
        mine = sorted(r["slot"] for r in placed if r["shard"] == k)
        assert mine == list(range(len(mine)))


def brute(rows, shards, slots=S.SLOTS, grow=False):
    """Slots by XXH64 of id and checksum, the heaviest first to the lightest shard, and places in the order of slot, id and checksum."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    placed = []
    for k, text in rows:
        raw = (text or "").encode()
        h = 42 if k is None else xxhash.xxh64(k.to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(zlib.crc32(raw).to_bytes(8, "little"), seed=h).intdigest()
        placed.append((signed(h) % slots, k, zlib.crc32(raw), len(raw) + 1))
    weight = defaultdict(int)
    for v, *_, size in placed:
        weight[v] += size
    loads, shard = [0] * shards, {}
    for v in sorted(weight, key=lambda v: (-weight[v], v)):
        shard[v] = min(range(shards), key=lambda k: (loads[k], k))
        loads[shard[v]] += weight[v]
    if grow:
        return placed, weight, shard
    seen, out = defaultdict(int), []
    for v, k, crc, size in sorted(placed, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
        out.append((k, size, crc, v, shard[v], seen[shard[v]]))
        seen[shard[v]] += 1
    return sorted(out, key=repr)


def test_shards_and_places_equal_brute_force(docs, doc_rows, tmp_path, spark):
    columns = ("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot")
    path = str(tmp_path / "map")
    assert as_set(S.shard_rows(clashing(docs), 16, map_path=path), *columns) == brute([r[:2] for r in doc_rows], 16)
    stored = spark.read.parquet(path)
    assert stored.count() == S.SLOTS and {r[0] for r in stored.select("version").distinct().collect()} == {1}


def test_two_runs_under_one_path_give_equal_rows(docs, tmp_path):
    path = str(tmp_path / "map")
    columns = ("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot")
    first, second = (as_set(S.shard_rows(docs, 5, map_path=path), *columns) for _ in range(2))
    assert first == second and len(first) == docs.count() and S.stored_versions(docs.sparkSession, path) == [1]


def test_a_version_is_written_once_and_slots_are_unique(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    first = S.materialize(S.slot_map(S.slot_bytes(S.sized_rows(docs)), 3))
    S.write_map(first, path)
    with pytest.raises(FileExistsError):
        S.write_map(first, path)
    with pytest.raises(Exception, match="slot twice"):
        S.latest_version(first.unionByName(first)).collect()


def test_repeated_rows_spread_over_all_shards(spark):
    rows = spark.range(20_000).select(S.F.lit(None).cast("long").alias("doc_id"), S.F.lit("").alias("text"))
    rows = rows.unionByName(spark.range(9_000).select(S.F.lit(5).cast("long").alias("doc_id"), S.F.lit("a text").alias("text"))).repartition(6)
    runs = []
    for _ in range(2):
        out = S.shard_rows(rows, 16).collect()
        loads, places = defaultdict(int), defaultdict(list)
        for r in out:
            loads[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert len(out) == 29_000 and len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 7
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        runs.append(sorted(map(repr, out)))
    assert runs[0] == runs[1]


def test_numbering_is_in_stretches(spark, monkeypatch):
    monkeypatch.setattr("zephyrframe.llm.common.HOT_ROWS", 10)
    monkeypatch.setattr(S, "NUMBERED", 7)
    rows = S.materialize(S.sized_rows(spark.createDataFrame([(k % 3 or None, "x") for k in range(100)] + [(9, "y")], "doc_id long, text string")))
    spread = S.spread_repeats(rows)
    assert as_set(spread.drop("virtual_slot"), "id", "size", "text_crc32") == as_set(rows, "id", "size", "text_crc32")
    assert spread.filter("id is null").select("virtual_slot").distinct().count() > 25
    assert spread.filter("id = 9").collect() == rows.filter("id = 9").select(*spread.columns).collect()


def test_rebalancing_equals_brute_force(spark, docs, doc_rows, tmp_path):
    path = str(tmp_path / "map")
    placed, weight, shard = brute([r[:2] for r in doc_rows], 4, grow=True)
    fair, grown = sum(weight.values()) / 5, {}
    for k in range(4):
        surplus = sum(weight[v] for v in shard if shard[v] == k) - fair
        upto = 0
        # Slots without rows are the lightest of all, so they come first and change no sum.
        for v in sorted((v for v in shard if shard[v] == k), key=lambda v: (weight[v], v)):
            upto += weight[v]
            grown[v] = 4 if upto <= surplus else k
    want = sorted(((k, size, crc, v, shard[v], grown[v]) for v, k, crc, size in placed), key=repr)
    got = S.rebalance(clashing(docs), 4, map_path=path)
    assert as_set(got, "doc_id", "size", "text_crc32", "virtual_slot", "shard", "grown_shard") == want
    assert any(r[4] != r[5] for r in want) and S.stored_versions(spark, path) == [1, 2]
    # Later readers of the path get the edited map.
    later = S.shard_rows(docs, 5, map_path=path)
    assert as_set(later, "doc_id", "text_crc32", "shard") == sorted(((r[0], r[2], r[5]) for r in want), key=repr)
    moved = sum(r[1] for r in want if r[4] != r[5])
    assert moved <= fair
