"""The pipeline's stages, each held against brute force on its own input."""

import uuid
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_decontamination, test_mixing, test_quality_rules, test_simhash
from tests.llm.conftest import DOC_SCHEMA, as_set, make_docs


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in make_docs(3, 150)]
    item = " ".join(f"word{i}" for i in range(20))
    rows += [(900, "begin here " + item + " " + rows[1][1], "en", "s1", 1), (901, item.upper() + "; " + item + " and more of it to be long enough", "en", "s2", 1), (902, " ".join(f"v{i} $$$" for i in range(40)), "en", "s2", 1)]
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / uuid.uuid4().hex)
        out.write.parquet(path)
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(path)
        after = [tuple(r) for r in docs.collect()]
        seen.append(name)
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality_rules":
            base = [r for r in before if not test_quality_rules.brute(r[1])[5]]
            assert set(after) <= set(base) and {r[0] for r in base} - {r[0] for r in after} >= {902} and len(after) > 100
        elif name == "near_dedup":
            want = {c for k, _, c in test_simhash.slow_components([r[:2] for r in before]) if k == c and k is not None}
            assert sorted(r[0] for r in after if r[0] is not None) == sorted(want)
        elif name == "decontamination":
            item = [(1, " ".join(f"word{i}" for i in range(20)))]
            want = [r for r in before if not test_decontamination.brute(r[1], item)[4]]
            assert sorted(after, key=repr) == sorted(want, key=repr) and len(after) < len(before)
        elif name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r[3]] += test_mixing.size(r[1])
            for r in after:
                taken[r[3]] += test_mixing.size(r[1])
            for s, t in test_mixing.targets(sizes).items():
                largest = max(test_mixing.size(r[1]) for r in before if r[3] == s)
                assert abs(taken[s] - t) <= max(0.02 * t, largest / 2)
            assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 2
        else:
            assert len(after) == len(before) and as_set(docs, "doc_id") == sorted(((r[0],) for r in before), key=repr)
            places = defaultdict(list)
            for r in docs.collect():
                places[r["shard"]].append(r["slot"])
            assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert seen == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0
    assert as_set(out, "doc_id", "shard", "slot") == as_set(corpus_pipeline.run(spark, sf_dir), "doc_id", "shard", "slot")


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_result_is_left_in_the_shared_folder(spark, docs, tmp_path):
    import os

    import corpus_pipeline
    from zephyrframe.llm import common

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("sharding-") and out.count() > 0
