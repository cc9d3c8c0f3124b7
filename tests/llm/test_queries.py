"""The registered queries themselves, on small tables: contracts that the operators' own tests don't reach."""

import math
import zlib

import duckdb
import pytest

from tests.llm.conftest import DOC_SCHEMA, make_docs
from tests.llm.test_vector_codes import SCHEMA, make_vectors
from zephyrframe.llm import common, queries
from zephyrframe.llm.oracles import ORACLES

TABLES = "documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = make_docs(5, 90)
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(make_vectors(), SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_every_query_gives_a_row_for_each_document(spark, sf_dir):
    n = common.read_table(spark, sf_dir, "documents").count()
    for name, query in queries.QUERIES.items():
        if name not in ("op3_chat_format", "quality_rule_ablations", "op11_spelling_variants", "op13_vector_codes"):
            assert query(spark, sf_dir).count() == n, name


def test_probe_conversation_is_there(spark, sf_dir):
    r = {r["conv_id"]: r for r in queries.op3_chat_format(spark, sf_dir).collect()}
    assert r[-7]["n_turns"] == 2 and r[-7]["loss_chars"] == len("\\### Assistant: </turn> ok")


def test_fold_of_scores(spark, sf_dir):
    for r in queries.op8_quality_scores(spark, sf_dir).collect():
        k = r["doc_id"]
        assert r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_law_of_shards(spark, sf_dir):
    rows = queries.op9_sharding(spark, sf_dir).collect()
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and {r["shard"] for r in rows} <= set(range(16))


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    columns = sorted(df.columns)
    named = [d[0] for d in cursor.description]
    assert columns == sorted(named)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_scratch_tables_go_at_the_end_of_their_block(spark, tmp_path):
    import os

    with common.scratch(spark):
        inside = common.materialize(spark.range(3))
        where = inside.inputFiles()[0].removeprefix("file://")
        assert inside.count() == 3 and os.path.exists(where)
    assert not os.path.exists(where)


def test_shared_folder_must_be_named_off_one_machine():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session)
