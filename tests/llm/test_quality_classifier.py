import random

import math

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import quality_classifier as C


def tables(spark, n=300):
    r = random.Random(9)
    words = ["".join(r.choice("aeiounst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        good = r.random() < 0.7
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 200)))
        docs.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((k, int(good), 0))
    docs += [(n, None), (n + 1, ""), (n + 2, "x"), docs[0], (None, "no id")]
    labels += [(n, 1, 0), (None, 1, 0), (7, 1 - labels[7][1], 0), (8, None, 0), labels[9]]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = C.train(docs, labels, fold != 0, sample=100)
    assert model == C.train(docs.repartition(5), labels, fold != 0, sample=100)
    out = C.score(docs, model)
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1 or isnan(score)").isEmpty()
    held = out.join(labels.dropna().dropDuplicates(["doc_id"]), "doc_id").filter((fold == 0) & (F.col("doc_id") < 300)).select("score", "quality").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held) / len(held) > 0.95
    empty = out.filter("doc_id in (300, 301)").select("score").distinct().collect()
    assert [r[0] for r in empty] == [pytest.approx(model.prior)]


def test_scores_do_not_depend_on_held_out_labels(spark):
    docs, labels = tables(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    other = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert C.train(docs, labels, fold != 0, sample=50) == C.train(docs, other, fold != 0, sample=50)


def test_without_labels_or_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = C.train(docs, labels, F.lit(True))
    assert {r["score"] for r in C.score(docs, model).collect()} == {0.5}
    assert C.score(no_docs, model).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scores = C.score(docs, C.train(docs, one, F.lit(True)))
    assert scores.filter("score between 0 and 1").count() == docs.count()


def test_sample_bytes_bound_the_texts(spark):
    docs, labels = tables(spark)
    small = C.train(docs, labels, F.lit(True), sample=100, sample_bytes=3000)
    assert len(small.good) <= 70000 and as_set(C.score(docs, small).filter("score is null"), "doc_id") == []


def test_scores_equal_brute_force(spark, docs):
    """Each score again from the model's dictionaries, with a compressor made anew for each block."""
    table, labels = tables(spark)
    model = C.train(table, labels, F.lit(True), sample=100)

    def size(raw, content):
        held = zstandard.ZstdCompressionDict(content)
        return sum(len(zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + model.block])) for i in range(0, len(raw), model.block))

    def brute(text):
        raw = (text or "").encode()
        if not raw:
            return model.prior
        x = model.bias + (model.slope * (size(raw, model.bad) - size(raw, model.good)) + model.lead) / (len(raw) + model.pad)
        return 1 / (1 + math.exp(-max(-500, min(500, x))))

    few = clashing(docs.filter("doc_id % 7 = 0 or doc_id > 130 or doc_id is null"))
    texts = [(r["doc_id"], brute(r["text"])) for r in few.collect()]
    got = [tuple(r) for r in C.score(few, model).select("doc_id", "score").collect()]
    for a, b in zip(sorted(texts, key=repr), sorted(got, key=repr)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_model_is_the_same_where_ids_repeat(spark):
    docs, labels = tables(spark, 120)
    twice = docs.unionByName(docs.select("doc_id", F.reverse("text").alias("text")))
    models = [C.train(twice.repartition(n), labels, F.lit(True), sample=60) for n in (1, 4, 7)]
    assert models[0] == models[1] == models[2]


def test_held_out_rows_of_the_sample_tables(spark):
    """Figures of the README: good rows kept and bad rows rejected among held-out labels."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = C.train(docs, labels, fold != 0)
    held = C.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi").filter(fold == 0), model).join(labels.dropDuplicates(["doc_id"]), "doc_id")
    r = held.agg(*[F.avg(F.when(F.col("quality") == q, (F.col("score") >= 0.3).cast("int"))).alias(f"kept{q}") for q in (0, 1)]).first()
    print(r)
    assert r["kept1"] > 0.98 and r["kept0"] < 0.15
