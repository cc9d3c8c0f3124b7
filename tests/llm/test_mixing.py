import re
from collections import defaultdict

import pytest

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]} if total else set()
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over


@pytest.mark.parametrize("weights,share", [((5, 2, 1), 1.5), ((1, 30, 2), 0.4)])
def test_targets_and_taken_words(docs, doc_rows, weights, share):
    out = M.mix(clashing(docs), weights=weights, share=share)
    rows = out.collect()
    assert as_set(out, "doc_id", "source", "size") == sorted(((r[0], r[3], size(r[1])) for r in doc_rows), key=repr)
    sizes = defaultdict(int)
    for r in doc_rows:
        sizes[r[3]] += size(r[1])
    want, taken = targets(sizes, weights, share), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s in sizes:
        largest = max(size(r[1]) for r in doc_rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.5 * largest if largest > 0.2 * sizes[s] else 3), s
    assert as_set(out, "doc_id", "taken") == as_set(M.mix(docs.repartition(5), weights=weights, share=share), "doc_id", "taken")


def test_rates_follow_the_tilt(docs):
    """Within a source, strata of one size get equal rates, and the rates rise or fall with size alone."""
    rows = M.materialize(docs.select(M.F.col("doc_id").alias("id"), "source", M.word_count(M.F.col("text")).alias("size")))
    sources = M.source_targets(rows, (5, 2, 1), 1.5, 2)
    strata = rows.join(sources.select("s", "source", "source_size", "n_rows"), "source").groupBy("s", "size", "source_size", "n_rows").agg(M.F.count("*").alias("n"))
    strata = strata.select("s", "size", M.F.lit(1).cast("long").alias("m"), "n", M.F.col("size").alias("unit"), (M.F.col("size") * M.F.col("n_rows") / M.F.col("source_size")).alias("x"))
    import math

    tilts = {r["s"]: r["tilt"] for r in M.solve_tilts(strata, sources, 2).collect()}
    wanted = {r["s"]: r["target"] for r in sources.collect()}
    taken = defaultdict(float)
    for r in strata.collect():
        if tilts[r["s"]] is not None:
            taken[r["s"]] += r["n"] * r["unit"] * min(2, math.exp(tilts[r["s"]] * r["x"]))
    for s, t in taken.items():
        assert t == pytest.approx(wanted[s], rel=1e-8)


def test_large_stratum_and_repeated_ids(spark):
    rows = [(k, "same words in all of them", "a", "hot", 1) for k in range(5000)] + [(1, "one two three", "a", "rep", 1)] * 40 + [(k, "x y " * k, "a", "b", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = defaultdict(list)
    for r in M.mix(docs, weights=(1, 1, 1)).collect():
        got[r["source"]].append(r)
    for s in ("hot", "b"):
        assert abs(sum(r["taken"] for r in got[s]) - got[s][0]["target"]) <= 5
    assert len({r["copies"] for r in got["rep"]}) == 1 and len(got["rep"]) == 40
    docs = docs.withColumns({c: M.F.lit("x") for c in ("__id", "__source", "__size", "__copies", "__words", "__copy")})
    mixed = M.mixed_rows(docs, weights=(1, 1, 1))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for v in got.values() for r in v)


def test_empty_table(no_docs):
    assert M.mix(no_docs).count() == 0 and M.mixed_rows(no_docs).count() == 0


def test_tilts_that_do_not_settle_raise(spark):
    strata = spark.createDataFrame([(1, 10, 1, 5, 10, 1.0)], "s int, size long, m long, n long, unit long, x double")
    sources = spark.createDataFrame([(1, "a", 50, 5, 77.0)], "s int, source string, source_size long, n_rows long, target double")
    with pytest.raises(ArithmeticError):
        M.solve_tilts(strata, sources, 2, rounds=1)
