import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import DOC_SCHEMA, as_set, clashing
from zephyrframe.llm import shingle_join as J

COLUMNS = ("doc_id", "n_shingles", "component_id")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, len(sets[i]), low.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def make_texts(seed=1):
    """A large group of near copies, chains of small changes, a passage that many share, copies at the very limit, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(90):
        copy = base[:]
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(120)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(80)]
    for k in range(12):
        chain[6 * k] = word()
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(r.randint(20, 60))] + passage + [word() for _ in range(20)]) for _ in range(80)]
    for n in range(6, 60, 7):  # one shared prefix; the limit is met or missed by one shingle
        a = [word() for _ in range(n)]
        for extra in (n // 5, n // 5 + 1, n // 4, n // 4 + 1):
            texts.append(" ".join(a + [word() for _ in range(extra)]))
        texts.append(" ".join(a).upper())
    texts += ["one two three", "One  two\tthree", "one two", "one", "", None, None, " \n"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[0], rows[0], (None, texts[0]), (None, "only here " * 7), (None, "only here " * 7), (None, "")]


@pytest.mark.parametrize("many, tile_sets, tile_shingles", [(J.MANY, J.TILE_SETS, J.TILE_SHINGLES), (5, 8, 10_000), (1, 4, 500), (1000, 16, 10**6)])
def test_components_equal_brute_force(spark, many, tile_sets, tile_shingles):
    rows = make_texts()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    assert as_set(J.similar_documents(docs, many=many, tile_sets=tile_sets, tile_shingles=tile_shingles), *COLUMNS) == brute(rows)


def test_shared_documents(docs, doc_rows, monkeypatch):
    monkeypatch.setattr(J, "LISTED", 3)
    monkeypatch.setattr(J, "TEXT_BYTES", 500)
    monkeypatch.setattr("zephyrframe.llm.common.HOT_ROWS", 2)
    assert as_set(J.similar_documents(docs), *COLUMNS) == brute([r[:2] for r in doc_rows])


def test_sets_don_t_depend_on_how_texts_are_taken_together(doc_rows, monkeypatch):
    texts = [r[1] for r in doc_rows]
    together = [x.tolist() for x in J.sets_of(pa.array(texts))]
    assert [len(x) for x in together] == [len(shingles(t)) for t in texts]
    for size in (1, 50, 3000):
        monkeypatch.setattr(J, "TEXT_BYTES", size)
        assert [x.tolist() for x in J.sets_of(pa.array(texts))] == together
    monkeypatch.undo()
    assert [x.tolist() for x in J.sets_of(pa.array(texts)[7:30])] == together[7:30]


@pytest.mark.parametrize("split", [0, 40])
def test_overlaps_are_exact(split):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(90)]
    got = J.overlaps(sets, split, tall=5, width=16)
    rows, columns = (range(split), range(split, 90)) if split else (range(90), range(90))
    for i, a in enumerate(rows):
        for j, b in enumerate(columns):
            if a < b:
                assert got[i, j] == len(np.intersect1d(sets[a], sets[b]))


def test_empty_table_and_bad_limits(no_docs):
    assert J.similar_documents(no_docs).count() == 0
    for percent in (40, 79, 101):
        with pytest.raises(ValueError):
            J.similar_documents(no_docs, percent=percent)


def test_products_of_columns(monkeypatch):
    r = np.random.default_rng(5)
    size = [1, 2, 5, 1, 9, 3, 1]
    shingle = np.repeat(np.arange(7), size)
    n = r.integers(8, 12, 22)
    table = [pa.array(shingle), pa.array(r.permutation(22)), pa.array(n), pa.array(r.integers(0, 99, 22).astype(np.int32))]
    batch = pa.RecordBatch.from_arrays(table, ["shingle", "s", "n", "last"])

    def found(parts, most):
        return sorted((x["a"], x["b"], x["need"]) for out in J._pair_batches(80, most, iter(parts)) for x in out.to_pylist())

    names = table[1].to_pylist()
    want = sorted((min(names[i], names[j]), max(names[i], names[j])) for i in range(22) for j in range(i) if shingle[i] == shingle[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]))
    for pairs in (1, 4, 1000):
        monkeypatch.setattr(J, "PAIRS", pairs)
        assert [x[:2] for x in found([batch], 100)] == want
        assert found([batch.slice(k, 3) for k in range(0, 22, 3)], 100) == found([batch], 100)
    star = [x for x in found([batch], 4) if x[2] == 0]
    assert len(star) >= 4 + 8
