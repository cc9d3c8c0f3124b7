import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import DOC_SCHEMA, as_set, clashing
from zephyrframe.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((rows[i][0], f"{prints[i]:016x}", low.get(find(i))) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("tile", [8192, 3])
def test_components_equal_brute_force(docs, doc_rows, tile):
    out = simhash.near_duplicates(clashing(docs), tile=tile)
    assert as_set(out, "doc_id", "fingerprint", "component_id") == slow_components([r[:2] for r in doc_rows])


def test_links_equal_brute_force_on_random_prints(spark):
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(12):
            q = p
            for b in r.sample(range(64), r.randint(1, 6)):
                q ^= 1 << b
            prints.add(q)
    chain = r.getrandbits(64)
    for b in range(0, 64, 3):
        chain ^= 7 << b & (1 << 64) - 1
        prints.add(chain)
    values = sorted(prints)
    root = list(range(len(values)))
    simhash.merge_labels(label := np.array(root), *np.nonzero(np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None, :]) <= 4))
    want = {}
    for i, v in enumerate(values):
        want.setdefault(label[i], set()).add(simhash._signed(v))
    for distinct, tile in ((1000, 8192), (60_000_000, 8192), (6_000_000_000, 5), (1000, 2)):
        df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
        roots = {x["fp"]: x["root"] for x in simhash.components(simhash.links(df, distinct, 4, tile)).collect()}
        got = {}
        for v in values:
            got.setdefault(roots.get(simhash._signed(v), simhash._signed(v)), set()).add(simhash._signed(v))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark, docs, doc_rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for k, _, c in slow_components([r[:2] for r in doc_rows]) if k == c and k is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    # Rows without an id stay only where their group has no other: of the two, the one without text has near copies.
    assert ids.count(None) == 1
    assert simhash.keep_one(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    r = random.Random(2)
    first, second = (" ".join(str(r.random()) for _ in range(60)) for _ in range(2))
    for order in (0, 1):
        rows = [(3, first), (5, second), (5, first), (5, second), (6, second)]
        docs = spark.createDataFrame(rows[::-1] if order else rows, "doc_id long, text string").repartition(3)
        assert as_set(simhash.keep_one(docs), "doc_id", "text") == [(3, first), (5, second)]


def test_groups_of_rows_without_ids_keep_one_row(spark):
    r = random.Random(4)
    a, b, c = (" ".join(str(r.random()) for _ in range(60)) for _ in range(3))
    rows = [(None, a), (None, a), (None, b), (5, b), (5, c), (6, c), (5, a)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert as_set(simhash.keep_one(docs), "doc_id", "text") == sorted([(5, a), (5, b), (5, c)], key=repr)
    alone = spark.createDataFrame([(None, a), (None, a), (7, b)], "doc_id long, text string")
    assert as_set(simhash.keep_one(alone), "doc_id", "text") == sorted([(None, a), (7, b)], key=repr)


def test_hot_groups_are_split_without_loss(docs, doc_rows, monkeypatch):
    monkeypatch.setattr("zephyrframe.llm.common.HOT_ROWS", 2)
    out = simhash.near_duplicates(clashing(docs))
    assert as_set(out, "doc_id", "fingerprint", "component_id") == slow_components([r[:2] for r in doc_rows])
    kept = simhash.keep_one(clashing(docs).withColumns({"__own": simhash.F.lit("x"), "__id": simhash.F.lit("y"), "__digest": simhash.F.lit("z")}))
    want = {c for k, _, c in slow_components([r[:2] for r in doc_rows]) if k == c and k is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)


def test_rounds_of_components_are_logarithmic(spark):
    # An ascending run that hangs on a smaller fingerprint at its top, and a shuffled chain.
    n = 1000
    r = random.Random(3)
    names = r.sample(range(10**6, 2 * 10**6), n)
    chains = [(k, k + 1) for k in range(1, n - 1)] + [(n - 1, 0)] + list(zip(names, names[1:]))
    edges = spark.createDataFrame(chains, "a long, b long").coalesce(1)
    got = {x["fp"]: x["root"] for x in simhash.components(edges, rounds=20).collect()}
    assert got == {k: 0 for k in range(n)} | {k: min(names) for k in names}
    with pytest.raises(ArithmeticError):
        simhash.components(edges, rounds=3)


def test_of_rows_alike_in_id_and_text_the_least_stays(spark):
    text = " ".join(str(k * k) for k in range(60))
    rows = [(k, text, "en", s, 1) for k in (3, None) for s in ("b", "a", None, "c")] + [(None, "other words " * 9, "en", s, 2) for s in ("z", "y")]
    kept = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        kept.add(tuple(as_set(simhash.keep_one(spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)), "doc_id", "source")))
    # JSON leaves nulls out, and then "n_chars" comes before "source".
    assert kept == {tuple(sorted([(3, None), (None, "y")], key=repr))}
