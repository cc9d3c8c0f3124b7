import hashlib
import random
import re

import pytest

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, window=13):
    w = words(doc)
    hit, found = set(), set()
    for name, text in items:
        v = words(text)
        if not v:
            continue
        size = min(window, len(v))
        own = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in own:
                hit |= set(range(i, i + size))
                found.add(name)
    named = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture(seed=7):
    r = random.Random(seed)
    vocabulary = ["aa", "bb", "cc", "Dé", "e9"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 9, 13, 14, 20, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (None, "zz yy xx"), (102, "...")]
    docs = []
    for k in range(80):
        text = " ".join(r.choice([*vocabulary, "other", "Bb,"]) for _ in range(r.randint(0, 60)))
        if k % 3 == 0:
            text += "; " + items[k % 25][1].upper() + " tail " * r.randint(0, 400)
        docs.append((k, text))
    return [*docs, (200, None), (201, ""), (202, "zz YY, xx"), docs[0], (0, "zz yy xx"), (None, "zz yy xx aa"), (None, "two other words aa")], items


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_hits_equal_brute_force(spark, block_words):
    rows, items = fixture()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.judge(D.find_contamination(docs, bench, block_words=block_words))
    want = sorted(((k, *brute(t, items)) for k, t in rows), key=repr)
    assert as_set(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    docs = docs.withColumns({"__id": D.F.lit("x"), "__digest": D.F.lit("y")})
    kept = D.remove_contaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(w[0]) for w in want if not w[5])


def test_automaton_on_long_random_items():
    r = random.Random(11)
    items = [(str(k), " ".join(r.choice("abc") for _ in range(r.randint(1, 200)))) for k in range(12)]
    automaton = D.ItemAutomaton([(k, D.words_of(t)) for k, (_, t) in enumerate(items)], 13)
    automaton = D.ItemAutomaton.unpacked(automaton.packed())
    for _ in range(60):
        doc = " ".join(r.choice("abcd") for _ in range(300))
        hit, found = automaton.scan(D.words_of(doc))
        want = brute(doc, items)
        assert (len(hit), int(hit.sum()), len(found)) == want[:3]


@pytest.mark.parametrize("block_words", [100_000, 10])
def test_spans_are_removed(spark, block_words):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b, " + item.upper() + ". " + "c d " * 300), (2, item), (3, "clean text"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "other words of an item"), (3, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in D.remove_spans(docs, bench, block_words=block_words).collect()}
    assert got[1] == ("a b, " + "c d " * 300, 20) and got[2] == (None, 20) and got[3] == ("clean text", 0) and got[4] == (None, 0)


def test_empty_tables(spark, no_docs, docs, doc_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(no_docs, none).count() == 0
    out = D.judge(D.find_contamination(docs, none))
    assert out.count() == len(doc_rows) and out.filter("contaminated or n_hit > 0 or n_items > 0").isEmpty()
