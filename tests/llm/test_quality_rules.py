import random
import re
from collections import Counter

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeat = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def test_measures_equal_brute_force(spark, docs, doc_rows):
    r = random.Random(1)
    rows = [(k, "".join(r.choice(["a ", "b ", "c\n", " # ", "é|", "a b a b a b a b a b ", "a\n", "\x85", " "]) for _ in range(r.randint(0, 90)))) for k in range(150)]
    for table, source in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, [x[:2] for x in doc_rows])):
        out = Q.apply_policy(Q.ledger(clashing(table)))
        got = as_set(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((k, *brute(t)) for k, t in source), key=repr)
        assert out.filter("base_failed and kept").isEmpty()


def test_policies_and_ablations(spark):
    junk = ["TO THE END! " * 3 + " ".join(f"W{i}" for i in range(30)).upper(), "### a " * 25, "x y\n" * 30]
    clean = " ".join(f"word{i}" for i in range(60))
    book = Q.ledger(spark.createDataFrame([(k, t) for k, t in enumerate([*junk, clean, "short"])], "doc_id long, text string"))
    assert {r["doc_id"] for r in Q.apply_policy(book).filter("kept").collect()} == {3}
    by = {r["rule"]: (r["failed"], r["rejected_alone"]) for r in Q.ablations(book).collect()}
    assert by["few_words"][0] == 1 and by["symbols"][0] == 1 and by["capitals"][0] >= 1 and set(by) == {n for n, _ in Q.RULES}
    assert Q.mask("base") == 3 and Q.mask("production") == Q.mask("production", 2) != Q.mask("production", 1)
    assert Q.policy_table(spark).count() == len(Q.POLICIES)


def test_stored_ledger_serves_all_policies(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    book = Q.stored_ledger(docs, path=path)
    assert as_set(book, *book.columns) == as_set(Q.ledger(docs), *book.columns)
    assert as_set(Q.read_ledger(spark, path), *book.columns) == as_set(Q.stored_ledger(docs, path=path), *book.columns)


def test_rows_that_pass_stay_whole(docs):
    docs = clashing(docs).withColumns({"__measures": Q.F.lit("x"), "measures": Q.F.lit("y")})
    kept = Q.keep_passing(docs)
    assert kept.schema == docs.schema
    want = Q.apply_policy(Q.ledger(docs)).filter("kept")
    assert as_set(kept, "doc_id") == as_set(want, "doc_id")


def test_empty_table(no_docs):
    assert Q.ledger(no_docs).count() == 0 and Q.keep_passing(no_docs).count() == 0
