import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import DOC_SCHEMA, as_set, clashing
from zephyrframe.llm import spelling as S

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def make_texts(seed=1):
    """Frequent words with variants of all kinds, anagrams, like letters side by side, and letters of other scripts."""
    r = random.Random(seed)
    base = ["".join(r.choice("aabcdeéü") for _ in range(r.randint(6, 10))) for _ in range(60)] + ["aaaaaaaa", "letters", "lettres", "straßenÀÉ×÷ÿ", "sassafrass"]

    def variant(w):
        at, c = r.randrange(len(w)), r.choice("abcdeéz")
        return r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at:][::-1], w])

    rows = []
    for k in range(150):
        words = [r.choice(base[: 8 if r.random() < 0.7 else None]) for _ in range(r.randint(0, 60))]
        words = [variant(w) if r.random() < 0.12 else w for w in words]
        text = r.choice([" ", ", ", "—", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in words)
        rows.append((k, text, "en", "s", 1))
    rows += [(None, rows[1][1], "en", "s", 1), (200, None, "en", "s", 1), (201, "", "en", "s", 1), (202, "z" * 9000 + "日本語letters" + "y" * 9000, "en", "s", 1), rows[4], rows[4]]
    return rows


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    seen = Counter()
    for k, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            seen[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    forms = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in beside.items() if vs}
    forms = {w: v for w, v in forms.items() if words[v] >= 10 * words[w]}

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted(((w, forms.get(w), root(w), n, len(beside[w]), words.get(forms.get(w))) for w, n in words.items()), key=repr)


@pytest.mark.parametrize("many", [S.MANY, 1])
def test_groups_equal_brute_force(spark, many):
    rows = make_texts()
    docs = clashing(spark.createDataFrame(rows, DOC_SCHEMA)).repartition(3)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 10 and max(r[4] for r in want) > 5
    assert as_set(S.group_variants(docs, many=many), *COLUMNS) == want


def test_shared_documents(docs, doc_rows):
    assert as_set(S.group_variants(docs), *COLUMNS) == brute(doc_rows)


def test_words_are_passed_on_in_bounded_parts(docs, doc_rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "HELD_WORDS", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([str(r[0] or "") for r in doc_rows]), pa.array([r[1] for r in doc_rows])], ["id", "text"])
    total = Counter()
    parts = list(S._count_batches(iter([batch])))
    for part in parts:
        for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            total[w] += n
    monkeypatch.undo()
    (whole,) = S._count_batches(iter([batch]))
    assert len(parts) > 5 and total == dict(zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()))


def test_remainders_are_those_of_the_shorter_words():
    words = ["abcabc", "zzzz", "é", "aéaéb"]
    letters = S.Letters(words)
    whole, less = letters.remainders()
    at = 0
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest:
                assert less[at] == S.Letters([rest]).remainders()[0][0]
                assert letters.keys[letters.word[at]] - letters.powers[at] == S.Letters([rest]).keys[0]
            at += 1
    assert len(whole) == 4 and len(np.unique(whole)) == 4


def test_chains_of_forms_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(17)] + [("x", "w3"), ("y", "z")], "word string, form string")
    got = dict(as_set(S.roots(forms), "word", "root"))
    assert got == {f"w{k}": "w17" for k in range(17)} | {"x": "w17", "y": "z"}
    assert S.roots(forms.limit(0)).count() == 0


def test_empty_table(no_docs):
    assert S.group_variants(no_docs).count() == 0
