import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library(docs, doc_rows):
    library = Tokenizer.from_file(PATH)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in doc_rows), key=repr)
    out = token_count.count_tokens(clashing(docs), PATH)
    assert as_set(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_odd_texts_equal_the_library():
    library = Tokenizer.from_file(PATH)
    counter = token_count.MergeCounter(open(PATH, encoding="utf-8").read(), cache=50)
    r = random.Random(3)
    texts = ["a<|endoftext|>b<|endoftext|>", "<|endoftext|>  <|endoftext", "\x1c\x1d  \n x", "I'll 'S 'tis", "   ", "a" * 3000, "日本語 ４５  x", "\U0001f600"]
    texts += ["".join(chr(r.choice([32, 9, 10, r.randint(33, 126), r.randint(160, 0x2FFF)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert counter(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_empty_table(no_docs):
    assert token_count.count_tokens(no_docs, PATH).count() == 0


def test_other_rules_are_refused():
    with pytest.raises(ValueError):
        token_count.MergeCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
