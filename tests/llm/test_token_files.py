import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import as_set, clashing
from zephyrframe.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_and_random_access():
    r = random.Random(2)
    ids = np.array([r.choice([r.randint(0, 255), r.randint(0, 65535), r.getrandbits(32), 255, 256, 0]) for _ in range(3000)], np.uint32)
    for n in (0, 1, 511, 512, 513, 3000):
        codes = token_files.Codes(token_files.encode(ids[:n]))
        assert len(codes) == n and (codes.slice(0, n) == ids[:n]).all()
        for i in range(0, n, 7):
            assert codes[i] == ids[i]
        for _ in range(20):
            s = r.randint(0, n)
            e = r.randint(s, n)
            assert (codes.slice(s, e) == ids[s:e]).all()
    with pytest.raises(ValueError):
        token_files.Codes(b"oops")
    with pytest.raises(IndexError):
        codes[3000]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(PATH)
    encoder = token_files.WordEncoder(open(PATH, encoding="utf-8").read(), cache=40)
    r = random.Random(4)
    texts = ["it's I'LL", "a,b;;c 12ab3", "<|ENDOFTEXT|> x <|endoftext|>", "ÉTÉ «x» é́", "H̱ ẖ", "", " \n"]
    texts += ["".join(chr(r.choice([32, 10, r.randint(33, 126), r.randint(192, 255), r.randint(160, 0x5FF)])) for _ in range(50)) for _ in range(300)]
    for at in range(0, len(texts), 9):
        some = texts[at : at + 9]
        for t, raw in zip(some, encoder(some, 2)):
            assert np.frombuffer(raw, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


@pytest.mark.parametrize("file_tokens", [1_000_000, 500])
def test_digests_equal_brute_force(docs, doc_rows, file_tokens, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(k, library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t, *_ in doc_rows]
    out = token_files.token_digests(clashing(docs), PATH, path=str(tmp_path / "ids"), file_tokens=file_tokens)
    got = as_set(out, "doc_id", "n_tokens", "ids_crc32")
    assert got == sorted(((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in rows), key=repr)
    at = 0
    for r in sorted(out.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(out.collect(), key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is None, k))


def test_empty_table(no_docs, tmp_path):
    assert token_files.token_digests(no_docs, PATH, path=str(tmp_path / "none")).count() == 0


def test_any_vocabulary_equals_the_library(docs, doc_rows, tmp_path):
    """Files with other rules than the dealt one's are encoded by the library, whole text by whole text."""
    import glob
    import json
    import os

    folder = os.path.dirname(PATH)
    paths = sorted(glob.glob(f"{folder}/*.json"))
    wide = json.load(open(PATH, encoding="utf-8"))
    wide["added_tokens"].append(wide["added_tokens"][-1] | {"id": 70000, "content": "<|wide|>"})
    (tmp_path / "wide.json").write_text(json.dumps(wide), encoding="utf-8")
    assert len(paths) > 1
    for n, path in enumerate([*paths, str(tmp_path / "wide.json")]):
        library = Tokenizer.from_file(path)
        encoder = token_files.WordEncoder(open(path, encoding="utf-8").read())
        texts = ["Hello World 123 ABC", "a <|endoftext|> b<|wide|>", "  two  spaces\n", ""] + [t or "" for _, t, *_ in doc_rows[:20]]
        for t, raw in zip(texts, encoder(texts, 2)):
            assert np.frombuffer(raw, f"<u{2 if encoder.kind == 'H' else 4}").tolist() == library.encode(t, add_special_tokens=False).ids + [2], (path, t)
    out = token_files.token_digests(docs, paths[0], path=str(tmp_path / "ids"))
    library = Tokenizer.from_file(paths[0])
    want = sorted(((k, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for k, t, *_ in doc_rows), key=repr)
    assert as_set(out, "doc_id", "ids_crc32") == want


def test_lookups_read_the_stored_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, PATH, path, file_tokens=700)
    library = Tokenizer.from_file(PATH)
    rows = {r["doc_id"]: r for r in token_files.read_digests(spark, path).collect() if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k in (0, 7, 144):
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        assert {tuple(r["tokens"]) for r in token_files.tokens_of(spark, path, [k]).collect()} == {tuple(ids)}
        for at in {0, len(ids) // 2, len(ids) - 1}:
            assert token_files.token_at(spark, path, rows[k]["start"] + at) == ids[at]
    with pytest.raises(IndexError):
        token_files.token_at(spark, path, 10**12)
    import glob

    import pyarrow.parquet as pq

    kinds = {pq.read_metadata(f).row_group(0).column(c).compression for f in glob.glob(path + "/*.parquet") for c in range(6) if pq.read_metadata(f).num_row_groups}
    assert kinds == {"UNCOMPRESSED"}
