"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut at added special tokens, then into pieces by the split pattern;
each piece starts as its bytes and the lowest-rank adjacent pair is merged
until none is left. A piece's count is its first symbols minus its merges, so
no token identifier is ever written.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows
give repeated results. Only the id and text columns are read, so other columns
may have any names. Texts of any length are counted whole: a piece of n bytes
takes O(n log n).
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import kept

#: Fixed values of the byte-level split rule: contractions, letters, digits, others, white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^{S}\p{L}\p{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: White space as the Unicode property has it (the control characters 1C-1F do not belong to it).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


def byte_level(spec: dict) -> bool:
    """Whether a vocabulary file has the rules that are counted here: byte-level pieces by SPLIT, no normaliser, plain merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    pieces = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    special = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("normalized", "lstrip", "rstrip", "single_word"))
    return model.get("type") == "BPE" and plain and pieces and special and not spec.get("normalizer")


class MergeCounter:
    """Counts tokens of texts; holds ranks by symbol pair and a bounded cache of pieces. Raises for other rules than `byte_level`."""

    def __init__(self, vocabulary: str, cache: int = 400_000):
        spec = json.loads(vocabulary)
        if not byte_level(spec):
            raise ValueError("the vocabulary isn't a byte-level one without normaliser, so its tokens can't be counted by these merges")
        ids = spec["model"]["vocab"]
        self.base = [ids[s] for s in byte_symbols()]
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(SPLIT.replace("{S}", SPACES)).findall
        self.cache: dict[str, int] = {}
        self.cache_size = cache

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        symbols = [self.base[b] for b in text.encode()]
        n = len(symbols)
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else n
            if j >= n or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                found = ranks.get(merged << 32 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get(symbols[h] << 32 | merged)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbols[h], merged))
        return count

    def __call__(self, text: str) -> int:
        """Tokens of a whole text, special strings inside it counting one each."""
        total = 0
        parts = [text]
        if self.cut is not None and any(s in text for s in self.specials):
            parts = self.cut.split(text)
            total = len(parts) - 1
        cache = self.cache
        for part in parts:
            pieces = self.pieces(part)
            try:
                total += sum(map(cache.__getitem__, pieces))
                continue
            except KeyError:
                pass
            for p in pieces:
                n = cache.get(p)
                if n is None:
                    n = self.piece(p)
                    # Those seen first stay: they are the frequent ones.
                    if len(p) <= 64 and len(cache) < self.cache_size:
                        cache[p] = n
                total += n
        return total


def _count_batches(counter: MergeCounter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, tokens = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            sizes.append(len(text.encode()))
            tokens.append(counter(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_tokens, over_limit.

    The vocabulary file (a few MB, fixed) is read once on the driver and sent as
    a broadcast variable. There is no shuffle: rows are counted where they are read.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = vocabulary.value
        # A worker that runs several tasks goes on with the pieces it knows.
        return _count_batches(kept("MergeCounter", zlib.crc32(text.encode()), lambda: MergeCounter(text)), batches)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
