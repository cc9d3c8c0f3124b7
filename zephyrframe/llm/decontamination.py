"""Benchmark decontamination with a generalised suffix automaton.

Items are lower-cased (A-Z) and cut into words; all their word sequences go
into one suffix automaton. A document's words are streamed through it while the
longest matching length is tracked, so each word costs amortised constant time.
A window is `window` consecutive item words; an item of fewer words, but not
none, is one window. Words inside an occurrence of a window are hit; spans of
hit words are what the operator removes, and a document with `share` times its
hit words at or above its words is contaminated.

The automaton is built once, as flat arrays (about 60 bytes a word), and broadcast,
so its size is checked: items are dealt into blocks of at most `block_words` words
(an item longer than that makes a block of its own), one automaton and one pass
over the documents each. With several blocks a pass writes what it found and its
broadcast is released before the next, so one automaton at a time is held; the
passes' results are joined. The size of a pass never depends on the documents.

Defined results: null texts have no words, no hits and are not contaminated;
null item texts and empty tables hit nothing. Null item ids count as no id in
items_sha256. Repeated rows give repeated results; repeated item ids are one
item each. Rows are told apart by id and text. Only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import kept, materialize, unused

#: Bytes outside words become a space, A-Z become a-z; bytes of non-ASCII characters are word bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The words that `words_of` gives, where they stand in a text.
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: What a pass over the documents gives.
FOUND = ["id", "digest", "n_words", "n_hit", "runs", "items"]


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_TABLE).split()


class ItemAutomaton:
    """A generalised suffix automaton over words, with the windows each state ends.

    States are numbers into flat arrays. A state's first move lies in two of
    them; the few states with more moves have the others in a dictionary.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        short: dict[int, list[tuple[int, int]]] = {}
        paths = []
        for number, words in items:
            state, path = 0, array("i")
            for w in words:
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
                path.append(state)
            paths.append((number, path))
        # Later words may have cloned states, so the places of windows are looked up at the end.
        ends: set[tuple[int, int]] = set()
        for number, path in paths:
            n = len(path)
            if n and n < window:
                short.setdefault(self._holding(path[-1], n), []).append((n, number))
            ends.update((self._holding(state, window), number) for state in path[window - 1 :])
        #: The items of whole windows by state: those of state k are `full[first[k] : first[k + 1]]`.
        size = len(self.length)
        counts = np.bincount([state for state, _ in ends], minlength=size) if ends else np.zeros(size, np.int64)
        self.first = array("i", np.concatenate(([0], np.cumsum(counts))).astype(np.int32).tobytes())
        self.full = array("i", [number for _, number in sorted(ends)])
        #: For each state: the state on its suffix path that ends whole windows, or -1.
        self.anchor = array("i", [-1]) * size
        #: For each state: the nearest state on its suffix path (itself included) that ends short items, or -1.
        self.near = array("i", [-1]) * size
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist():
            up = self.link[state]
            self.anchor[state] = state if counts[state] else self.anchor[up] if up >= 0 else -1
            self.near[state] = state if state in short else self.near[up] if up >= 0 else -1
        self.short = short
        self.shortest = min((n for v in short.values() for n, _ in v), default=window)

    def _move(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        moves = self.more.get(state)
        return moves.get(word, -1) if moves else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _extend(self, last: int, word: int) -> int:
        q = self._move(last, word)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        state = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and (q := self._move(p, word)) < 0:
            self._set(p, word, state)
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return state

    def _state(self, length: int) -> int:
        for held, value in ((self.word, -1), (self.to, -1), (self.link, 0), (self.length, length)):
            held.append(value)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self._move(p, word) == q:
            self._set(p, word, copy)
            p = self.link[p]
        return copy

    def _holding(self, state: int, length: int) -> int:
        """The state on the suffix path whose strings include that of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items whose windows occur."""
        n, window, shortest = len(words), self.window, self.shortest
        first_word, first_to, more, link, lengths, near = self.word, self.to, self.more, self.link, self.length, self.near
        delta = np.zeros(n + 1, np.int64)
        found: set[int] = set()
        whole: set[int] = set()
        state = matched = 0
        for at, word in enumerate(map(self.ids.get, words)):
            if word is None:
                state = matched = 0
                continue
            while True:
                if first_word[state] == word:
                    after = first_to[state]
                    break
                moves = more.get(state)
                if moves is not None and (after := moves.get(word, -1)) >= 0:
                    break
                state = link[state]
                if state < 0:
                    break
                matched = lengths[state]
            if state < 0:
                state = matched = 0
                continue
            state = after
            matched += 1
            if matched < shortest:
                continue
            if matched >= window:
                # Strings of `window` words end here; the state that holds them is on the suffix path.
                delta[at + 1 - window] += 1
                delta[at + 1] -= 1
                whole.add(self.anchor[state])
            u = near[state]
            while u >= 0:
                for size, number in self.short[u]:
                    if size <= matched:
                        delta[at + 1 - size] += 1
                        delta[at + 1] -= 1
                        found.add(number)
                u = near[link[u]] if link[u] >= 0 else -1
        for k in whole:
            found.update(self.full[self.first[k] : self.first[k + 1]])
        return np.cumsum(delta[:-1]) > 0, found

    #: The parts that a scan needs, as plain values.
    PARTS = ("window", "ids", "word", "to", "more", "link", "length", "first", "full", "anchor", "near", "short", "shortest")

    def packed(self) -> bytes:
        """The automaton as bytes of plain values."""
        return pickle.dumps([getattr(self, name) for name in self.PARTS], pickle.HIGHEST_PROTOCOL)

    @classmethod
    def unpacked(cls, content: bytes) -> ItemAutomaton:
        """The automaton of such bytes."""
        out = cls.__new__(cls)
        for name, value in zip(cls.PARTS, pickle.loads(content)):
            setattr(out, name, value)
        return out


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end), end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sent(context, block: list[tuple[str | None, str]], window: int):
    """The automaton of a block of items as a broadcast variable: a name of its own, the items' ids and the packed automaton."""
    packed = ItemAutomaton([(k, words_of(text)) for k, (_, text) in enumerate(block)], window).packed()
    return context.broadcast((uuid.uuid4().hex, [name for name, _ in block], packed))


def _automaton(sent) -> ItemAutomaton:
    """The automaton of a broadcast block, unpacked once in a worker."""
    name, _, packed = sent.value
    return kept("ItemAutomaton", name, lambda: ItemAutomaton.unpacked(packed))


def _scan_batches(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(block)
    names = block.value[1]
    for batch in batches:
        counts, hits, runs, which = [], [], [], []
        for value in batch.column(2):
            words = words_of(value.as_py() or "")
            hit, found = automaton.scan(words)
            counts.append(len(words))
            hits.append(int(hit.sum()))
            runs.append([x for s in spans(hit) for x in s] if found else [])
            which.append(sorted({names[k] for k in found} - {None}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(which, pa.list_(pa.string()))], FOUND)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items as (id as text, text), in blocks of at most `block_words` words.

    toLocalIterator brings one partition of the test items at a time; documents are never brought here.
    """
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        n = len(words_of(row[1] or ""))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        if n:
            block.append((row[0], row[1]))
            size += n
    yield block


def _merge_runs(many: list[list[int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted((x[k], x[k + 1]) for x in many for k in range(0, len(x), 2)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [_merge_runs(x or []) for x in batch.column(4).to_pylist()]
        items = [sorted({i for part in x or [] for i in part}) for x in batch.column(5).to_pylist()]
        hits = [sum(x[1::2]) - sum(x[::2]) for x in runs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hits, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], FOUND)


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    """Rows of one id and one text; null ids are alike."""
    return left["id"].eqNullSafe(right["id"]) & (left["digest"] == right["digest"])


def _found(docs: DataFrame, blocks: Iterable[list[tuple[str | None, str]]], id_col: str, text_col: str, window: int) -> DataFrame:
    """The columns of FOUND for each row of `docs`; digest is a hash of the text."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, digest long, n_words long, n_hit long, runs array<long>, items array<string>"
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    blocks = iter(blocks)
    block, second = next(blocks), next(blocks, None)

    def scanned(held) -> DataFrame:
        return rows.mapInArrow(lambda batches: _scan_batches(held, batches), schema)

    if second is None:
        return scanned(_sent(context, block, window))
    # Several blocks: each pass is written, all rows by the first and rows with hits by the others.
    passes = []
    for k, some in enumerate(chain([block, second], blocks)):
        held = _sent(context, some, window)
        passes.append(materialize(scanned(held) if k == 0 else scanned(held).filter("size(runs) > 0")))
        held.destroy()
    first = passes[0]
    merged = first.filter("size(runs) > 0")
    for part in passes[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("id", "digest", "n_words").agg(F.max("n_hit").alias("n_hit"), F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items"))
    merged = merged.mapInArrow(_merge_blocks, schema)
    own = first.select("id", "digest", "n_words")
    none = {"n_hit": F.lit(0), "runs": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    return own.join(merged, _same_row(own, merged), "left").select(own["id"], own["digest"], own["n_words"], *[F.coalesce(merged[c], v).alias(c) for c, v in none.items()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """id, n_words, n_hit, runs (start, end, start, end, ... of hit words), items: one row for each row of `docs`."""
    return _found(docs, item_blocks(benchmark, item_col, item_text_col, block_words), id_col, text_col, window).drop("digest")


def judge(found: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """The contamination digest: n_words, n_hit, n_items, items_sha256, contaminated."""
    out = found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, share: int = 20, item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """`docs` without its contaminated rows, all columns kept.

    With one block of items, rows are judged where they are read and nothing is
    shuffled. With more, the contaminated rows' ids and digests are joined back.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    block, second = next(blocks), next(blocks, None)
    if second is not None:
        found = _found(docs, chain([block, second], blocks), id_col, text_col, window)
        name, own = unused(docs, "__id", "__digest")
        bad = found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select(F.col("id").alias(name), F.col("digest").alias(own)).distinct()
        return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(own)), "left_anti")
    held = _sent(docs.sparkSession.sparkContext, block, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held)
        for batch in batches:
            keep = []
            for value in batch.column(text_col):
                words = words_of(value.as_py() or "")
                n = int(automaton.scan(words)[0].sum())
                keep.append(not (n and share * n >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut_runs(text: str | None, n_words: int, runs: list[int], min_words: int, share: int) -> tuple[str | None, int]:
    """A text without its runs of at least `min_words` hit words, and how many words went; None if contaminated."""
    n_hit = sum(runs[1::2]) - sum(runs[::2])
    if n_hit and share * n_hit >= n_words:
        return None, n_words
    long_runs = [(s, e) for s, e in zip(runs[::2], runs[1::2]) if e - s >= min_words]
    if not long_runs:
        return text, 0
    places = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    for s, e in reversed(long_runs):
        text = text[: places[s]] + text[places[e] :]
    return text, sum(e - s for s, e in long_runs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, min_words: int = 13, share: int = 20, item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """id, text, removed_words: contaminated texts become null, other texts lose hit spans of at least `min_words` words.

    Removed words take the characters up to the next kept word with them; everything
    else stays as it was. The runs of hit words are joined to the texts by id and
    digest, so a task holds one block's automaton, however many items there are.
    """
    runs = _found(docs, item_blocks(benchmark, item_col, item_text_col, block_words), id_col, text_col, window)
    runs = materialize(runs.filter("size(runs) > 0").select("id", "digest", "n_words", "runs").dropDuplicates(["id", "digest"]))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    joined = rows.join(runs, _same_row(rows, runs), "left").select(rows["id"], rows["text"], "n_words", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [cut_runs(t.as_py(), n, r or [], min_words, share) for t, n, r in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in cut], pa.string()), pa.array([n for _, n in cut], pa.int64())], ["id", "text", "removed_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, text string, removed_words long").withColumnRenamed("id", id_col)
