"""Spelling variants by anagram hashing.

Words are counted over all texts. A word's key is the sum of the fifth powers of its
letters, so anagrams share a key, and one letter more, one less or another letter
changes it by a power, minus a power or the difference of two. A word is therefore
laid under its own key and under its key less each of its letters: two words meet under
one key exactly if their keys differ by such a value. Where they meet, letter order is
verified: the words less a letter at one place must be equal (for an exchange), or the
one less a letter must be the other. So no pairs are formed only to be rejected.

A key's words are read in one sorted stream, a key at a time. Keys whose anagrams are
many are known from counts; their words are dealt out further by a hash of the word less
the letter, which near words share, so none of their links is lost and no task holds them all.

A form's count is at least ten times its word's, so chains of forms end; roots are
found by doubling.

Defined results: a null text has no words. Repeated rows count each. A word without near
words has n_near 0, no form, and is its own root. Empty tables give no rows. Ids of any
type are read as text; a null id is read as nothing. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import hot_keys, join_spread, materialize

LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR, SLIP = 7, 2, 10, 31
#: Words that a task counts before it passes them on, and anagrams above which a key is dealt out further.
HELD_WORDS, MANY = 300_000, 2_000

#: Latin-1 characters: letters A-Z in small, small letters and 00C0 to 00FF as they are, all others as a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Fifth powers of the letters' codes; sums may wrap around 64 bits, which only lets more words meet.
_POWERS = (np.arange(256, dtype=np.int64) ** 5).astype(np.uint64)


def slipped(id_text: str, text: str) -> list[bytes]:
    """The long words of a text as Latin-1 letters, with a letter missing where the checksum of id and word says so."""
    words = [w for w in text.encode("latin-1", "replace").translate(_LETTERS).split(b" ") if len(w) >= LEAST_LETTERS]
    seed = zlib.crc32(f"{id_text}:".encode())
    crc = zlib.crc32
    sums = [crc(w, seed) for w in words] if text.isascii() else [crc(w if w.isascii() else w.decode("latin-1").encode(), seed) for w in words]
    for i, h in enumerate(sums):
        if not h % SLIP:
            w = words[i]
            at = h % len(w)
            words[i] = w[:at] + w[at + 1 :]
    return words


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        found = [(w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS]
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    for batch in batches:
        for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            if text:
                held.update(slipped(k, text))
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the long words that occur often enough; counted where they are read, so a frequent word is shuffled once a task."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_count_batches, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Letters:
    """Letters of many words side by side: `flat` codes, `word` number and `place` of each, `starts` and `sizes` of words, and the words' `keys`."""

    def __init__(self, words: list[str]):
        self.flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.flat)) - self.starts[self.word]
        self.powers = _POWERS[self.flat]
        self.keys = np.add.reduceat(self.powers, self.starts) if len(words) else np.zeros(0, np.uint64)

    def remainders(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and for each letter of the word without it."""
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(int(self.sizes.max(initial=0)) + 1, base, np.uint64))
        code = self.flat.astype(np.uint64) + np.uint64(1)
        before, after = code * powers[self.place], code * powers[self.place - 1]  # letters behind the missing one move up
        sum_before, sum_after = np.cumsum(before), np.cumsum(after)
        start = self.starts[self.word]
        ends = start + self.sizes[self.word] - 1
        left = sum_before - before - (sum_before[start] - before[start])
        right = sum_after[ends] - sum_after
        return np.add.reduceat(before, self.starts) if len(self.starts) else before, left + right


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under its own key and under its key less each of its letters."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            letters = Letters(part.column(0).to_pylist())
            distinct = np.unique(letters.word * 256 + letters.flat)
            owner, letter = distinct // 256, distinct % 256
            rows = np.concatenate((np.arange(part.num_rows), owner))
            keys = np.concatenate((letters.keys, letters.keys[owner] - _POWERS[letter])).view(np.int64)
            chosen = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(chosen), part.column(1).take(chosen)], ["key", "word", "n"])


def _deal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys with many words, once for each place of the missing letter, under a key that also holds the letters left."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(1).to_pylist()
        letters = Letters(words)
        whole, less = letters.remainders()
        key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        own = np.nonzero(letters.keys == key)[0]
        spot = np.nonzero(letters.keys[letters.word] - letters.powers == key[letters.word])[0]
        rows = np.concatenate((own, letters.word[spot]))
        sub = np.concatenate((whole[own], less[spot]))
        dealt, index = np.unique(np.stack((rows.astype(np.uint64), sub), axis=1), axis=0, return_index=True)
        chosen = pa.array(rows[index])
        mixed = key[rows[index]] ^ (dealt[:, 1] * np.uint64(0xD6E8FEB86659FD93))
        yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), batch.column(0).take(chosen), batch.column(1).take(chosen), batch.column(2).take(chosen)], ["cell", "key", "word", "n"])


def near_words(cells: np.ndarray, keys: np.ndarray, words: list[str], counts: list[int]) -> dict[int, list]:
    """For rows that are sorted by cell: row -> [near words, the best one's -n, the best one] of those with near words in their cell."""
    edge = np.concatenate(([True], cells[1:] != cells[:-1], [True]))
    crowd = np.nonzero(~(edge[:-1] & edge[1:]))[0]
    if not len(crowd):
        return {}
    letters = Letters([words[r] for r in crowd.tolist()])
    whole, less = letters.remainders()
    key = keys[crowd].view(np.uint64)
    own = np.nonzero(letters.keys == key)[0]
    # Letters whose removal gives the key; each place of them is a possible place of the change.
    spot = np.nonzero(letters.keys[letters.word] - letters.powers == key[letters.word])[0]
    rows = np.concatenate((own, letters.word[spot]))
    place = np.concatenate((np.full(len(own), -1), letters.place[spot]))
    rest = np.concatenate((whole[own], less[spot]))
    cell = cells[crowd][rows]
    order = np.lexsort((rest, cell))
    same = (cell[order][1:] == cell[order][:-1]) & (rest[order][1:] == rest[order][:-1])
    edge = np.concatenate(([False], same, [False]))
    order = order[edge[:-1] | edge[1:]]
    # Rows that may have a like: now with the letters themselves, so equal hashes decide nothing.
    met: dict[tuple, dict[int, list[int]]] = {}
    for c, r, p in zip(cell[order].tolist(), rows[order].tolist(), place[order].tolist()):
        row = int(crowd[r])
        w = words[row]
        met.setdefault((c, w if p < 0 else w[:p] + w[p + 1 :]), {}).setdefault(p, []).append(row)
    found: dict[int, list] = {}

    def add(row: int, n: int, best: tuple[int, str]) -> None:
        known = found.get(row)
        if known is None:
            found[row] = [n, best]
        else:
            found[row] = [known[0] + n, min(known[1], best)]

    for spots in met.values():
        shorter = spots.pop(-1, None)
        if shorter is not None and spots:
            # One word, met by each longer one once, whichever of like letters is the missing one.
            longer = sorted({r for rows in spots.values() for r in rows})
            me = (-counts[shorter[0]], words[shorter[0]])
            for r in longer:
                add(r, 1, me)
            add(shorter[0], len(longer), min((-counts[r], words[r]) for r in longer))
        for rows in spots.values():
            if len(rows) > 1:
                ranked = sorted((-counts[r], words[r], r) for r in rows)
                for r in rows:
                    best = ranked[0] if ranked[0][2] != r else ranked[1]
                    add(r, len(rows) - 1, best[:2])
    return {row: [n, *best] for row, (n, best) in found.items()}


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, so a cell is complete when the next begins."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cells, keys = (table.column(k).to_numpy() for k in (0, 1))
        words = table.column(2).to_pylist()
        found = near_words(cells, keys, words, table.column(3).to_pylist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([words[r] for r in found], pa.string()), *[pa.array([x[k] for x in found.values()], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]], ["word", "near", "minus", "form"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        if cell[0] == cell[-1] and held[0].column(0)[0].as_py() == cell[-1]:
            continue  # still the same cell
        table = pa.Table.from_batches(held)
        last = int(np.searchsorted(cell, cell[-1]))
        whole = table.num_rows - (len(cell) - last)
        yield from out(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield from out(pa.Table.from_batches(held))


def near_counts(words: DataFrame, many: int = MANY) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n; distinct) that have near words."""
    keyed = words.mapInArrow(_key_batches, "key long, word string, n long")
    # Words of a key less a letter have keys one power above it, so only near a crowded key can many words meet.
    own = words.mapInArrow(_own_keys, "key long").groupBy("key").count().filter(F.col("count") > many).select("key")
    crowded = materialize(own)
    cells = keyed.select(F.col("key").alias("cell"), "key", "word", "n")
    if not crowded.isEmpty():
        around = crowded.mapInArrow(_around_batches, "key long").distinct()
        around = materialize(around)
        cells = cells.join(around, "key", "left_anti").select("cell", "key", "word", "n")
        cells = cells.unionByName(keyed.join(around, "key", "left_semi").select("key", "word", "n").mapInArrow(_deal_batches, "cell long, key long, word string, n long"))
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_near_batches, "word string, near long, minus long, form string")
    summed = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus", "form")).alias("best"))
    return summed.select("word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.form").alias("best"))


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(Letters(batch.column(0).to_pylist()).keys.view(np.int64))], ["key"])


def _around_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys and those one letter below them."""
    steps = np.concatenate((np.zeros(1, np.uint64), _POWERS[[c for c in range(256) if _LETTERS[c] == c and c != 32]]))
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((keys[:, None] - steps[None]).reshape(-1).view(np.int64))], ["key"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), found by doubling; chains are finite, as counts grow."""
    known = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(8):  # 2 ** 8 steps, while counts of 64 bits allow 19
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        going = materialize(known.join(after.select("root"), "root", "left_semi").select("word", "root"))
        if going.isEmpty():
            return known
        moved = join_spread(going, after, ["root"], "word", hot_keys(going, ["root"])).select("word", F.col("next").alias("root"))
        known = materialize(known.join(going.select("word"), "word", "left_anti").unionByName(moved))
    raise ArithmeticError("a chain of forms has no end")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    words = materialize(word_counts(docs, id_col, text_col))
    near = near_counts(words, many)
    enough = F.col("best_n") >= FORM_FACTOR * F.col("n")
    judged = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
