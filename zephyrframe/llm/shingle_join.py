"""Documents that share most of their word shingles, by a blocked sparse matrix product.

Texts are lower-cased (A-Z) and cut into words at white space; a document's set has its
distinct 5-word shingles, with fewer words the whole sequence. Two sets link when their
intersection is at least `percent` of their union. The incidence matrix of sets and
shingles times its transpose has the intersections' sizes; it is worked out so:

1. Sets are made one for each content, so copies are never paired.
2. Leading columns. Shingles have one order for all: by hash, but those of many sets last.
   A set of n must share one of its first n - ceil(percent n) + 1 with any that links to it.
   Over these columns alone products are accumulated for each pair, and a pair goes
   where the sizes differ too much, or where its count and all that can still follow stay
   below the least overlap that the two sizes allow.
3. Blocks. The pairs left join sets to blocks, outside of which no two sets can link. A set
   that leads with a shingle of many sets joins that shingle's block, so no pairs are
   formed for such columns.
4. Each block is multiplied over all of its columns, dense tiles for columns of many
   sets and pair counts for the others. Blocks above a bound are cut to tiles by size class,
   and only tiles of like or adjoining classes meet. A tile gives a spanning star.

Shingles and sets are named by 64-bit hashes (words by a polynomial, mixed over five
words), so among n shingles about n * n / 2 ** 65 pairs are taken for one.

Defined results: a document without words has n_shingles 0, its own id as component_id
and no links. component_id is the smallest id that can be reached; null ids never become
one, so a group of null ids only has a null component_id. Repeated rows give repeated
results. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import join_spread, materialize
from zephyrframe.llm.simhash import components, merge_labels

SHINGLE, PERCENT = 5, 80
#: Sets that share a leading shingle above which it comes last, such shingles at most (so they may be broadcast), and rows of a broadcast list.
MANY, MANY_SHINGLES, LISTED = 64, 1_000_000, 1_000_000
#: Shingles and sets of a tile, and text bytes that are hashed at once.
TILE_SHINGLES, TILE_SETS, TEXT_BYTES = 1_000_000, 1_024, 2_000_000
#: Pairs that are formed at once.
PAIRS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_FOLD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of the words of bytes; keeps the powers it has worked out."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        if len(data) >= len(self.up):
            back = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data) + 1024, b, np.uint64)))) for b in (_BASE, back))
        gap = np.concatenate(([True], _SPACE[data], [True]))
        starts, ends = np.nonzero(gap[:-1] & ~gap[1:])[0], np.nonzero(~gap[:-1] & gap[1:])[0]
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * self.up[: len(data)], dtype=np.uint64)))
        return mixed((upto[ends] - upto[starts]) * self.down[starts]), starts


def _long_text(words: WordHashes, data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, a part at a time; parts end at white space."""
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + TEXT_BYTES)
        while stop < len(data) and not _SPACE[data[stop]]:
            ahead = np.nonzero(_SPACE[data[stop : stop + TEXT_BYTES]])[0]
            stop = stop + int(ahead[0]) if len(ahead) else min(len(data), stop + TEXT_BYTES)
        found.append(words(data[at:stop])[0])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if not n:
        return words
    if n < size:
        return mixed(np.add.reduce(words * _FOLD[:n], keepdims=True) + np.uint64(n))
    folded = words[: n - size + 1] * _FOLD[0]
    for k in range(1, size):
        folded += words[k : n - size + 1 + k] * _FOLD[k]
    out = np.sort(mixed(folded))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; short texts are hashed together."""
    words = WordHashes()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    valid = np.asarray(texts.is_valid())
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, side="right")) - 1)
        stop = min(stop, len(texts))
        if stop == at + 1:
            yield shingle_set(_long_text(words, data[offsets[at] : offsets[stop]]) if valid[at] else np.zeros(0, np.uint64))
        else:
            # A white-space byte parts the texts, so no word runs from one into the next.
            part, edges = data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
            spaced = np.insert(part, edges[1:-1], 32)
            hashes, starts = words(spaced)
            cuts = np.searchsorted(starts, edges[:-1] + np.arange(stop - at)).tolist()
            for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(hashes)])):
                yield shingle_set(hashes[s:e] if valid[at + k] else hashes[:0])
        at = stop


def leading(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a set of n lead: any set that links has one of them."""
    return n - -(-percent * n // 100) + 1


def _count_batches(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        shingles, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    for batch in batches:
        for found in sets_of(batch.column(0)):
            if len(found):
                held.append(found[: leading(len(found), percent)])
                n += len(held[-1])
            if n > TILE_SHINGLES:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def frequent_shingles(docs: DataFrame, text_col: str = "text", percent: int = PERCENT, many: int = MANY) -> np.ndarray:
    """The shingles that lead more than `many` documents, from the least frequent; the bound doubles while there are more than MANY_SHINGLES."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _count_batches(percent, b), "shingle long, n long")
    often = materialize(counted.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > many))
    while often.count() > MANY_SHINGLES:
        many *= 2
        often = often.filter(F.col("n") > many)
    table = often.orderBy("n", "shingle").select("shingle").toArrow()
    return table.column(0).to_numpy().astype(np.int64).view(np.uint64)


def set_digest(found: np.ndarray) -> int:
    """A signed 64-bit name of a set's content."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(found ^ np.uint64(0x2545F4914F6CDD1D))) + np.uint64(len(found)) * np.uint64(_BASE)
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _own_batches(percent: int, often: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest, s (the set's name), n, its leading shingles, those of them that are frequent, and the rank of the last."""
    rank = np.argsort(often)
    listed = often[rank]
    for batch in batches:
        names, sizes, lead, held, last = [], [], [], [], []
        for found in sets_of(batch.column(2)):
            names.append(set_digest(found) if len(found) else 0)
            sizes.append(len(found))
            if not len(found):
                lead.append(found.view(np.int64))
                held.append(lead[-1])
                last.append(0)
                continue
            take = leading(len(found), percent)
            spot = np.minimum(np.searchsorted(listed, found), max(0, len(listed) - 1))
            late = listed[spot] == found if len(listed) else np.zeros(len(found), bool)
            plain = found[~late][:take]
            lead.append(plain.view(np.int64))
            behind = found[late][np.argsort(rank[spot[late]])][: take - len(plain)]
            held.append(behind.view(np.int64))
            last.append((1 << 31) - 1 if len(behind) else int(plain[-1] >> np.uint64(33)))

        def lists(parts: list) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists(lead), lists(held), pa.array(last, pa.int32())], ["id", "digest", "s", "n", "lead", "held", "last"])


def _pair_batches(percent: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, s, n, last) sorted by shingle -> (a, b, need): a product of one in each shared column, and the least sum that the pair needs.

    A column of more than `most` sets, which the order of shingles leaves few of, ties its sets to the first one, without a bound.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def columns(shingle: np.ndarray, s: np.ndarray, n: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate(([0], np.nonzero(np.diff(shingle))[0] + 1, [len(shingle)]))
        size = np.diff(start)
        base, size = start[:-1][size > 1], size[size > 1]
        # A set of a column meets the ones before it; in a long column the first only.
        rows = np.arange(size.sum()) + np.repeat(base - (np.cumsum(size) - size), size)
        first, long = np.repeat(base, size), np.repeat(size > most, size)
        before = np.where(long, np.minimum(rows - first, 1), rows - first)
        upto = np.cumsum(before)
        for at in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            mine = slice(*np.searchsorted(upto, (at, at + PAIRS), side="right"))
            # Rows whose pairs end in this stretch; a row has `most` pairs at the most, so stretches stay near their size.
            count = before[mine]
            y = np.repeat(rows[mine], count)
            x = np.repeat(first[mine], count) + np.arange(len(y)) - np.repeat(np.cumsum(count) - count, count)
            free = np.repeat(long[mine], count)
            yield from pairs(x[~free], y[~free], s, n, last, False)
            yield from pairs(x[free], y[free], s, n, last, True)

    def pairs(x: np.ndarray, y: np.ndarray, s: np.ndarray, n: np.ndarray, last: np.ndarray, free: bool) -> Iterator[pa.RecordBatch]:
        near = np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]) if not free else np.ones(len(x), bool)
        x, y = x[near], y[near]
        if not len(x):
            return
        rest = -(-percent * n // 100) - 1
        behind = np.where(last[x] < last[y], rest[x], np.where(last[y] < last[x], rest[y], np.maximum(rest[x], rest[y])))
        need = -(-percent * (n[x] + n[y]) // (100 + percent)) - behind if not free else np.zeros(len(x), np.int64)
        a, b = np.minimum(s[x], s[y]), np.maximum(s[x], s[y])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need)], ["a", "b", "need"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
        if held[0][0][0] == held[-1][0][-1]:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        yield from columns(*(x[:cut] for x in whole))
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield from columns(*(np.concatenate(x) for x in zip(*held)))


def overlaps(sets: list[np.ndarray], split: int = 0, tall: int = 12, width: int = 512) -> np.ndarray:
    """Sizes of intersections: all against all, or the first `split` sets against the rest."""
    m = len(sets)
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    start = np.concatenate(([0], np.nonzero(np.diff(shingles))[0] + 1, [len(shingles)]))
    size = np.diff(start)
    rows, shift = (split, split) if split else (m, 0)
    out = np.zeros((rows, m - shift), np.int64)
    flat = out.reshape(-1)
    base, count = start[:-1], size
    for d in range(2, min(tall, int(size.max(initial=0))) + 1):
        mine = base[count == d]
        for j in range(1, d):
            for i in range(j):
                a, b = owner[mine + i], owner[mine + j]  # a < b, as owners of a column ascend
                if split:
                    cross = (a < split) & (b >= split)
                    a, b = a[cross], b[cross]
                np.add.at(flat, a * (m - shift) + b - shift, 1)
    tallest = np.nonzero(size > tall)[0]
    for at in range(0, len(tallest), width):
        chosen = tallest[at : at + width]
        column = np.repeat(np.arange(len(chosen)), size[chosen])
        spot = np.arange(len(column)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen]) + np.repeat(start[chosen], size[chosen])
        tile = np.zeros((m, len(chosen)), np.float32)
        tile[owner[spot], column] = 1
        # Sums of at most `width` ones are exact in 32-bit floats.
        out += (tile[:rows] @ tile[shift:].T).astype(np.int64)
    return out


def linked_star(names: np.ndarray, sets: list[np.ndarray], split: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (name, root) that span the links of one block or pair of tiles."""
    n = np.array([len(x) for x in sets])
    shift = split
    found = overlaps(sets, split)
    left = n[:split] if split else n
    near = found * (100 + percent) >= percent * (left[:, None] + n[shift:][None])
    a, b = np.nonzero(near if split else np.triu(near, 1))
    label = np.arange(len(names))
    merge_labels(label, a, b + shift)
    tied = np.nonzero(label != np.arange(len(names)))[0]
    return names[tied], names[label[tied]]


def _block_batches(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, s, shingles) sorted by cell, side and s; a cell has two tiles at most."""
    cell, names, sides, sets = None, [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            split = sides.count(0) % len(sides)
            a, b = linked_star(np.array(names, np.int64), sets, split, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for c, side, s, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            if c != cell:
                yield from out()
                cell, names, sides, sets = c, [], [], []
            if names and names[-1] == s and sides[-1] == side:
                continue  # another row of the same content
            names.append(s)
            sides.append(side)
            sets.append(np.frombuffer(data.as_py(), np.uint64))
    yield from out()


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, cells, text) -> (s, cells, shingles); a content met again in the task is left out."""
    seen: set[int] = set()
    for batch in batches:
        chosen, data = [], []
        for k, (s, found) in enumerate(zip(batch.column(0).to_pylist(), sets_of(batch.column(2)))):
            if s not in seen and set_digest(found) == s:
                seen.add(s)
                chosen.append(k)
                data.append(found.tobytes())
            if len(data) == 256 or k == batch.num_rows - 1:
                spots = pa.array(chosen, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(spots), batch.column(1).take(spots), pa.array(data, pa.binary())], ["s", "cells", "shingles"])
                chosen, data = [], []
        if len(seen) > LISTED:
            seen.clear()


def blocks_to_cells(blocks: DataFrame, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """Adds cells (cell, side) to sets (s, root, n): the block itself, or for one above a tile's bounds the pairs of tiles that the set is in."""
    sums = blocks.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    large = materialize(sums.filter((F.col("shingles") > 2 * tile_shingles) | (F.col("sets") > 2 * tile_sets)).select("root"))
    own = F.array(F.struct(F.col("root").alias("cell"), F.lit(0).alias("side"))).alias("cells")
    if large.isEmpty():
        return blocks.select("*", own)
    small = blocks.join(large, "root", "left_anti").select(*blocks.columns, own)
    # Sets that can link have sizes within a factor of 1.25, so classes of a factor of 1.26 are the same or adjoin.
    member = blocks.join(large, "root", "left_semi").withColumn("class", F.floor(F.log(1.26, F.col("n").cast("double"))).cast("int"))
    cuts = F.greatest(F.ceil(F.sum("n") / tile_shingles), F.ceil(F.count("*") / tile_sets)).cast("int")
    tiles = materialize(member.groupBy("root", "class").agg(cuts.alias("cuts")))
    one = tiles.select("root", F.col("class").alias("class_a"), F.explode(F.expr("sequence(0, cuts - 1)")).alias("cut_a"))
    near = one.withColumn("class_b", F.explode(F.expr("array(class_a, class_a + 1)")))
    pairs = near.join(tiles.select("root", F.col("class").alias("class_b"), "cuts"), ["root", "class_b"])
    pairs = pairs.withColumn("cut_b", F.explode(F.expr("sequence(0, cuts - 1)"))).filter("class_a < class_b or cut_a <= cut_b")
    pairs = materialize(pairs.withColumn("cell", F.xxhash64("root", "class_a", "cut_a", "class_b", "cut_b")))
    same = F.expr("class_a = class_b and cut_a = cut_b")
    sides = [pairs.filter(F.lit(True) if k == 0 else ~same).select("root", F.col(f"class_{x}").alias("class"), F.col(f"cut_{x}").alias("cut"), F.struct("cell", F.lit(k).alias("side")).alias("cell")) for k, x in ((0, "a"), (1, "b"))]
    listed = sides[0].unionByName(sides[1]).groupBy("root", "class", "cut").agg(F.collect_list("cell").alias("cells"))  # as many as a tile has partners
    cut = member.join(tiles, ["root", "class"]).withColumn("cut", F.expr("cast(pmod(xxhash64(s), cuts) as int)"))
    return small.unionByName(cut.join(listed, ["root", "class", "cut"]).select(*blocks.columns, "cells"))


def candidate_edges(reps: DataFrame, percent: int = PERCENT, many: int = MANY) -> DataFrame:
    """(a, b) between names of sets, or of a set and a frequent shingle: sets that can link are connected."""
    columns = reps.select(F.explode("lead").alias("shingle"), "s", "n", "last")
    dealt = columns.repartition("shingle").sortWithinPartitions("shingle")
    products = dealt.mapInArrow(lambda b: _pair_batches(percent, 4 * many, b), "a long, b long, need long")
    kept = products.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")
    return kept.unionByName(reps.select(F.col("s").alias("a"), F.explode("held").alias("b")))


def block_links(docs: DataFrame, own: DataFrame, edges: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """(a, b): links whose components are those of all links, from the products of blocks."""
    rooted = components(edges).select(F.col("fp").alias("s"), "root")
    one = own.filter("n > 0").groupBy("s", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("one"))
    blocks = materialize(one.join(rooted, "s").select("s", "root", "n", F.col("one.id").alias("__one"), F.col("one.digest").alias("__digest")))
    listed = materialize(blocks_to_cells(blocks, tile_shingles, tile_sets).select("s", "cells", "__one", "__digest"))
    if listed.count() <= LISTED:
        listed = F.broadcast(listed)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    chosen = texts.join(listed, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__one"))).select("s", "cells", "text")
    sets = chosen.mapInArrow(_set_batches, "s long, cells array<struct<cell:long,side:int>>, shingles binary")
    cells = sets.select(F.explode("cells").alias("c"), "s", "shingles").select("c.cell", "c.side", "s", "shingles")
    return cells.repartition("cell").sortWithinPartitions("cell", "side", "s").mapInArrow(lambda b: _block_batches(percent, b), "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, many: int = MANY, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """id, n_shingles, component_id: one row for each row of `docs`."""
    if not 50 < percent <= 100:
        raise ValueError("size classes and leading shingles are laid out for more than half in common")
    if percent < PERCENT:
        raise ValueError(f"size classes are laid out for {PERCENT} percent or more")
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, percent, many))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    own = materialize(rows.mapInArrow(lambda b: _own_batches(percent, often.value, b), f"id {kind}, digest long, s long, n long, lead array<long>, held array<long>, last int"))
    reps = own.filter("n > 0").select("s", "n", "lead", "held", "last").dropDuplicates(["s"])
    edges = materialize(candidate_edges(reps, percent, many))
    links = materialize(block_links(docs, own, edges, id_col, text_col, percent, tile_shingles, tile_sets))
    first = materialize(own.filter("n > 0").groupBy("s").agg(F.min("id").alias("first")))
    rooted = materialize(first.join(components(links).withColumnRenamed("fp", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")))
    named = join_spread(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), ["root"], "s").select("s", "component_id")
    slim = own.select("id", "s", "n")
    full = join_spread(materialize(slim.filter("n > 0")), named, ["s"], "id").select("id", "n", "component_id")
    out = full.unionByName(slim.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
