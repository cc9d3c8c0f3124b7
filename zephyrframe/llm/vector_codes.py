"""Product codes of vectors: codebooks learned by filtering Lloyd rounds over kd-trees.

A vector's components become integers floor(256 * x) and are cut into equal
consecutive parts. Every part position has a codebook, which starts as that part of
the vectors of smallest ids. In each round every partition builds kd-trees over
its parts, a tree for each part position and chunk of rows, with each node's
bounding box, sum and count. Entries are filtered down the tree: an entry that
another one beats on the whole box is dropped, and a node that has one entry left
gives its cached sum and count to it, so its points are never looked at. Only sums
and counts by entry leave a task; they are partly summed before the shuffle, and the
codebooks (entries x dimension, both parameters) are all that the driver sees.

Distances are squared, of integers, and exact; ties go to the lower index, in
pruning too: an entry that ties on a box's far corner is dropped only for one of
lower index.

Defined results: vectors that are null, empty, or hold null or non-finite
components are dropped. Null ids are coded but start no entry; of rows with one id
the least vector starts its entry. With fewer ids than entries, codebooks are
shorter; without any, codes are null. Repeated rows give repeated results. A table
without kept vectors gives no rows. Kept vectors of different dimensions, of one that
isn't a multiple of the parts, or with components whose squares would leave 64 bits
raise ValueError. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import join_spread, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task holds at once, points of a leaf, and the largest component whose squares fit.
CHUNK, LEAF, LARGEST = 32_768, 16, 1 << 26


def kept_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (integer components) of the rows whose vectors are whole."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = table.filter(v.isNotNull() & (F.size(v) > 0)).filter(~F.exists(v, bad))
    cut = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST)).cast("int")
    return whole.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, cut).alias("v"))


def first_codebooks(rows: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """(part, entry, position): the parts of the vectors of the `entries` smallest ids; None without any."""
    ids = rows.select("id").filter("id is not null").distinct().orderBy("id").limit(entries)
    lowest = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
    found = [r["v"] for r in lowest.collect()]  # `entries` rows
    if not found:
        return None
    return checked(np.array(found, np.int64) if len({*map(len, found)}) == 1 else None, parts).transpose(1, 0, 2)


def checked(vectors: np.ndarray | None, parts: int, dimension: int | None = None) -> np.ndarray:
    """Vectors cut into parts (row, part, position), if they are fit for it."""
    if vectors is None or (dimension or vectors.shape[1]) != vectors.shape[1]:
        raise ValueError("the vectors' dimensions differ")
    if vectors.shape[1] % parts:
        raise ValueError(f"vectors of {vectors.shape[1]} components can't be cut into {parts} equal parts")
    if len(vectors) and np.abs(vectors).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}, so squared distances don't fit 64 bits")
    return vectors.reshape(len(vectors), parts, -1)


class KdTree:
    """Points in tree order with, for each node, its range, bounding box, sum and count; children of node k are 2k + 1 and 2k + 2."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        order, edges = np.arange(n), np.array([0, n])
        low, high, first, stop = [], [], [], []
        for level in range(depth + 1):
            at = points[order]
            starts, ends = edges[:-1], edges[1:]
            low.append(np.minimum.reduceat(at, starts))
            high.append(np.maximum.reduceat(at, starts))
            first.append(starts)
            stop.append(ends)
            if level < depth:
                # Each range is sorted along its widest side and halved; no range is empty, as leaves hold half of `leaf` at least.
                side = np.argmax(high[-1] - low[-1], axis=1)
                owner = np.repeat(np.arange(len(starts)), ends - starts)
                order = order[np.lexsort((at[np.arange(n), side[owner]], owner))]
                edges = np.sort(np.concatenate((edges, (starts + ends) // 2)))
        self.order, self.points, self.depth = order, points[order], depth
        self.low, self.high, self.first, self.stop = map(np.concatenate, (low, high, first, stop))
        upto = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)))
        self.sums, self.counts = upto[self.stop] - upto[self.first], self.stop - self.first

    def leaves_from(self, node: int) -> bool:
        return node >= (1 << self.depth) - 1


def _beaten(low: np.ndarray, high: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which entries still matter for each box (node, entry): the one nearest to a box's middle drops those it beats on the whole box."""
    middle = low + high  # twice the middle, against twice the entries
    away = ((middle[:, None, :] - 2 * entries[None]) ** 2).sum(axis=2)
    best = np.argmin(np.where(alive, away, np.iinfo(np.int64).max), axis=1)
    star = entries[best]
    step = entries[None] - star[:, None, :]
    corner = np.where(step > 0, high[:, None, :], low[:, None, :])  # where the other entry does best against the star
    edge = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - star[:, None, :]) ** 2).sum(axis=2)
    index = np.arange(len(entries))[None]
    return alive & ~((edge > 0) | ((edge == 0) & (index > best[:, None])))


def filtered(tree: KdTree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, entry of each, True) for whole subtrees, and (points in tree order, entry of each, False) for points of leaves that kept several entries."""
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(nodes):
        alive = _beaten(tree.low[nodes], tree.high[nodes], entries, alive)
        one = alive.sum(axis=1) == 1
        if one.any():
            yield nodes[one], np.argmax(alive[one], axis=1), True
        nodes, alive = nodes[~one], alive[~one]
        if not len(nodes):
            return
        if tree.leaves_from(int(nodes[0])):  # a level is all leaves or has none
            owner = np.repeat(np.arange(len(nodes)), tree.counts[nodes])
            spots = np.arange(len(owner)) - np.repeat(np.cumsum(tree.counts[nodes]) - tree.counts[nodes], tree.counts[nodes]) + tree.first[nodes][owner]
            away = ((tree.points[spots][:, None, :] - entries[None]) ** 2).sum(axis=2)
            yield spots, np.argmin(np.where(alive[owner], away, np.iinfo(np.int64).max), axis=1), False
            return
        nodes, alive = np.concatenate((2 * nodes + 1, 2 * nodes + 2)), np.concatenate((alive, alive))


def sums_by_entry(tree: KdTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum (entry, position) and count (entry) of the points nearest to each entry."""
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    for items, entry, whole in filtered(tree, entries):
        np.add.at(sums, entry, tree.sums[items] if whole else tree.points[items])
        np.add.at(counts, entry, tree.counts[items] if whole else 1)
    return sums, counts


def nearest(tree: KdTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each point, in the points' first order."""
    n = len(tree.order)
    found = np.zeros(n, np.int64)
    for items, entry, whole in filtered(tree, entries):
        if whole:
            sizes = tree.counts[items]
            spots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tree.first[items], sizes)
            found[spots] = np.repeat(entry, sizes)
        else:
            found[items] = entry
    error = ((tree.points - entries[found]) ** 2).sum(axis=1)
    out = np.empty((2, n), np.int64)
    out[:, tree.order] = found, error
    return out[0], out[1]


def _chunks(batches: Iterator[pa.RecordBatch], column: int, parts: int, dimension: int, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in chunks of about `size`, with their parts (row, part, position)."""
    held, n = [], 0

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column(column).combine_chunks()
        same = bool((np.asarray(lists.value_lengths()) == dimension).all())
        return table, checked(lists.flatten().to_numpy().astype(np.int64).reshape(-1, dimension) if same else None, parts, dimension)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def round_sums(rows: DataFrame, books: np.ndarray, chunk: int = CHUNK) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): count and sum of the parts nearest to each entry, as many rows as the codebooks have."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut in _chunks(batches, 0, parts, parts * width, chunk):
            for p in range(parts):
                sums, counts = sums_by_entry(KdTree(cut[:, p]), books[p])
                used = np.nonzero(counts)[0]
                columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(sums[used, k]) for k in range(width)]], ["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    kind = "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(width))
    summed = rows.select("v").mapInArrow(run, kind).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{k}") for k in range(width)]).alias("s"))
    return {(r["part"], r["entry"]): (r["n"], r["s"]) for r in summed.collect()}


def lloyd(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS, chunk: int = CHUNK) -> np.ndarray:
    """The codebooks after some rounds; an entry that nothing is nearest to stays."""
    for _ in range(rounds):
        after = books.copy()
        for (part, entry), (n, total) in round_sums(rows, books, chunk).items():
            after[part, entry] = [s // n for s in total]
        books = after
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def assign(rows: DataFrame, books: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """id, label, code (two hex digits a part) and error of each row."""
    parts, _, width = books.shape
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    pairs = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _chunks(batches, 2, parts, parts * width, chunk):
            found = [nearest(KdTree(cut[:, p]), books[p]) for p in range(parts)]
            codes = ["".join(row) for row in pairs[np.stack([f[0] for f in found], axis=1)].tolist()]
            columns = [table.column(k).combine_chunks() for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id {kind[0]}, label {kind[1]}, code string, error long")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """id, code, error, label_error (errors summed over the rows of a label, nulls together) and codebooks_sha256 of each kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so there are 1 to 256 entries")
    rows = kept_vectors(table, id_col, vector_col, label_col)
    books = first_codebooks(rows, entries, parts)
    if books is None:
        coded, digest = rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    else:
        books = lloyd(rows, books, rounds, chunk)
        coded, digest = assign(rows, books, chunk), books_digest(books)
    # A key that is never null, so rows without a label meet their sum as well.
    coded = materialize(coded.withColumns({"none": F.col("label").isNull(), "known": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    sums = coded.groupBy("none", "known").agg(F.sum("error").alias("label_error"))
    whole = join_spread(coded, sums, ["none", "known"], "code")
    return whole.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
