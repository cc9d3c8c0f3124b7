"""Near-duplicate groups by SimHash and tiled exact comparison.

Fingerprints: a text is lower-cased (A-Z), cut into words at white space, and
each 4-word shingle (repeats included, space-joined; fewer words: the whole
sequence) is hashed with XXH64, seed 42. A bit is 1 if set in over half the hashes.

Links: fingerprints of at most `radius` differing bits. The distinct
fingerprints are compared exactly, with numpy exclusive-or and bit counts, tile
against tile; tile pairs whose population counts lie further apart than the
radius are skipped. So that the number of comparisons follows the corpus rather
than its square, tiles are formed inside buckets that hold every possible link:
of k bit blocks at least k - radius agree between linked fingerprints, and each
choice of k - radius blocks is a bucket key. A bucket above `tile` fingerprints
is cut into tiles by population count and hash, and the tile pairs within the
radius are spread over tasks, so no task holds an unbounded group.

Each compared cell returns a spanning star instead of all its pairs; components
are then joined by repeated minimum labels and pointer jumping.

Defined results: a null or empty text has fingerprint zero, which links like any
other. Repeated rows give repeated results. component_id is the smallest id
that can be reached; null ids never become one, so a group with null ids only
has a null component_id. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.llm.common import hot_keys, join_spread, materialize, unused

SHINGLE = 4
SEED = 42


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; memory stays bounded by the text itself."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > size:
        starts, ends = starts[: n - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 16384):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist())), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(v.as_py() or "")) for v in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (a hash of the text) and fp (the fingerprint as a signed 64-bit integer), one row for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"id {kind}, digest long, fp long")


def merge_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the components of each linked pair in place; label[i] is the root of i."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, jumped := label[label]):
            label[:] = jumped


def linked_star(prints: np.ndarray, split: int, radius: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (print, root) spanning what links in one cell.

    split 0: all against all. Otherwise the first `split` prints against the
    rest. Tiles of `step` prints, sorted by population count, are compared
    unless their counts differ beyond the radius.
    """
    counts = np.bitwise_count(prints)
    sides = [np.arange(len(prints))] if not split else [np.arange(split), np.arange(split, len(prints))]
    sides = [s[np.argsort(counts[s], kind="stable")] for s in sides]
    label = np.arange(len(prints))
    rows, columns = sides[0], sides[-1]
    for i in range(0, len(rows), step):
        mine = rows[i : i + step]
        low, high = int(counts[mine[0]]), int(counts[mine[-1]])
        for j in range(0 if split else i, len(columns), step):
            other = columns[j : j + step]
            if int(counts[other[0]]) > high + radius:
                break
            if int(counts[other[-1]]) < low - radius:
                continue
            near = np.bitwise_count(prints[mine][:, None] ^ prints[other][None, :]) <= radius
            a, b = np.nonzero(near)
            merge_labels(label, mine[a], other[b])
    tied = np.nonzero(label != np.arange(len(prints)))[0]
    return prints[tied], prints[label[tied]]


def _compare_cells(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, so a cell is complete when the next begins."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compared(cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
        found_a, found_b = [], []
        cuts = np.concatenate(([0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s > 1:
                a, b = linked_star(fp[s:e].view(np.uint64), int((side[s:e] == 0).sum()) % (e - s), radius)
                found_a.append(a)
                found_b.append(b)
        return found_a, found_b

    def out(found: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if found[0]:
            a, b = np.concatenate(found[0]).view(np.int64), np.concatenate(found[1]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
        if held[0][0][0] == held[-1][0][-1]:
            continue  # still the same cell
        cell, side, fp = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(cell[::-1] != cell[-1], True))
        whole = len(cell) - last
        yield from out(compared(cell[:whole], side[:whole], fp[:whole]))
        held = [(cell[whole:], side[whole:], fp[whole:])]
    if held:
        yield from out(compared(*(np.concatenate(x) for x in zip(*held))))


def bucket_keys(fp: Column, blocks: int, radius: int) -> Column:
    """The bucket keys of a fingerprint: one for each choice of blocks - radius blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(mask)))))
    return F.array(*keys)


def block_count(distinct: int, radius: int) -> int:
    """Blocks for so many fingerprints: more of them make more, smaller buckets."""
    return radius + (1 if distinct < 50_000_000 else 2 if distinct < 5_000_000_000 else 3)


def links(prints: DataFrame, distinct: int, radius: int = 4, tile: int = 8192, tasks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    keyed = prints.select(F.explode(bucket_keys(F.col("fp"), block_count(distinct, radius), radius)).alias("key"), "fp")
    # Two keys may share a hash; that only puts more fingerprints side by side.
    hot = materialize(keyed.groupBy("key").count().filter(F.col("count") > tile).select("key"))
    cells = keyed.join(hot, "key", "left_anti").select(F.col("key").alias("cell"), F.lit(0).alias("side"), "fp")
    if not hot.isEmpty():
        member = keyed.join(hot, "key", "left_semi").withColumn("ones", F.bit_count("fp").cast("int"))
        tiles = materialize(member.groupBy("key", "ones").count().withColumn("cuts", F.ceil(F.col("count") / tile).cast("int")).drop("count"))
        one = tiles.select("key", F.col("ones").alias("ones_a"), F.explode(F.expr("sequence(0, cuts - 1)")).alias("cut_a"))
        # Population counts run from 0 to 64, so a tile meets those of at most 2 * radius + 1 others.
        near = one.withColumn("ones_b", F.explode(F.expr(f"sequence(ones_a, least(ones_a + {radius}, 64))")))
        pairs = near.join(tiles.select("key", F.col("ones").alias("ones_b"), "cuts"), ["key", "ones_b"])
        pairs = pairs.withColumn("cut_b", F.explode(F.expr("sequence(0, cuts - 1)"))).filter("ones_a < ones_b or cut_a <= cut_b")
        pairs = materialize(pairs.withColumn("cell", F.xxhash64("key", "ones_a", "cut_a", "ones_b", "cut_b")))
        cut = member.join(tiles, ["key", "ones"]).withColumn("cut", F.expr("cast(pmod(xxhash64(fp), cuts) as int)"))
        for side, name in ((0, "a"), (1, "b")):
            mine = pairs.select("key", F.col(f"ones_{name}").alias("ones"), F.col(f"cut_{name}").alias("cut"), "cell", F.expr("ones_a = ones_b and cut_a = cut_b").alias("own"))
            mine = mine if side == 0 else mine.filter("not own")
            cells = cells.unionByName(cut.join(mine, ["key", "ones", "cut"]).select("cell", F.lit(side).alias("side"), "fp"))
    dealt = cells.repartition(tasks, "cell") if tasks else cells.repartition("cell")
    return dealt.sortWithinPartitions("cell", "side").mapInArrow(lambda batches: _compare_cells(radius, batches), "a long, b long")


def components(edges: DataFrame, rounds: int = 130) -> DataFrame:
    """(fp, root): for each fingerprint on an edge the smallest fingerprint of its component.

    Every round each fingerprint takes the smallest label among its neighbours, the
    label that it had (a root) takes the smallest that any of its own found, and then each
    takes its label's label. So a run of labels that hangs on a smaller one falls in
    whole, and a chain of 10,000 takes 15 rounds; more than `rounds` (twice the logarithm of
    2 ** 64, with a round to see that nothing moves) raise. Hubs of many edges and roots
    of many fingerprints are dealt over several tasks.
    """
    size = 2 * edges.count()
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), size)
    hubs = hot_keys(both, ["b"])
    labels = materialize(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m")).select("fp", F.least("fp", "m").alias("root")), size)
    for _ in range(rounds):
        beside = join_spread(both, labels.select(F.col("fp").alias("b"), "root"), ["b"], "a", hubs)
        seen = beside.groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("m"))
        near = materialize(labels.join(seen, "fp").select("fp", "root", F.least("root", "m").alias("next")), size)
        # A root is a fingerprint itself, so what its own have found is one more candidate of its row.
        hooks = near.filter("next < root").groupBy(F.col("root").alias("fp")).agg(F.min("next").alias("hook"))
        hooked = materialize(near.join(hooks, "fp", "left").select("fp", F.least("next", "hook").alias("next"), F.col("root").alias("was")), size)
        far = join_spread(hooked, hooked.select(F.col("fp").alias("next"), F.col("next").alias("far")), ["next"], "fp")
        moved = materialize(far.select("fp", F.least("next", "far").alias("root"), "was"), size)
        labels = moved.select("fp", "root")
        if moved.filter("root != was").isEmpty():
            return labels
    raise ArithmeticError(f"components weren't settled after {rounds} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, tile: int = 8192) -> DataFrame:
    """id, digest, fp, root (the fingerprint that names the group) and component_id: one row for each row of `docs`."""
    own = materialize(fingerprints(docs, id_col, text_col))
    prints = materialize(own.groupBy("fp").agg(F.min("id").alias("first")))
    edges = materialize(links(prints.select("fp"), prints.count(), radius, tile))
    rooted = materialize(prints.join(components(edges), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_spread(rooted, lowest, ["root"], "fp").select("fp", "root", "component_id")
    return join_spread(own, named, ["fp"], "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, tile: int = 8192) -> DataFrame:
    """One row for each row of `docs`: id, fingerprint (16 hex digits), component_id."""
    found = classes(docs, id_col, text_col, radius, tile)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of `docs` without near copies: of each group the row with the smallest id stays.

    Rows of one id with different texts are judged by their own texts: each group
    keeps one row, of its smallest id the one of smallest digest. Of rows alike in id and
    text the one whose other columns, as JSON, are least stays, so reruns agree. Rows with a null
    id come last, so they stay only in groups of nothing else, one for each group.
    """
    found = classes(docs, id_col, text_col, radius).select("id", "digest", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    own, lead_id, lead, row = unused(docs, "__own", "__id", "__digest", "__row")
    rest = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias(own)))

    def least(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), rest).alias(row)).select(f"{row}.*")

    # Both branches below read the leads; their exchange is the same, so it is made once.
    leads = found.groupBy("root").agg(first).select(F.col("first.id").alias(lead_id), F.col("first.digest").alias(lead))
    named = docs.withColumn(own, F.xxhash64(text_col))
    known = named.filter(F.col(id_col).isNotNull())
    # Rows of an id and digest are alike; naming both lets the join's partitioning serve both steps.
    known = known.join(leads.filter(F.col(lead_id).isNotNull()), (F.col(id_col) == F.col(lead_id)) & (F.col(own) == F.col(lead)), "left_semi")
    # Rows without an id may be many of one text, so they are made one before they meet the leads.
    nameless = least(named.filter(F.col(id_col).isNull()), own).withColumn(own, F.xxhash64(text_col))
    nameless = nameless.join(leads.filter(F.col(lead_id).isNull()).select(lead), F.col(own) == F.col(lead), "left_semi")
    return least(known, id_col, own).unionByName(nameless.drop(own))
