"""Gradient-boosted trees by histograms, with missing values as values of their own.

Features are cut into bins at quantiles once; every level of a tree is one job: tasks
sum residuals and counts by node, feature and bin over their rows, the sums meet in a tree
of partial sums, and the driver picks each node's best cut from them. Its memory is
nodes x features x bins, all parameters; rows never leave their tasks. For each cut
both sides are tried for missing values. A tree's predictions are added to the rows by the
next tree's first job, and lineage is cut every CUT trees.

Trees are thousands of jobs of little work, so rows are kept as bin numbers in blocks, in
as many parts as their number needs, and the jobs are those of an RDD: planning a
DataFrame for each would take most of the time. Rows that fill no more than one block (BLOCK
rows, so one task in any case) leave nothing to sum between tasks; there a job grows
CUT trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrframe.sources.store import checkpoint_dir

#: Bins of a feature (one more is for missing values), error of the quantiles, weight that pulls leaves to zero.
BINS, QUANTILE_ERROR, SHRINK = 32, 0.002, 1.0
#: Rows that one task holds in a block, and trees between cuts of lineage.
BLOCK, CUT = 50_000, 25


@dataclass
class Trees:
    """Fitted trees: `edges` by feature; by tree and node its feature (-1: a leaf), last bin to the left, side of missing values, value."""

    features: list[str]
    edges: list[list[float]]
    base: float
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def bins(self, columns: np.ndarray) -> np.ndarray:
        """Bin numbers (feature, row) of values; the last bin is for missing ones."""
        return binned(columns, self.edges)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Predictions of rows by their bins."""
        out = np.full(bins.shape[1], self.base)
        for k in range(len(self.feature)):
            out += self.value[k][leaf_of(bins, self.feature[k], self.bin[k], self.missing_left[k])]
        return out

    def column(self) -> Column:
        """The prediction as a column, by Arrow batches; reads the columns named by the features."""

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            values = np.array([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            return pd.Series(self.predict(self.bins(values)))

        return predicted(*[F.col(c) for c in self.features])

    def to_json(self) -> str:
        """The trees as text."""
        return json.dumps({"features": self.features, "edges": self.edges, "base": self.base} | {k: getattr(self, k).tolist() for k in ("feature", "bin", "missing_left", "value")})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        """Trees of such a text."""
        x = json.loads(text)
        kinds = {"feature": int, "bin": int, "missing_left": bool, "value": float}
        return cls(x["features"], x["edges"], x["base"], **{k: np.array(x[k], kind).reshape(len(x[k]), -1) for k, kind in kinds.items()})


def binned(columns: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers (feature, row): how many edges lie below a value; BINS for missing ones."""
    out = np.full(columns.shape, BINS, np.uint8)
    for k, cuts in enumerate(edges):
        there = ~np.isnan(columns[k])
        out[k][there] = np.searchsorted(np.asarray(cuts), columns[k][there], side="left")
    return out


def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, missing_left: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The node that each row reaches, after `depth` steps or at a leaf; children of node k are 2k + 1 and 2k + 2."""
    rows = np.arange(bins.shape[1])
    node = np.zeros(len(rows), np.int64)
    for _ in range(depth if depth is not None else int(np.log2(len(feature) + 1))):
        chosen = feature[node]
        inner = chosen >= 0
        if not inner.any():
            break
        at = bins[chosen, rows]
        left = np.where(at == BINS, missing_left[node], at <= cut[node])
        node = np.where(inner, 2 * node + 2 - left, node)
    return node


def histogram(bins: np.ndarray, residual: np.ndarray, node: np.ndarray, first: int, nodes: int) -> np.ndarray:
    """(2, node, feature, bin): sums of residuals and counts of the rows whose node is among `nodes` ones from `first`."""
    features, width = len(bins), BINS + 1
    mine = (node >= first) & (node < first + nodes)
    spot = (np.arange(features) * width)[:, None] + bins[:, mine] + ((node[mine] - first) * features * width)[None]
    size = nodes * features * width
    weights = np.broadcast_to(residual[mine], spot.shape).reshape(-1)
    flat = spot.reshape(-1)
    return np.stack((np.bincount(flat, weights, size), np.bincount(flat, minlength=size).astype(float))).reshape(2, nodes, features, width)


def best_cuts(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node its gain (not above 0: a leaf), feature, last bin to the left and side of missing values."""
    total, count = sums[0].sum(axis=2)[:, :, None], sums[1].sum(axis=2)[:, :, None]
    score = lambda s, n: s * s / (n + SHRINK)
    known = np.cumsum(sums[:, :, :, :BINS], axis=3)
    gains = []
    for left in (False, True):
        s, n = known + (sums[:, :, :, BINS:] if left else 0)
        gain = score(s, n) + score(total - s, count - n) - score(total, count)
        gains.append(np.where((n > 0) & (count - n > 0), gain, -np.inf))
    gains = np.stack(gains, axis=3)  # node, feature, bin, side
    flat = gains.reshape(len(gains), -1)
    best = flat.argmax(axis=1)
    feature, cut, side = np.unravel_index(best, gains.shape[1:])
    return flat[np.arange(len(flat)), best], feature, cut, side.astype(bool)


def _blocks(rows: Iterator, edges: list[list[float]], base: float) -> Iterator[list]:
    """Blocks (bins, label, prediction) of rows (label, values...)."""
    held = []

    def out() -> list:
        table = np.array(held, np.float64).T
        return [binned(table[1:], edges), table[0], np.full(len(held), base)]

    for row in rows:
        held.append([np.nan if v is None else v for v in row])
        if len(held) == BLOCK:
            yield out()
            held = []
    if held:
        yield out()


@dataclass
class Booster:
    """What is to be fitted: features, label, number and depth of trees, step."""

    features: list[str]
    label: str
    trees: int
    depth: int
    step: float

    def fit(self, frame: DataFrame) -> Trees:
        """Trees on all rows of a frame; a table without rows has none but a base of 0."""
        checkpoint_dir(frame.sparkSession)
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
        rows = frame.select(F.col(self.label).cast("double").alias(self.label), *map(number, self.features)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, base = rows.agg(F.count("*"), F.coalesce(F.avg(self.label), F.lit(0.0))).first()
            found = rows.approxQuantile(self.features, [k / BINS for k in range(1, BINS)], QUANTILE_ERROR) if n else [[]] * len(self.features)
            edges = [sorted(set(x)) for x in found]
            blocks = rows.repartition(max(1, -(-n // BLOCK))).rdd.mapPartitions(lambda part: _blocks(part, edges, base)).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
        finally:
            rows.unpersist()
        size = (2 << self.depth) - 1
        grown = [] if not n else self._alone(blocks, size) if n <= BLOCK else self._together(blocks, size)
        stacked = [np.array([t[k] for t in grown]).reshape(len(grown), size) for k in range(4)]
        return Trees(self.features, edges, float(base), *stacked)

    def _alone(self, blocks: RDD, size: int) -> list[list[np.ndarray]]:
        """The trees of one block, CUT of them a job."""
        depth, step, grown = self.depth, self.step, []
        for at in range(0, self.trees, CUT):
            count = min(CUT, self.trees - at)

            def several(pair: tuple, count: int = count) -> tuple:
                block, trees = pair[0], []
                for _ in range(count):
                    trees.append(grow_tree(size, depth, step, lambda *place, block=block: _summer(*place)(block)))
                    block = _adder(trees[-1])(block)
                return block, trees

            pairs = (blocks if at else blocks.map(lambda block: (block, None))).map(several).persist(StorageLevel.MEMORY_AND_DISK)
            pairs.checkpoint()
            grown += [t for trees in pairs.map(lambda pair: pair[1]).collect() for t in trees]
            blocks.unpersist()
            blocks = pairs
        blocks.unpersist()
        return grown

    def _together(self, blocks: RDD, size: int) -> list[list[np.ndarray]]:
        """The trees of many blocks, a level a job."""
        grown, older = [], []
        for count in range(self.trees):
            tree = grow_tree(size, self.depth, self.step, lambda *place: blocks.map(_summer(*place)).treeReduce(np.add))
            grown.append(tree)
            after = blocks.map(_adder(tree)).persist(StorageLevel.MEMORY_AND_DISK)
            if count % CUT == CUT - 1:
                after.checkpoint()
                after.count()
            older.append(blocks)
            if len(older) > 2:
                older.pop(0).unpersist()
            blocks = after
        for old in [*older, blocks]:
            old.unpersist()
        return grown


def grow_tree(size: int, depth: int, step: float, sums_of: Callable) -> list[np.ndarray]:
    """One tree (feature, bin, side of missing values, value by node); `sums_of` (tree, level, first node, nodes) gives a level's histograms."""
    tree = feature, cut, missing_left, value = [np.full(size, -1), np.zeros(size, int), np.zeros(size, bool), np.zeros(size)]
    for level in range(depth):
        first, nodes = (1 << level) - 1, 1 << level
        if level and not (feature[(first - 1) // 2 : first] >= 0).any():
            break
        sums = sums_of(tree, level, first, nodes)
        if not level:
            value[0] = step * sums[0, 0, 0].sum() / (sums[1, 0, 0].sum() + SHRINK)
        gain, f, b, m = best_cuts(sums)
        for k in np.nonzero(gain > 1e-12)[0].tolist():
            node = first + k
            feature[node], cut[node], missing_left[node] = f[k], b[k], m[k]
            left = sums[:, k, f[k], : b[k] + 1].sum(axis=1) + (sums[:, k, f[k], BINS] if m[k] else 0)
            right = sums[:, k, f[k]].sum(axis=1) - left
            for child, (s, n) in ((2 * node + 1, left), (2 * node + 2, right)):
                value[child] = step * s / (n + SHRINK)
    return tree


def _summer(tree: list[np.ndarray], level: int, first: int, nodes: int) -> Callable:
    feature, cut, missing_left, _ = (x.copy() for x in tree)

    def run(block: list) -> np.ndarray:
        bins, label, prediction = block
        return histogram(bins, label - prediction, leaf_of(bins, feature, cut, missing_left, level), first, nodes)

    return run


def _adder(tree: list[np.ndarray]) -> Callable:
    def run(block: list) -> list:
        bins, label, prediction = block
        return [bins, label, prediction + tree[3][leaf_of(bins, *tree[:3])]]

    return run
