"""Stored tables: upserts, rewrites and removal over partitioned Parquet.

Parquet has no MERGE. An upsert is the union of old and new rows with a
priority, of which one row by key stays: only the partitions that new rows touch
are read or written. Each change is a new version of the table (`snapshots`), put in
place by one move: a failure at any step leaves the version before it, readers see
one version whole, and of two writers the second starts again from the first one's rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.sources import snapshots
from zephyrframe.sources.readings import MEASURES
from zephyrframe.sources.snapshots import Conflict, Staging, Version, read  # noqa: F401

ATTEMPTS = 5


def latest_by_key(keys: Sequence[str], *versions: DataFrame) -> DataFrame:
    """Of each key the row of the last version that has it, columns of the first version.

    One aggregation with partial maxima; no window, so hot keys are combined before the shuffle.
    """
    columns = versions[0].columns
    rest = [c for c in columns if c not in keys]
    ranked = [v.select(*columns).withColumn("__version", F.lit(k)) for k, v in enumerate(versions)]
    united = ranked[0]
    for v in ranked[1:]:
        united = united.unionByName(v)
    kept = united.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__version").alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns])


def normalize_negatives(hourly: DataFrame) -> DataFrame:
    """Measures without sign, for rows that have a negative one; an interval across zero begins at 0."""
    low, high = F.col("hourly_min"), F.col("hourly_max")
    negative = F.coalesce(F.array_min(F.array(*[F.col(m) for m in MEASURES])) < 0, F.lit(False))
    fixed = {m: F.abs(F.col(m)) for m in MEASURES}
    fixed["hourly_min"] = F.when((low < 0) & (high > 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    fixed["hourly_max"] = F.greatest(F.abs(low), F.abs(high))
    return hourly.select(*[F.when(negative, fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in hourly.columns])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; one of this machine only where a local session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="zephyrframe-"))
    return context.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written below a path."""
    return snapshots.latest(spark, path) > 0


def replaced(keys: Sequence[str], old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with new rows in the place of those of equal key; columns that `new` lacks keep their old values.

    One aggregation with partial maxima, as in `latest_by_key`.
    """
    given = [c for c in new.columns if c not in keys]
    held = [c for c in old.columns if c not in new.columns]
    version = F.col("__version")
    united = old.withColumn("__version", F.lit(0)).unionByName(new.withColumn("__version", F.lit(1)), allowMissingColumns=True)
    aggregates = [F.max_by(F.struct(*given), version).alias("__new")]
    if held:
        aggregates.append(F.max_by(F.struct(*held), F.when(version == 0, version)).alias("__old"))
    rows = united.groupBy(*keys).agg(*aggregates)
    of = lambda c: F.col(c) if c in keys else F.col(f"__old.{c}").alias(c) if c in held else F.col(f"__new.{c}").alias(c)
    return rows.select(*[of(c) for c in [*old.columns, *[c for c in new.columns if c not in old.columns]]])


def _again(change: Callable[[], int]) -> int:
    """A change of the newest version, started anew where another writer was first."""
    for _ in range(ATTEMPTS - 1):
        try:
            return change()
        except Conflict:
            pass
    return change()


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partitions: Sequence[str]) -> int:
    """Insert new rows or replace those of equal key. `partitions` must be functions of the key. Returns the version made."""
    with Staging(spark, path) as stage:
        coming = stage.put(new)

        def change() -> int:
            base = snapshots.version(spark, path)
            if not base.number:
                return snapshots.put(spark, path, coming, partitions, base)
            touched = coming.select(*partitions).distinct()
            old = read(spark, path, base.number).join(touched, list(partitions), "left_semi").select(*base.schema.names)
            return snapshots.put(spark, path, replaced(keys, old, coming), partitions, base)

        return _again(change)


def rewrite(spark: SparkSession, path: str, kept: DataFrame, touched: DataFrame, partitions: Sequence[str], base: int | None = None) -> int:
    """Put `kept` in the place of the `touched` partitions (a few rows of their values); those with no row left go.

    `base` is the version that `kept` was made of (the newest by default); `Conflict` if there is a later one.
    """
    state = snapshots.version(spark, path, base)
    values = touched.select(*[F.col(p).cast("string").alias(p) for p in partitions]).distinct().collect()
    gone = {snapshots.named(v.asDict(), partitions) for v in values}
    return snapshots.put(spark, path, kept, partitions, state, [p for p in state.parts if unquote(p) in gone])


def drop_partitions(spark: SparkSession, path: str, condition: Column, partitions: Sequence[str]) -> int:
    """Take the partitions whose values meet a condition out of the table; no row is read. Returns their number."""
    dropped = 0

    def change() -> int:
        nonlocal dropped
        base = snapshots.version(spark, path)
        gone = set(snapshots.matching(spark, base, condition, partitions))
        dropped = len(gone)
        kept = {p: w for p, w in base.parts.items() if p not in gone}
        return snapshots.publish(spark, path, Version(base.number + 1, kept, base.schema)) if gone else base.number

    _again(change)
    return dropped
