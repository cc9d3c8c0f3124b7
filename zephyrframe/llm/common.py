"""What the corpus operators share: table reading, written tables, joins that hot keys don't stop."""

from __future__ import annotations

import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the white-space word rule, as a Java and Python class.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a slim table that one task writes.
ROWS_A_FILE = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark from wherever that is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset on one machine (a local session, as in tests) a local folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="zephyrframe-"))
    return context.getCheckpointDir()


#: For each thread the folders written inside its open `scratch` blocks, the innermost last.
_OPEN = threading.local()


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder; a `scratch` block around it removes what is written there."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "blocks", None):
        _OPEN.blocks[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by way of the file system Spark uses."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside the block at its end; what is kept must be written before it."""
    _OPEN.blocks = [*getattr(_OPEN, "blocks", []), []]
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            remove(spark, path)


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage: a lost executor costs no earlier work, and later reads see
    true sizes, so joins are planned on facts. With `rows`, how many rows there
    are at most, a task writes up to ROWS_A_FILE of them, so a small table is
    no heap of tiny files and a large one is still written by many tasks.
    """
    path = scratch_path(df.sparkSession)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where `df` has such columns already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Keys that may be named hot at most, so their list is broadcast whatever the corpus; and the rows below which no key is.
HOT_KEYS = 10_000
HOT_ROWS = 1_000


def hot_keys(many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a written table with more than HOT_ROWS rows (and one in HOT_KEYS of all), and `__cuts`, the parts they need."""
    rows = max(HOT_ROWS, many.count() // HOT_KEYS)
    counted = many.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows)
    return materialize(counted.select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias("__cuts")), HOT_KEYS)


def join_spread(many: DataFrame, one: DataFrame, keys: Sequence[str], spread: str, hot: DataFrame | None = None) -> DataFrame:
    """The inner join of many rows with one row a key, in which a hot key's rows are dealt over several tasks.

    `many` is a written table. The rows of a hot key are cut by a hash of the column `spread`,
    and its one row is repeated for each cut; other keys are joined as they are.
    """
    hot = hot_keys(many, keys) if hot is None else hot
    if hot.isEmpty():
        return many.join(one, list(keys))
    listed = F.broadcast(hot)
    cut = many.join(listed, list(keys), "left").withColumn("__cut", F.coalesce(F.pmod(F.xxhash64(spread), "__cuts"), F.lit(0)).cast("int")).drop("__cuts")
    each = one.join(listed, list(keys), "left").withColumn("__cut", F.explode(F.sequence(F.lit(0), F.coalesce("__cuts", F.lit(1)) - 1))).drop("__cuts")
    return cut.join(each, [*keys, "__cut"]).drop("__cut")


def kept(name: str, key, make: Callable):
    """What `make` returns for a key, made once in each Python worker and used by its later tasks.

    One for each name; another key takes its place. For bounded helpers only,
    such as a tokenizer with its cache; results never depend on it.
    """
    store = sys.modules.setdefault("_zephyrframe_kept", types.ModuleType("_zephyrframe_kept")).__dict__
    if name not in store or store[name][0] != key:
        store.pop(name, None)
        store[name] = (key, make())
    return store[name][1]
