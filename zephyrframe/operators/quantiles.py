"""Exact quantiles of groups by rank selection, without holding a group.

Values are counted first, with partial counts before the shuffle, by group and value, so one
large group is spread like any other. Counts are summed by bins of a ten-thousandth of
a value's size; running sums over the bins tell which bin holds a rank, and only that
bin's values are ranked. No buffer holds a group: windows see one row a bin, or the
distinct values of a single bin, and they spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.sources.store import checkpoint_dir

#: Bins for each factor of e of a value's size, and the size below which values share a bin.
FINENESS, SMALLEST = 10_000, 1e-6


def value_bin(value: Column) -> Column:
    """A bin number that never falls as values rise: the logarithm of their size, with their sign."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) / SMALLEST) * FINENESS)).cast("long")


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], write: bool = False) -> DataFrame:
    """keys and `quantiles`, an array in the order of the probabilities, interpolated between neighbouring ranks.

    Null and NaN values don't count; a group without others has no row. Null keys are a group like others.
    The counts are read twice. With `write` they are checkpointed at once, for rows that
    take long to work out; else Spark reuses their shuffle within a query.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    there = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    counts = there.groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__bin", value_bin(F.col("__v")))
    if write:
        checkpoint_dir(rows.sparkSession)
        counts = counts.checkpoint()
    mine, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n"))
    bins = bins.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(mine)})
    at = [F.lit(float(p)) * (F.col("__all") - 1) for p in probabilities]
    places = [F.struct(F.lit(k).alias("which"), F.lit(end).alias("end"), (F.floor(a) if not end else F.ceil(a)).cast("long").alias("rank"), (a - F.floor(a)).alias("share")) for k, a in enumerate(at) for end in (0, 1)]
    held = F.filter(F.array(*places), lambda x: (x["rank"] < F.col("__upto")) & (x["rank"] >= F.col("__upto") - F.col("__n")))
    # A bin that holds ranks: at most two for each probability and group.
    wanted = bins.withColumn("__held", held).filter(F.size("__held") > 0).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), (F.col("__upto") - F.col("__n")).alias("__before"), "__held")
    same = F.col("__bin") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(wanted, same).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    found = near.withColumn("__x", F.explode("__held")).filter((F.col("__x.rank") < F.col("__upto")) & (F.col("__x.rank") >= F.col("__upto") - F.col("__n")))
    of = lambda k, end: F.max(F.when((F.col("__x.which") == k) & (F.col("__x.end") == end), F.col("__v")))
    share = lambda k: F.max(F.when(F.col("__x.which") == k, F.col("__x.share")))
    between = [F.when(share(k) == 0, of(k, 0)).otherwise((1 - share(k)) * of(k, 0) + share(k) * of(k, 1)) for k in range(len(probabilities))]
    return found.groupBy(*keys).agg(F.array(*between).alias("quantiles"))
