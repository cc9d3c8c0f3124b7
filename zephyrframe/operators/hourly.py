"""Hourly features of raw samples.

A series (post and gas) may hold most of all samples, so it is cut into slices of
hours, and windows run inside slices: each slice gets the two samples before it as a halo, and
what runs on over slices (gaps counted, the cadence) is worked out on tables of one row a
slice or a value and joined back. Samples are shuffled once, by series and slice; the
windows and the hourly aggregate keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.functions.expressions import local_hour
from zephyrframe.operators.quantiles import group_quantiles
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources.readings import MEASURES

SERIES = ("monitoring_post_id", "substance_code")


def unsigned(samples: DataFrame) -> DataFrame:
    """Samples with absolute values; those without a value go."""
    return samples.withColumn("value", F.abs("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


#: Whole local hours of a slice.
SLICE_HOURS = 6
SLICED = (*SERIES, "__slice")


def _order(tie: str | None) -> list[str]:
    return ["timestamp", *([tie] if tie else [])]


def _slice(settings: Settings) -> Column:
    hour = F.unix_seconds(local_hour(F.col("timestamp"), settings.timezone))
    return F.floor(hour / (3600 * SLICE_HOURS)).cast("long")


def with_two_before(samples: DataFrame, tie: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds __slice and, of the two samples before each one in its series, microseconds (__t1, __t2) and values (__v1, __v2).

    A slice gets the two samples before it as a halo. They are among the last two samples of
    slices, a table of two rows a slice, where a slice's first row follows them.
    """
    cut = samples.withColumn("__slice", _slice(settings))
    backwards = Window.partitionBy(*SLICED).orderBy(*[F.desc(c) for c in _order(tie)])
    ends = cut.withColumn("__back", F.row_number().over(backwards)).filter("__back <= 2").drop("__back")
    along = Window.partitionBy(*SERIES).orderBy(*_order(tie))
    row = F.struct(*[c for c in cut.columns if c != "__slice"])
    pulled = ends.withColumns({f"__p{k}": F.lag(row, k).over(along) for k in (1, 2)}).withColumn("__before", F.lag("__slice").over(along))
    firsts = pulled.filter(F.col("__before") != F.col("__slice"))
    halo = firsts.select("__slice", F.explode(F.array_compact(F.array("__p1", "__p2"))).alias("__p")).select("__p.*", "__slice", F.lit(True).alias("__halo"))
    both = cut.withColumn("__halo", F.lit(False)).unionByName(halo)
    ordered = Window.partitionBy(*SLICED).orderBy(*_order(tie))
    micros = F.unix_micros("timestamp")
    before = {f"__{n}{k}": F.lag(c, k).over(ordered) for n, c in (("t", micros), ("v", F.col("value"))) for k in (1, 2)}
    return both.withColumns(before).filter(~F.col("__halo")).drop("__halo")


def cadences(samples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """cadence_s by series and slice, for series of two instants or more: the median of a series' positive intervals, those inside slices and those between them."""
    cut = samples.select(*SERIES, F.unix_micros("timestamp").alias("t"), _slice(settings).alias("__slice"))
    inside = cut.select(*SERIES, (F.col("t") - F.lag("t").over(Window.partitionBy(*SLICED).orderBy("t"))).alias("d"))
    spans = cut.groupBy(*SLICED).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    between = spans.select(*SERIES, (F.col("first") - F.lag("last").over(Window.partitionBy(*SERIES).orderBy("__slice"))).alias("d"))
    intervals = inside.unionByName(between).filter("d > 0").select(*SERIES, (F.col("d") / 1e6).alias("delta_s"))
    found = group_quantiles(intervals, SERIES, "delta_s", [0.5]).select(*SERIES, F.col("quantiles")[0].alias("cadence_s"))
    return spans.select(*SLICED).join(found, list(SERIES))


def with_gaps(samples: DataFrame, tie: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """`with_two_before` with delta_s, cadence_s (the median of a series' positive intervals) and __begins: an interval above three cadences."""
    out = with_two_before(samples, tie, settings).withColumn("delta_s", (F.unix_micros("timestamp") - F.col("__t1")) / 1e6)
    # By slice, so that samples stay where they are.
    out = out.join(cadences(samples, settings), list(SLICED), "left")
    return out.withColumn("__begins", F.coalesce(F.col("delta_s") > 3 * F.col("cadence_s"), F.lit(False)))


_OWN = ("__slice", "__t1", "__t2", "__v1", "__v2", "__begins")


def segments(samples: DataFrame, tie: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds delta_s, cadence_s and segment: a gap above three median intervals begins a segment."""
    return _numbered(with_gaps(samples, tie, settings), tie).drop(*_OWN)


def _numbered(gaps: DataFrame, tie: str | None) -> DataFrame:
    """Adds segment: gaps counted inside the slice, and those of the slices before it."""
    begins = F.col("__begins").cast("long")
    sums = gaps.groupBy(*SLICED).agg(F.sum(begins).alias("__gaps"))
    earlier = Window.partitionBy(*SERIES).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*SLICED, F.coalesce(F.sum("__gaps").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*SLICED).orderBy(*_order(tie)).rowsBetween(Window.unboundedPreceding, 0)
    counted = gaps.withColumn("segment", F.sum(begins).over(inside))
    return counted.join(offsets, list(SLICED)).withColumn("segment", F.col("segment") + F.col("__offset")).drop("__offset")


def _filtered(gaps: DataFrame) -> DataFrame:
    """Adds filtered_value. A sample's predecessor is in its segment unless it begins one, and the one before that unless the predecessor does."""
    a, b = F.col("value"), F.when(~F.col("__begins"), F.col("__v1"))
    joined = F.coalesce((F.col("__t1") - F.col("__t2")) / 1e6 <= 3 * F.col("cadence_s"), F.lit(True))
    c = F.when(b.isNotNull() & joined, F.col("__v2"))
    of_three = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return gaps.withColumn("filtered_value", F.when(c.isNotNull(), of_three).when(b.isNotNull(), (a + b) / 2).otherwise(a))


def causal_median(samples: DataFrame, tie: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds filtered_value: the median of a sample and the two before it in its segment; and what `segments` adds.

    Of values that are not null, as `unsigned` gives them. Two offsets and a
    comparison take the place of a sliding aggregate, so rows stay in generated code.
    """
    return _filtered(_numbered(with_gaps(samples, tie, settings), tie)).drop(*_OWN)


def aggregate_hours(filtered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The eight hourly measures of samples that have filtered_value."""
    hours = filtered.withColumn("bucket_start", local_hour(F.col("timestamp"), settings.timezone))
    # An hour lies in one slice, so naming both keeps the samples where they are.
    keys = [*(c for c in ("__slice",) if c in filtered.columns), "bucket_start"]
    return hours.groupBy(*SERIES, *keys).agg(
        F.avg("value").alias("raw_hourly_mean"),
        F.percentile("value", F.lit(0.5)).alias("raw_hourly_median"),
        F.avg("filtered_value").alias("filtered_hourly_mean"),
        F.min("value").alias("hourly_min"),
        F.max("value").alias("hourly_max"),
        F.percentile("value", F.lit(0.95)).alias("hourly_p95"),
        F.stddev_pop("value").alias("hourly_std"),
        F.count("value").alias("samples_count"),
    ).drop("__slice")


def build_hourly(samples: DataFrame, settings: Settings = DEFAULTS, tie: str | None = None) -> DataFrame:
    """Hourly features of raw samples (monitoring_post_id, substance_code, timestamp, value)."""
    return aggregate_hours(_filtered(with_gaps(unsigned(samples), tie, settings)), settings)


def from_aggregated(readings: DataFrame) -> DataFrame:
    """Hourly features of readings that are hourly already: one unfiltered sample each."""
    same = {m: F.col("value") for m in MEASURES} | {"hourly_std": F.lit(0.0)}
    return readings.select(*SERIES, "bucket_start", *[same[m].alias(m) for m in MEASURES], F.lit(1).cast("long").alias("samples_count"))


def union_hourly(internal: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Both kinds of hourly features; where keys meet, a later upsert takes the aggregated one."""
    return internal.unionByName(aggregated)
