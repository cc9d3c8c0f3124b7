"""Stored concentration frames: Parquet by gas, hour and kind, with a checksum of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.functions.expressions import shift_hours
from zephyrframe.operators.field import FRAME_TYPES
from zephyrframe.sources.store import Staging, read, rewrite

FORMAT_VERSION = 2
KEYS = ("substance_code", "hour_start", "data_kind")
KINDS = ("analysis", "forecast")


def encode(cells: DataFrame) -> DataFrame:
    """Cells in their stored types, with the format's version and a hash of each cell.

    Absent floating-point columns are NULL; an absent integer column is an error.
    """
    lacking = [c for c, t in FRAME_TYPES.items() if c not in cells.columns and t in ("int", "smallint")]
    if lacking:
        raise ValueError(f"frame lacks {', '.join(lacking)}")
    typed = cells.select(*KEYS, *[(F.col(c) if c in cells.columns else F.lit(None)).cast(t).alias(c) for c, t in FRAME_TYPES.items()])
    return typed.withColumns({"format_version": F.lit(FORMAT_VERSION), "cell_hash": cell_hash()})


def cell_hash() -> Column:
    """A hash over a cell's stored columns."""
    return F.sha2(F.to_json(F.struct(*FRAME_TYPES)), 256)


def frame_hash(cells: DataFrame) -> DataFrame:
    """keys, content_sha256, cell_count: the hash of the sums of a frame's cell hashes, in whatever order.

    A cell's hash is eight numbers of 32 bits, each summed, so partial sums are combined before the
    shuffle and no frame is gathered. A lost, doubled or changed cell changes the sums.
    """
    words = [F.conv(F.substring("cell_hash", 8 * k + 1, 8), 16, 10).cast("decimal(10,0)") for k in range(8)]
    sums = cells.groupBy(*KEYS).agg(*[F.sum(w).alias(f"__{k}") for k, w in enumerate(words)], F.count("*").alias("cell_count"))
    totals = [F.col(c).cast("string") for c in (*[f"__{k}" for k in range(8)], "cell_count")]
    return sums.select(*KEYS, F.sha2(F.concat_ws(",", *totals), 256).alias("content_sha256"), "cell_count")


def sealed(coded: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Encoded cells with what their whole frame is checked by, and when it was made."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    return coded.join(frame_hash(coded), list(KEYS)).withColumn("generated_at", stamp)


def decode(stored: DataFrame) -> DataFrame:
    """Cells of stored frames; a wrong version, a changed cell and a lost or doubled cell raise when rows are read."""
    found = frame_hash(stored).withColumnsRenamed({"content_sha256": "__hash", "cell_count": "__count"})
    rows = stored.join(found, list(KEYS))
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    whole = (F.col("__hash") == F.col("content_sha256")) & (F.col("__count") == F.col("cell_count"))
    first = F.when(F.col("format_version") != FORMAT_VERSION, fail("unsupported frame format"))
    checked = first.when((F.col("cell_hash") != cell_hash()) | ~F.coalesce(whole, F.lit(False)), fail("frame checksum does not match")).otherwise(F.col("grid_x"))
    return rows.withColumn("grid_x", checked).select(*KEYS, *FRAME_TYPES)


def replace_frames(spark: SparkSession, path: str, cells: DataFrame, wanted: DataFrame | None = None, generated_at: Column | None = None) -> None:
    """Write frames over their partitions; keys of `wanted` (a few rows) without cells are removed."""
    parts = ["substance_code", "hour", "data_kind"]
    hour = F.date_format("hour_start", "yyyyMMddHH").alias("hour")
    # Cells come from a solver, so they are written once before they are hashed and stored.
    with Staging(spark, path) as stage:
        named = sealed(stage.put(encode(cells)), generated_at).withColumn("hour", hour)
        touched = named.select(*parts) if wanted is None else wanted.select("substance_code", hour, "data_kind")
        rewrite(spark, path, named, touched, parts)


def generations(stored: DataFrame) -> DataFrame:
    """substance_code, hour_start, data_kind, generated_at: when each stored frame was made."""
    return stored.groupBy(*KEYS).agg(F.max("generated_at").alias("generated_at"))


def read_frame(spark: SparkSession, path: str, gas: str, hour_start: Column, kind: str) -> DataFrame:
    """The cells of one frame; only its partition is read."""
    stored = read(spark, path)
    one = stored.filter((F.col("substance_code") == gas) & (F.col("hour").cast("string") == F.date_format(hour_start, "yyyyMMddHH")) & (F.col("data_kind") == kind))
    return decode(one)


def stored_forecasts(stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """The cells of forecasts from start to end (inclusive), checked: the priors of analyses of those hours."""
    hour = lambda at: F.date_format(at, "yyyyMMddHH")
    name = F.col("hour").cast("string")
    return decode(stored.filter((F.col("data_kind") == "forecast") & (name >= hour(start)) & (name <= hour(end))))


def expired(frames: DataFrame, cutoff: Column, retention_hours: int) -> DataFrame:
    """Rows of frames before the retention time."""
    return frames.filter(F.col("hour_start") < shift_hours(cutoff, -retention_hours))


def retained(frames: DataFrame, cutoff: Column, retention_hours: int) -> DataFrame:
    """Rows of frames within the retention time."""
    return frames.filter(F.col("hour_start") >= shift_hours(cutoff, -retention_hours))
