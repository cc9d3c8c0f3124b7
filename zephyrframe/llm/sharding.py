"""Sharding by fixed virtual slots.

Every row is hashed into one of a fixed number of virtual slots. Bytes are
summed by slot, and a versioned map gives each slot a shard: heaviest slots
first, each to the shard with fewest bytes so far. The map covers all slots, is
stored by version and read back; the latest version counts, and a version is written
once. Rebalancing edits the map, so only the rows of moved slots move.

All of it is built from DataFrame functions. The map has as many rows as there
are slots, a fixed parameter, so it may be gathered in one row and broadcast.

Law: bytes. Shards are near equal: they differ by no more than about one virtual slot.

Defined results: a null text has 0 bytes, so size 1, and the checksum of no
bytes. A null id is hashed like any value. Equal texts need not share a shard.
Rows that repeat id and text are alike in all that is read, so where they are
many they are counted, numbered and hashed with their number: they spread over all slots, by
the same numbers in every run. `slot` numbers the rows of a shard from 0 without gaps, by virtual slot,
then id, then checksum. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.llm.common import HOT_KEYS, hot_keys, materialize, scratch_path

SLOTS = 4096


def virtual_slot(slots: int, *keys: Column) -> Column:
    """The virtual slot of a row."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n_rows: one row for each slot in use, partly summed before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def slot_map(sums: DataFrame, shards: int, version: int = 1, slots: int = SLOTS) -> DataFrame:
    """version, virtual_slot, shard: all slots from heaviest to lightest, each to the lightest shard so far; empty ones by number."""
    every = sums.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    every = every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    full, empty = every.filter("bytes > 0"), every.filter("bytes = 0")
    spare = empty.select(F.lit(version).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"))
    heaviest = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot"))))
    loads = F.array(*[F.struct(F.lit(0).cast("long").alias("load"), F.lit(k).alias("shard")) for k in range(shards)])

    def deal(state: Column, slot: Column) -> Column:
        least = F.array_min(state["loads"])
        grown = F.transform(state["loads"], lambda x: F.when(x["shard"] == least["shard"], F.struct((x["load"] - slot["minus"]).alias("load"), x["shard"].alias("shard"))).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["dealt"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), least["shard"].alias("shard")))).alias("dealt"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("dealt"))
    dealt = full.agg(heaviest.alias("slots")).select(F.inline(F.aggregate("slots", start, deal, lambda s: s["dealt"])))
    return dealt.select(F.lit(version).alias("version"), "virtual_slot", "shard").unionByName(spare)


def grow_map(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one shard more: only the slots moved to the new shard change.

    From each old shard the lightest slots move while they stay within its surplus.
    """
    total = sums.agg((F.sum("bytes") / (shards + 1)).alias("fair"))
    lightest = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    weighed = current.join(F.broadcast(sums.select("virtual_slot", "bytes")), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    weighed = weighed.withColumn("upto", F.sum("bytes").over(lightest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
    fair = F.broadcast(total)
    moved = weighed.join(fair, F.col("upto") <= F.col("load") - F.col("fair"), "left")
    return moved.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("fair").isNotNull(), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, virtual_slot of each row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("virtual_slot", virtual_slot(slots, F.col("id"), F.col("text_crc32")))


#: Like rows that are numbered one after the other in one task.
NUMBERED = 10_000


def spread_repeats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of `sized_rows` (written), those that repeat many times over in slots of their own numbers.

    Such rows have only their key in all columns, so they are made anew from their
    count, in stretches that are dealt over tasks.
    """
    alike = ["id", "text_crc32", "size"]
    whole = rows.withColumn("known", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("none", F.col("id").isNull())
    hot = hot_keys(whole, [*alike[1:], "known", "none"])
    if hot.isEmpty():
        return rows
    keys = [*alike[1:], "known", "none"]
    listed = F.broadcast(hot.select(*keys))
    rest = whole.join(listed, keys, "left_anti").select(*rows.columns)
    counted = materialize(whole.join(listed, keys, "left_semi").groupBy(*alike).agg(F.count("*").alias("n")), HOT_KEYS)
    stretches = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(NUMBERED).cast("long"))))
    dealt = stretches.repartition(*alike, "first")
    numbered = dealt.withColumn("number", F.explode(F.sequence("first", F.least(F.col("first") + NUMBERED, F.col("n")) - 1)))
    return rest.unionByName(numbered.select(*alike, virtual_slot(slots, F.col("id"), F.col("text_crc32"), F.col("number")).alias("virtual_slot")))


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a map that are stored below a path."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = files.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def write_map(mapping: DataFrame, path: str) -> None:
    """Add a map of one version to the stored ones, in one file, as it has no more rows than there are slots; a version that is there is refused."""
    version = mapping.agg(F.max("version")).first()[0]
    if version in stored_versions(mapping.sparkSession, path):
        raise FileExistsError(f"version {version} of the map is stored already below {path}")
    mapping.drop("version").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """virtual_slot, shard: the latest stored version of the map."""
    return latest_version(spark.read.parquet(path))


def latest_version(mapping: DataFrame) -> DataFrame:
    """virtual_slot, shard of the highest version that a map holds; a slot with two shards raises."""
    if "version" in mapping.columns:
        mapping = mapping.join(F.broadcast(mapping.agg(F.max("version").alias("version"))), "version")
    once = F.when(F.count("*") == 1, F.first("shard")).otherwise(F.raise_error(F.lit("the map has a slot twice")).cast("int"))
    return mapping.groupBy("virtual_slot").agg(once.alias("shard"))


def whole_map(mapping: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, shard of each slot in use; one that the map's latest version lacks goes to `virtual_slot` mod `shards`."""
    known = sums.select("virtual_slot").join(F.broadcast(latest_version(mapping)), "virtual_slot", "left")
    return known.select("virtual_slot", F.coalesce("shard", F.pmod("virtual_slot", F.lit(shards))).cast("int").alias("shard"))


def slotted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Written rows (id, size, text_crc32, virtual_slot) and the written sums of their slots."""
    sized = materialize(sized_rows(docs, id_col, text_col, slots))
    rows = spread_repeats(sized, slots)
    rows = rows if rows is sized else materialize(rows)
    return rows, materialize(slot_bytes(rows), slots)


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, mapping: DataFrame | None = None, map_path: str | None = None) -> DataFrame:
    """id, size, text_crc32, virtual_slot, shard, slot for each row; texts are never shuffled.

    Without a mapping the latest version below `map_path` counts; where there is none
    (or no path), version 1 is made from the slots' bytes, stored and read back. Of
    a mapping the latest version counts; a slot that it lacks goes to the shard
    `virtual_slot` mod `shards`.
    """
    spark = docs.sparkSession
    rows, sums = slotted_rows(docs, id_col, text_col, slots)
    if mapping is None:
        map_path = map_path or scratch_path(spark, "slot-map")
        if not stored_versions(spark, map_path):
            write_map(slot_map(sums, shards, slots=slots), map_path)
        mapping = read_map(spark, map_path)
    placed_slots = whole_map(mapping, sums, shards)
    # Rows of a shard before each of its virtual slots: a sum over the map, which has `slots` rows at most.
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(placed_slots.join(sums, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset")), slots)
    inside = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    placed = rows.withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(offsets), "virtual_slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("__rank") - 1).alias("slot"))


def rebalance(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """id, size, text_crc32, virtual_slot, shard, grown_shard of each row, for one shard more.

    The latest stored map is edited by the slots' present bytes and stored as the next
    version; both are read back, so `grown_shard` is what later readers of the path get.
    """
    spark = docs.sparkSession
    rows, sums = slotted_rows(docs, id_col, text_col, slots)
    map_path = map_path or scratch_path(spark, "slot-map")
    if not stored_versions(spark, map_path):
        write_map(slot_map(sums, shards, slots=slots), map_path)
    latest = stored_versions(spark, map_path)[-1]
    current = spark.read.parquet(f"{map_path}/version={latest}").withColumn("version", F.lit(latest))
    write_map(grow_map(materialize(current, slots), sums, shards), map_path)
    old = latest_version(current)
    new = read_map(spark, map_path).withColumnRenamed("shard", "grown_shard")
    both = materialize(old.join(new, "virtual_slot"), slots)
    return rows.join(F.broadcast(both), "virtual_slot").select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", "grown_shard")
