"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and `cap` that give each source its target of
words, those closest to one copy each (in relative entropy) are exponentially
tilted in document size: rate = min(cap, exp(tilt * size / mean size of the source)).
The tilts solve the convex dual, one equation for each source, by Newton
iterations; an iteration is one aggregation for all sources over the strata of
equal (source, size), so its cost follows the number of different sizes.

Rates become whole copies by stratum. Strata are laid out from the largest size
down and the running sum of expected copies is rounded, so that the words taken
are off by about half a document; then one stratum for each eighth of a power of
two of size takes up what is left, from large to small. Within a stratum, copies are
dealt by hash of the id, in slots, so no stratum is ever gathered in one task.

Sums that decide anything are exact (decimals and integers), so reruns agree.

Defined results: a null text has size 0. Sources are ordered by code point, null
is a source of its own and comes last. Rows that repeat an id with the same
source and size are one unit and get equal copies. A source at its cap takes
`cap` copies of everything; one without words takes none of them. An empty
table gives no rows. The number of sources is assumed to fit a window in one
task (as weights are given by source); nothing else is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.llm.common import HOT_KEYS, HOT_ROWS, WORD, join_spread, materialize, unused

#: Binary places of expected copies.
PLACES = 20
#: Tables by source are written as one file, as they fit a window in one task anyway.
ONE_FILE = 1
#: Rows of a stratum that are ranked together.
SLOT_ROWS = 1024


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """s (number of a source from 1), source, source_size, n_rows, target: words shared by weight, none above cap times its size.

    `rows` has source and size. Sources by ascending cap for each weight fill up
    first; the others share what is left by weight.
    """
    sums = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), ONE_FILE)
    numbered = sums.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "s")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = capped.withColumn("level", left / open_weight).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    first_open = F.min_by("level", F.when(~F.col("full"), F.col("most") / F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.coalesce(first_open, F.lit(0.0)) * F.col("weight"))
    return materialize(level.withColumn("target", F.least("most", target)).select("s", "source", "source_size", "n_rows", "target"), ONE_FILE)


def solve_tilts(strata: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """s, tilt: for each source the root of taken(tilt) = target; null where the target is the cap.

    Newton steps on the logarithm of both sides, kept within the bracket found so far.
    """
    state = materialize(
        sources.select("s", "source_size", "n_rows", "target", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("done"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")),
        ONE_FILE,
    )
    for at in range(rounds + 1):
        if state.filter("not done").isEmpty():
            break
        if at == rounds:
            raise ArithmeticError(f"{state.filter('not done').count()} sources have no tilt after {rounds} rounds")
        rate = F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(100.0)))
        words = F.col("n") * F.col("unit")
        exact = lambda c: F.sum(c.cast("decimal(38,9)"))  # noqa: E731  sums that don't depend on the order of rows
        sums = strata.join(state.filter("not done").select("s", "tilt"), "s").groupBy("s").agg(
            exact(words * F.least(rate, F.lit(cap))).cast("double").alias("taken"),
            exact(F.when(rate < cap, words * F.col("x") * rate).otherwise(0.0)).cast("double").alias("slope"),
        )
        now = state.join(sums, "s", "left")
        tilt, low, high = F.col("tilt"), F.col("low"), F.col("high")
        under = F.col("taken") < F.col("target")
        now = now.withColumn("low", F.when(under, tilt).otherwise(low)).withColumn("high", F.when(under, high).otherwise(tilt))
        newton = tilt + F.try_divide(F.log(F.col("target") / F.col("taken")) * F.col("taken"), F.col("slope"))
        span = 4 * (1 + F.abs(tilt))
        step = F.greatest(tilt - span, F.least(tilt + span, F.coalesce(newton, F.when(under, tilt + span).otherwise(tilt - span))))
        inside = (F.coalesce(step > low, F.lit(True))) & (F.coalesce(step < high, F.lit(True)))
        step = F.when(inside, step).otherwise((low + high) / 2)
        near = F.abs(F.col("taken") - F.col("target")) <= tolerance * F.col("target")
        done = F.col("done") | near | F.coalesce(high - low <= 1e-15 * (1 + F.abs(tilt)), F.lit(False))
        state = materialize(now.withColumn("done2", done).withColumn("tilt", F.when(F.col("done2"), tilt).otherwise(step)).select("s", "source_size", "n_rows", "target", F.col("done2").alias("done"), "tilt", "low", "high"), ONE_FILE)
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    return state.select("s", F.when(~full, F.col("tilt")).alias("tilt"))


def round_strata(strata: DataFrame, sources: DataFrame, tilts: DataFrame, cap: int) -> DataFrame:
    """s, size, m, n, copies: whole copies for each stratum, near each source's target in words."""
    rate = F.when(F.col("unit") == 0, 1.0).when(F.col("tilt").isNull(), float(cap)).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(100.0))), F.lit(float(cap))))
    rated = strata.join(tilts, "s").withColumn("part", F.round(F.col("n") * rate * (1 << PLACES)).cast("long"))
    # A running sum in two levels: over bands of size, and within a band.
    rated = rated.withColumn("band", F.floor(8 * F.log2(F.col("unit") + 1)).cast("int"))
    bands = rated.groupBy("s", "band").agg(F.sum("part").alias("band_part"))
    down = Window.partitionBy("s").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("s", "band", F.coalesce(F.sum("band_part").over(down), F.lit(0)).alias("above"))
    within = Window.partitionBy("s", "band").orderBy(F.desc("unit"), "m").rowsBetween(Window.unboundedPreceding, 0)
    summed = rated.join(bands, ["s", "band"]).withColumn("upto", F.col("above") + F.sum("part").over(within))
    half = 1 << (PLACES - 1)
    rounded = lambda c: F.shiftright(c + half, PLACES)
    size = strata.count()
    first = materialize(summed.select("s", "size", "m", "n", "unit", (rounded(F.col("upto")) - rounded(F.col("upto") - F.col("part"))).alias("copies")), size)
    taken = first.groupBy("s").agg(F.sum(F.col("copies") * F.col("unit")).alias("taken"))
    one = F.struct("unit", "size", "m", "n", "copies")
    chosen = first.filter("unit > 0").withColumn("part", F.floor(8 * F.log2("unit")).cast("int")).groupBy("s", "part").agg(F.max_by(one, F.struct("n", -F.col("unit"), -F.col("size"))).alias("one"))
    # At most eight times 63 for each source.
    lists = chosen.groupBy("s").agg(F.sort_array(F.collect_list("one"), asc=False).alias("ones")).join(taken, "s").join(sources.select("s", "target"), "s")

    def take_up(state: Column, x: Column) -> Column:
        left = state["left"]
        more = F.least(cap * x["n"] - x["copies"], F.floor((left + x["unit"] * 0.5) / x["unit"]))
        less = F.least(x["copies"], F.floor((x["unit"] * 0.5 - left) / x["unit"]))
        change = F.when(left > 0, F.greatest(more, F.lit(0))).otherwise(-F.greatest(less, F.lit(0))).cast("long")
        return F.struct((left - change * x["unit"]).alias("left"), F.concat(state["changes"], F.array(F.struct(x["size"].alias("size"), x["m"].alias("m"), change.alias("change")))).alias("changes"))

    start = F.struct((F.col("target") - F.col("taken")).cast("double").alias("left"), F.array().cast("array<struct<size:bigint,m:bigint,change:bigint>>").alias("changes"))
    changes = lists.select("s", F.inline(F.aggregate("ones", start, take_up, lambda s: s["changes"])))
    return materialize(first.join(changes, ["s", "size", "m"], "left").select("s", "size", "m", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")), size)


def deal_copies(units: DataFrame, strata: DataFrame) -> DataFrame:
    """The units (id, s, size, m) with copies: those of a stratum by hash of the id."""
    # A size that a third of all documents share is one stratum; its units are dealt over several tasks.
    most = max(HOT_ROWS, units.count() // HOT_KEYS)
    hot = materialize(strata.filter(F.col("n") > most).select("s", "size", "m", F.ceil(F.col("n") / most).cast("int").alias("__cuts")), HOT_KEYS)
    cut = join_spread(units, strata, ["s", "size", "m"], "id", hot).withColumn("cuts", F.ceil(F.col("n") / SLOT_ROWS)).withColumn("hash", F.xxhash64("id"))
    cut = cut.withColumn("cut", F.pmod("hash", "cuts"))
    keys = ["s", "size", "m", "cut"]
    counts = cut.filter("cuts > 1").groupBy(*keys).count()
    before = Window.partitionBy("s", "size", "m").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "id")))
    placed = ranked.join(offsets, keys, "left")
    each = F.floor(F.col("copies") / F.col("n"))
    extra = F.coalesce("offset", F.lit(0)) + F.col("rank") <= F.col("copies") - each * F.col("n")
    return placed.select("id", "s", "size", (each + F.when(extra, 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """id, source, size, source_size, target, copies, taken (copies times size): one row for each row of `docs`."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    sources = source_targets(rows, weights, share, cap)
    named = sources.select("s", F.col("source").alias("__source"))
    keyed = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).select("id", "s", "size")
    units = materialize(keyed.groupBy("id", "s", "size").agg(F.count("*").alias("m")))
    mean = sources.select("s", (F.greatest("source_size", F.lit(1)) / F.col("n_rows")).alias("mean"))
    strata = units.groupBy("s", "size", "m").agg(F.count("*").alias("n")).withColumn("unit", F.col("size") * F.col("m"))
    strata = materialize(strata.join(mean, "s").withColumn("x", F.col("size") / F.col("mean")).drop("mean"))
    copies = deal_copies(units, round_strata(strata, sources, solve_tilts(strata, sources, cap), cap))
    back = copies.select(F.col("id").alias("__id"), "s", "size", "copies")
    joined = keyed.join(back, F.col("id").eqNullSafe(F.col("__id")) & (keyed["s"] == back["s"]) & (keyed["size"] == back["size"])).select("id", keyed["s"], keyed["size"], "copies")
    return joined.join(sources, "s").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, all columns kept."""
    own, source, size, copies, words, copy = unused(docs, "__id", "__source", "__size", "__copies", "__words", "__copy")
    mixed = mix(docs, id_col, source_col, text_col, **options)
    taken = mixed.select(F.col(id_col).alias(own), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).filter(F.col(copies) > 0).distinct()
    sized = docs.withColumn(words, word_count(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(own)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    return sized.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
