"""Grid operators as plans: meshes, interpolation, covariance, deposits and single transport steps.

Fields are long: one row for each cell, keyed by the columns in `keys` (a gas
and an hour, say). Stations are few for each key; cells are joined to the
stations of their own key only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zephyrframe.functions.expressions import clip, clip0
from zephyrframe.settings import DEFAULTS, Settings
from zephyrframe.sources.store import checkpoint_dir

#: Correlation left at the influence radius, and the samples an aggregated source stands for.
COVARIANCE_AT_RADIUS = 0.05
AGGREGATED_SAMPLES = 3.0


def support_radius(settings: Settings = DEFAULTS) -> float:
    """How far from a station its influence is followed, in metres."""
    import math

    return settings.influence_meters * max(1.0, math.sqrt(-math.log(max(settings.min_confidence, 1e-6)) / 2.0))


def mesh(points: DataFrame, keys: Sequence[str], step: float, padding: float) -> DataFrame:
    """keys, grid_x, grid_y, x, y: cells on multiples of `step` around points (x, y), padded on all sides."""
    down = lambda c: (F.floor((F.min(c) - padding) / step)).alias(f"{c}_low")
    up = lambda c: (F.ceil((F.max(c) + padding) / step)).alias(f"{c}_high")
    box = points.groupBy(*keys).agg(down("x"), up("x"), down("y"), up("y"))
    rows = box.withColumn("row", F.explode(F.sequence("y_low", "y_high")))
    # Boxes are few and small, so adaptive execution would put them all into one task, which would make every cell.
    rows = rows.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "row")
    cells = rows.withColumn("column", F.explode(F.sequence("x_low", "x_high")))
    return cells.select(*keys, (F.col("column") - F.col("x_low")).cast("int").alias("grid_x"), (F.col("row") - F.col("y_low")).cast("int").alias("grid_y"), (F.col("column") * step).alias("x"), (F.col("row") * step).alias("y"))


#: Rounds of a search for near stations, each with squares of twice the side.
RINGS = 60


def nearest_stations(cells: DataFrame, stations: DataFrame, keys: Sequence[str], cell: Sequence[str], k: int) -> DataFrame:
    """keys, cell and `near`: the k nearest stations of its key (monitoring_post_id, sx, sy, v) as structs d, id, v, nearest first, ties by id.

    Stations are laid into squares, whose side lets a block of nine hold a few times k of them, and
    a cell meets those of its block only. It is done once its k-th distance is below that to the block's edge,
    or the block holds every station of the key; the others go on with squares of twice the side.
    A cell whose key has no station has no row.
    """
    c = F.col
    box = stations.groupBy(*keys).agg(*[f(x).alias(f"__{n}_{x}") for n, f in (("low", F.min), ("high", F.max)) for x in ("sx", "sy")], F.count("*").alias("__n"))
    wide, tall = c("__high_sx") - c("__low_sx"), c("__high_sy") - c("__low_sy")
    side = F.greatest(F.sqrt(F.greatest(wide, F.lit(1.0)) * F.greatest(tall, F.lit(1.0)) * k / (3 * c("__n"))), F.lit(1.0))
    box = box.withColumn("__side", side)
    checkpoint_dir(cells.sparkSession)
    # Sides and squares are the same for all rounds but for a power of two.
    # Cells are merged: their size is guessed from their boxes', so a broadcast could hold them all.
    placed, pending, done = stations.join(box.select(*keys, "__side"), list(keys)), cells.hint("merge").join(box, list(keys)), None
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for ring in range(RINGS):
        now = c("__side") * 2.0**ring
        square = lambda v, now=now: F.floor(c(v) / now)
        known = placed.select(*keys, square("sx").alias("__bx"), square("sy").alias("__by"), "monitoring_post_id", "sx", "sy", "v")
        asked = pending.withColumns({"__qx": square("x"), "__qy": square("y"), "__o": F.explode(offsets)}).withColumns({"__bx": c("__qx") + c("__o.i"), "__by": c("__qy") + c("__o.j")})
        met = asked.join(known, [*keys, "__bx", "__by"], "left").withColumn("d", F.hypot(c("x") - c("sx"), c("y") - c("sy")))
        order = Window.partitionBy(*keys, *cell).orderBy(F.asc_nulls_last("d"), "monitoring_post_id")
        ranked = met.withColumn("__rank", F.row_number().over(order)).filter(c("__rank") <= k)
        held = F.collect_list(F.when(c("d").isNotNull(), F.struct("d", c("monitoring_post_id").alias("id"), "v")))
        kept = [x for x in pending.columns if x not in (*keys, *cell)]
        rows = ranked.groupBy(*keys, *cell).agg(F.array_sort(held).alias("near"), *[F.first(x).alias(x) for x in (*kept, "__qx", "__qy")])
        edge = F.least(*[e for v, q in (("x", "__qx"), ("y", "__qy")) for e in (c(v) - (c(q) - 1) * now, (c(q) + 2) * now - c(v))])
        all_in = F.lit(True)
        for v, q in (("sx", "__qx"), ("sy", "__qy")):
            all_in = all_in & ((c(q) - 1) * now <= c(f"__low_{v}")) & (c(f"__high_{v}") < (c(q) + 2) * now)
        sure = all_in | (F.size("near") >= k) & (F.element_at(c("near")["d"], -1) < edge)
        rows = rows.withColumn("__sure", sure).checkpoint()
        found = rows.filter("__sure").select(*keys, *cell, "near")
        done = found if done is None else done.unionByName(found)
        pending = rows.filter("not __sure").select(*pending.columns)
        if pending.isEmpty():
            return done
    raise ArithmeticError("some cells lie too far from their stations")


def nearest_idw(cells: DataFrame, stations: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str, k: int = 4) -> DataFrame:
    """keys, cell, interpolated: inverse squared distance of the k nearest stations; an exact hit returns its value.

    Ties of distance go to the lowest station id. Stations without a value or a place don't count.
    """
    known = stations.filter(F.col(value).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, F.col("monitoring_post_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(value).cast("double").alias("v"))
    near = nearest_stations(cells.select(*keys, *cell, "x", "y"), known, keys, cell, k)
    weight = lambda s: 1.0 / F.pow(F.greatest(s["d"], F.lit(1.0)), F.lit(2.0))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, s: a + f(s))
    first = F.col("near")[0]
    mean = total(lambda s: weight(s) * s["v"]) / total(weight)
    return near.select(*keys, *cell, F.when((F.size("near") == 1) | (first["d"] <= 1e-9), first["v"]).otherwise(mean).alias("interpolated"))


#: Steps of a cell in the side of a square where cells are sampled.
SAMPLED_SIDE = 4


def sample_nearest(queries: DataFrame, cells: DataFrame, keys: Sequence[str], query: Sequence[str], value: str, step: float, default: float) -> DataFrame:
    """keys, query, sampled: the value of the nearest cell within 0.8 steps, else a default.

    Cells are dealt into squares of a few steps; a query meets those of the squares less than a step away, mostly one or two, by equi-join.
    Sizes of cells are guessed from those of their boxes, so a broadcast could hold them all: they are merged.
    """
    c, side = F.col, SAMPLED_SIDE * step
    square = lambda v: F.floor(v / side)
    reached = lambda x: F.explode_outer(F.sequence(square(c(x) - step), square(c(x) + step)))
    known = cells.select(*[c(k).alias(f"__{k}") for k in keys], square(c("x")).alias("__bx"), square(c("y")).alias("__by"), c("x").alias("cx"), c("y").alias("cy"), c(value).alias("v"))
    asked = queries.withColumn("bx", reached("x")).withColumn("by", reached("y"))
    d = F.hypot(c("x") - c("cx"), c("y") - c("cy"))
    near = d <= 0.8 * step
    for k in (*keys, "bx", "by"):
        near = near & (c(k) == c(f"__{k}"))
    found = asked.join(known.hint("merge"), near, "left").withColumn("d", d)
    best = found.groupBy(*keys, *query).agg(F.min_by("v", F.when(c("d").isNotNull(), F.struct("d", "cx", "cy"))).alias("v"))
    return best.select(*keys, *query, F.coalesce("v", F.lit(default)).alias("sampled"))


def correlation(dx: Column, dy: Column, u: Column, v: Column, radius: float) -> Column:
    """Gaussian correlation at an offset from a station, stretched along its wind."""
    speed = F.hypot(u, v)
    moving = speed > 0.1
    eu, ev = F.when(moving, F.try_divide(u, speed)).otherwise(0.0), F.when(moving, F.try_divide(v, speed)).otherwise(1.0)
    along, across = dx * eu + dy * ev, dy * eu - dx * ev
    long = radius / 2**0.5
    narrow = F.when(moving, long / (1.0 + F.least(speed / 5.0, F.lit(2.0)))).otherwise(F.lit(long))
    return F.exp(-0.5 * ((along / long) * (along / long) + (across / narrow) * (across / narrow)))


def single_update(background: Column, background_confidence: Column, at_station: Column, confidence_at_station: Column, observed: Column, observed_confidence: Column, rho: Column) -> dict[str, Column]:
    """Optimal interpolation with one station, in closed form: value, confidence and increment of a cell."""
    spread = clip(1.0 - background_confidence, 0.05, 1.0)
    own = clip(1.0 - confidence_at_station, 0.05, 1.0)
    error = clip(1.0 - observed_confidence, 0.01, 1.0)
    covariance = rho * F.sqrt(spread * own)
    system = own + error
    increment = covariance * (observed - at_station) / system
    left = clip(spread - covariance * covariance / system, 0.0, 1.0)
    return {"value": clip0(background + increment), "confidence": clip(F.greatest(background_confidence, 1.0 - left), 0.0, 1.0), "increment": increment}


def observation_confidence(anchors: DataFrame, keys: Sequence[str]) -> Column:
    """Confidence of anchors: given, else by samples against the most of its key, else by interval width, else 1."""
    has = lambda c: F.col(c).cast("double") if c in anchors.columns else F.lit(None).cast("double")
    group = Window.partitionBy(*keys)
    samples = has("samples_count")
    if "source" in anchors.columns:
        samples = F.when((F.col("source") == "mosecom") & (F.max(has("samples_count")).over(group).isNotNull()), F.lit(AGGREGATED_SAMPLES)).otherwise(samples)
    most = F.greatest(F.max(samples).over(group), F.lit(1.0))
    by_samples = F.when(F.max(has("samples_count")).over(group).isNotNull(), clip(samples / most, 0.05, 1.0))
    width = has("upper_bound") - has("lower_bound")
    by_width = F.when(width >= 0, 1.0 / (1.0 + width / F.greatest(F.abs(F.col("value")), F.lit(1e-9))))
    return clip(F.coalesce(has("observation_confidence"), by_samples, by_width, F.lit(1.0)), 0.05, 1.0)


def anchor_weather(speed: Column, direction: Column, height: Column, rain: Column, fallback: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Speed and direction together or the fallback's; mixing height within 50 to 4000 m; rain at least 0."""
    both = speed.isNotNull() & direction.isNotNull()
    return {
        "speed": F.when(both, F.greatest(speed, F.lit(0.0))).otherwise(F.greatest(F.coalesce(fallback[0], F.lit(0.0)), F.lit(0.0))),
        "direction": F.when(both, direction).otherwise(F.coalesce(fallback[1], F.lit(0.0))),
        "height": F.coalesce(clip(height, 50.0, 4000.0), fallback[2], F.lit(500.0)),
        "rain": F.coalesce(clip0(rain), F.greatest(F.coalesce(fallback[3], F.lit(0.0)), F.lit(0.0))),
    }


def backward_correction(cells: DataFrame, stations: DataFrame, keys: Sequence[str], cell: Sequence[str], step: float, settings: Settings = DEFAULTS) -> DataFrame:
    """keys, cell, correction, weight: what innovations say about the air that reached the stations within the hour.

    `stations` has x, y, innovation, confidence, u, v. The path leads one hour upwind. A
    station's path, widened by the influence radius, is laid out in squares of half a radius, and cells
    meet the stations of their square only; other cells of a key with moving stations get 0.
    """
    import math

    radius = float(settings.influence_meters)
    side = radius / 2
    s = stations.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), "innovation", F.col("confidence").alias("trust"), "u", "v", (-F.col("u") * 3600.0).alias("px"), (-F.col("v") * 3600.0).alias("py"))
    s = s.withColumn("way", F.hypot("px", "py")).filter((F.col("way") >= step) & F.col("innovation").isNotNull())
    c = F.col
    # Points of the path lie `side` apart at most, so what is within the radius of the path is within that and half a side of one.
    reach = radius + side / 2 + 1.0
    stops = F.ceil(c("way") / side).cast("int")
    low, high = (lambda x: F.floor((x - reach) / side)), (lambda x: F.floor((x + reach) / side))
    around = lambda x, y: F.flatten(F.transform(F.sequence(low(x), high(x)), lambda i: F.transform(F.sequence(low(y), high(y)), lambda j: F.struct(i.alias("bx"), j.alias("by")))))
    swept = F.flatten(F.transform(F.sequence(F.lit(0), stops), lambda k: around(c("sx") + c("px") * (k / stops), c("sy") + c("py") * (k / stops))))
    laid = s.withColumn("__square", F.explode(F.array_distinct(swept))).select("*", "__square.bx", "__square.by").drop("__square")
    there = cells.withColumns({"bx": F.floor(c("x") / side), "by": F.floor(c("y") / side)})
    pairs = there.hint("merge").join(laid, [*keys, "bx", "by"])
    part = clip(((c("x") - c("sx")) * c("px") + (c("y") - c("sy")) * c("py")) / (c("way") * c("way")), step / c("way"), 1.0)
    pairs = pairs.withColumn("part", part).withColumns({"dx": c("x") - c("sx") - c("px") * c("part"), "dy": c("y") - c("sy") - c("py") * c("part")})
    speed = F.hypot("u", "v")
    eu, ev = c("u") / speed, c("v") / speed
    along, across = c("dx") * eu + c("dy") * ev, c("dy") * eu - c("dx") * ev
    long = radius / math.sqrt(-2.0 * math.log(COVARIANCE_AT_RADIUS))
    narrow = long / (1.0 + F.least(speed / 5.0, F.lit(2.0)))
    strength = F.exp(-0.5 * ((along / long) * (along / long) + (across / narrow) * (across / narrow))) * F.exp(-c("part")) * c("trust")
    strength = F.when(F.hypot("dx", "dy") > radius, 0.0).otherwise(strength)
    sums = pairs.groupBy(*keys, *cell).agg(F.sum(strength * c("innovation")).alias("a"), F.sum(strength).alias("b"))
    every = cells.join(s.select(*keys).distinct(), list(keys), "left_semi").select(*keys, *cell).join(sums, [*keys, *cell], "left")
    return every.select(*keys, *cell, F.coalesce(F.try_divide("a", "b"), F.lit(0.0)).alias("correction"), clip(F.coalesce("b", F.lit(0.0)), 0.0, 1.0).alias("weight"))


def deposit(points: DataFrame, keys: Sequence[str], step: float, low: tuple[Column, Column], shape: tuple[Column, Column], value: str = "value") -> DataFrame:
    """keys, grid_x, grid_y, value: each value split over the four cells around it; what falls outside is dropped."""
    fx, fy = (F.col("x") - low[0]) / step, (F.col("y") - low[1]) / step
    x0, y0 = F.floor(fx), F.floor(fy)
    rx, ry = fx - x0, fy - y0
    corner = lambda dx, dy, share: F.struct((x0 + dx).cast("int").alias("grid_x"), (y0 + dy).cast("int").alias("grid_y"), (F.col(value) * share).alias("value"))
    corners = F.array(corner(0, 0, (1 - rx) * (1 - ry)), corner(1, 0, rx * (1 - ry)), corner(0, 1, (1 - rx) * ry), corner(1, 1, rx * ry))
    split = points.filter(F.col(value).isNotNull()).select(*keys, F.inline(corners), shape[0].alias("__nx"), shape[1].alias("__ny"))
    inside = split.filter("grid_x >= 0 and grid_y >= 0 and grid_x < __nx and grid_y < __ny")
    return inside.groupBy(*keys, "grid_x", "grid_y").agg(F.sum("value").alias("value"))


def _line(keys: Sequence[str], across: str, along: str):
    return Window.partitionBy(*keys, across).orderBy(along)


def limited_slope(field: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Adds slope_x and slope_y: the smaller of both differences where they agree in sign; 0 at edges."""
    def slope(w) -> Column:
        back, ahead = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
        return F.coalesce(F.when(back * ahead > 0, F.signum(back) * F.least(F.abs(back), F.abs(ahead))), F.lit(0.0))

    return field.withColumns({"slope_x": slope(_line(keys, "grid_y", "grid_x")), "slope_y": slope(_line(keys, "grid_x", "grid_y"))})


def transport_step(field: DataFrame, keys: Sequence[str], step: float, seconds: float, limited: bool = True) -> DataFrame:
    """One upwind step with diffusion over dense fields (value, wind_u, wind_v, diffusivity): value after it.

    At the edges there is outflow, but neither inflow nor diffusion.
    """
    field = limited_slope(field, keys) if limited else field.withColumns({"slope_x": F.lit(0.0), "slope_y": F.lit(0.0)})

    def fluxes(w, wind: str, slope: str) -> tuple[Column, Column]:
        after = lambda c: F.lead(c).over(w)
        face = (F.col(wind) + after(wind)) / 2.0
        left, right = F.col("value") + 0.5 * F.col(slope), after("value") - 0.5 * after(slope)
        spread = (F.col("diffusivity") + after("diffusivity")) / 2.0 * (after("value") - F.col("value")) / step
        out = face * F.when(face >= 0, left).otherwise(right) - spread
        return F.coalesce(out, F.greatest(F.col(wind), F.lit(0.0)) * F.col("value")), F.least(F.col(wind), F.lit(0.0)) * F.col("value")

    total = None
    named = field
    for axis, w, wind in (("x", _line(keys, "grid_y", "grid_x"), "wind_u"), ("y", _line(keys, "grid_x", "grid_y"), "wind_v")):
        upper, edge = fluxes(w, wind, f"slope_{axis}")
        named = named.withColumn(f"__up_{axis}", upper)
        named = named.withColumn(f"__low_{axis}", F.coalesce(F.lag(f"__up_{axis}").over(w), edge))
        entered = F.col(f"__up_{axis}") if total is None else total + F.col(f"__up_{axis}")
        total = entered - F.col(f"__low_{axis}")
    return named.select(*keys, "grid_x", "grid_y", (F.col("value") - seconds / step * total).alias("value"))


def cell_geometry(cells: DataFrame, step: float, lat0: Column, lon0: Column) -> DataFrame:
    """Adds latitude, longitude and the four sides of cells at x, y."""
    from zephyrframe.functions.expressions import unproject

    x, y = F.col("x"), F.col("y")
    lat, lon = unproject(x, y, lat0, lon0)
    south, west = unproject(x - step / 2.0, y - step / 2.0, lat0, lon0)
    north, east = unproject(x + step / 2.0, y + step / 2.0, lat0, lon0)
    return cells.withColumns({"latitude": lat, "longitude": lon, "south": south, "west": west, "north": north, "east": east})


def analysis_keep(value: Column, confidence: Column, before: Column, backward: Column, covered: Column, settings: Settings = DEFAULTS) -> Column:
    """Cells of an analysis that are kept: known, trusted enough, and covered by the prior or gained by stations."""
    floor = F.lit(settings.min_confidence)
    gained = covered | (confidence - before >= floor) | (backward >= floor)
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (confidence >= floor) & gained, F.lit(False))


def forecast_keep(value: Column, confidence: Column, carried: Column, has_anchors: Column, settings: Settings = DEFAULTS) -> Column:
    """Cells of a forecast that are kept: gained by stations, or carried there and, with anchors, not negligible."""
    floor = F.lit(settings.min_confidence)
    there = (carried >= floor) & ((value >= settings.min_concentration) | ~has_anchors)
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (confidence >= floor) & ((confidence - carried >= floor) | there), F.lit(False))


def bound_envelope(value: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Bounds widened to hold the value; missing ones stay missing."""
    return F.when(lower.isNotNull(), F.least(lower, value)), F.when(upper.isNotNull(), F.greatest(upper, value))


def frame_summary(cells: DataFrame, keys: Sequence[str] = ("substance_code", "hour_start", "data_kind")) -> DataFrame:
    """One row for each frame: size, extent, range, stations and mean wind."""
    sums = cells.groupBy(*keys).agg(
        F.count("*").alias("cell_count"),
        F.min("south").alias("south"),
        F.min("west").alias("west"),
        F.max("north").alias("north"),
        F.max("east").alias("east"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.max("source_station_count").cast("int").alias("source_station_count"),
        F.avg("wind_u").alias("__u"),
        F.avg("wind_v").alias("__v"),
    )
    speed = F.hypot("__u", "__v")
    direction = F.when(speed > 0, F.pmod(F.degrees(F.atan2("__u", "__v")) + 540.0, F.lit(360.0)))
    return sums.withColumns({"wind_speed": speed, "wind_direction": direction}).drop("__u", "__v")
