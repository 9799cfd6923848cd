"""Gridded fields: dense cubes as frames, quantisation, selection and trilinear sampling.

A cube is ``cells(i, j, k, value)``, null where nothing is known, or ``frames(i, values)`` with each frame's cells in row
order. Sampling turns a range join into two equi-joins on computed frame numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.functions.geo import wrapped_offset
from tidalgrid.plans.axes import Axes

FILL = 65535
#: Cells along the side of a tile that points are joined with.
SIDE = 32


def dense(cells: DataFrame, axes: Axes) -> DataFrame:
    """All cells of the grid; those that ``cells(i, j, k, value)`` lacks are null."""
    spark = cells.sparkSession
    size = axes.nlat * axes.nlon
    grid = spark.range(axes.nt * size).select(
        F.floor(F.col("id") / size).cast("int").alias("i"),
        F.floor(F.pmod("id", F.lit(size)) / axes.nlon).cast("int").alias("j"),
        F.pmod("id", F.lit(axes.nlon)).cast("int").alias("k"),
    )
    typed = cells.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("k").cast("int"), "value")
    return grid.join(typed, ["i", "j", "k"], "left")


def frames(cells: DataFrame, axes: Axes) -> DataFrame:
    """i, values (row-major array) of a dense cube; a frame is bounded by the grid's size."""
    cell = (F.col("j") * axes.nlon + F.col("k")).alias("cell")
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct(cell, "value"))), lambda x: x["value"]).alias("values"))


def located(points: DataFrame, axes: Axes) -> DataFrame:
    """Adds corner indices and weights to points(id, t, lat, lon) that the grid covers; others are left out."""
    t = (F.col("t") - axes.t0) / F.lit(float(axes.dt))
    y = (F.col("lat") - axes.lat0) / axes.dlat
    x = wrapped_offset(F.col("lon"), F.lit(axes.lon0)) / axes.dlon  # on any grid, so -5 and 355 are one place
    inside = (F.col("ti") >= 0) & (F.col("ti") <= axes.nt - 1) & (F.col("yi") >= 0) & (F.col("yi") <= axes.nlat - 1) & (F.col("xi") >= 0)
    inside &= F.lit(True) if axes.wrap else F.col("xi") <= axes.nlon - 1
    known = ~(F.isnan(F.col("lat").cast("double")) | F.isnan(F.col("lon").cast("double")))
    at = points.where(known).select("id", t.alias("ti"), y.alias("yi"), x.alias("xi")).where(inside)
    low = lambda c, n: F.least(F.floor(c), F.lit(n - 1)).cast("int")
    at = at.select("id", "ti", "yi", "xi", low("ti", axes.nt).alias("i0"), low("yi", axes.nlat).alias("j0"), low("xi", axes.nlon).alias("k0"))
    high = lambda c, n: F.least(F.col(c) + 1, F.lit(n - 1))
    k1 = F.pmod(F.col("k0") + 1, F.lit(axes.nlon)) if axes.wrap else high("k0", axes.nlon)
    return at.select(
        "id", "i0", "j0", "k0", high("i0", axes.nt).alias("i1"), high("j0", axes.nlat).alias("j1"), k1.alias("k1"),
        (F.col("ti") - F.col("i0")).alias("ft"), (F.col("yi") - F.col("j0")).alias("fy"), (F.col("xi") - F.col("k0")).alias("fx"),
    )


def tiles(cube: DataFrame, axes: Axes, side: int = SIDE) -> DataFrame:
    """i, bj, bk, width, values of frames(i, values): squares of ``side`` cells, and the next row and column beside them.

    A point's corners are in one tile, so a row that meets a point holds a few kilobytes however large the grid is.
    """
    rows, cols = -(-axes.nlat // side), -(-axes.nlon // side)
    at = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("b")
    cut = cube.select("i", "values", at).select("i", "values", F.floor(F.col("b") / cols).cast("int").alias("bj"), F.pmod("b", F.lit(cols)).cast("int").alias("bk"))
    first, inner = F.col("bk") * side, F.least(F.lit(side + 1), axes.nlon - F.col("bk") * side)
    seam = F.when((first + side >= axes.nlon) & F.lit(axes.wrap), 1).otherwise(0)
    line = lambda j: F.concat(F.slice("values", j * axes.nlon + first + 1, inner), F.slice("values", j * axes.nlon + 1, seam))
    lines = F.transform(F.sequence(F.col("bj") * side, F.least(F.col("bj") * side + side, F.lit(axes.nlat - 1))), line)
    return cut.select("i", "bj", "bk", (inner + seam).alias("width"), F.flatten(lines).alias("values"))


def sample(points: DataFrame, cube: DataFrame, axes: Axes, side: int = SIDE) -> DataFrame:
    """id, value: trilinear blend at points(id, t, lat, lon); misses and points next to a hole are left out.

    ``cube``: frames. Tiles of a frame and the next are joined once, and points meet that pair by one equi-join on
    frame and tile, so only frames that points need are met and a busy frame is spread over its tiles.
    """
    cut = tiles(cube, axes, side)
    after = cut.select((F.col("i") - 1).alias("i"), "bj", "bk", F.col("values").alias("b"))
    pair = cut.join(after, ["i", "bj", "bk"], "left").select(F.col("i").alias("i0"), "bj", "bk", "width", F.col("values").alias("a"), "b")
    at = located(points, axes).withColumns({"bj": F.floor(F.col("j0") / side).cast("int"), "bk": F.floor(F.col("k0") / side).cast("int")})
    both = at.join(pair, ["i0", "bj", "bk"])
    row = lambda j: F.col(j) - F.col("bj") * side
    left = F.col("k0") - F.col("bk") * side
    right = left + 1 if axes.wrap else F.col("k1") - F.col("bk") * side

    def plane(values: Column) -> Column:
        corner = lambda j, k: F.element_at(values, row(j) * F.col("width") + k + 1)
        line = lambda j: corner(j, left) * (1 - F.col("fx")) + corner(j, right) * F.col("fx")
        return line("j0") * (1 - F.col("fy")) + line("j1") * F.col("fy")

    last = (F.col("i1") == F.col("i0")) | F.col("b").isNull()  # no frame follows
    value = plane(F.col("a")) * (1 - F.col("ft")) + F.when(last, plane(F.col("a"))).otherwise(plane(F.col("b"))) * F.col("ft")
    return both.select("id", value.alias("value")).where(F.col("value").isNotNull())


def sample_vector(points: DataFrame, u: DataFrame, v: DataFrame, axes: Axes) -> DataFrame:
    """id, speed, heading: components are sampled and then joined; a miss in either is a miss."""
    both = sample(points, u, axes).withColumnRenamed("value", "u").join(sample(points, v, axes).withColumnRenamed("value", "v"), "id")
    return both.select("id", F.hypot("u", "v").alias("speed"), F.pmod(F.degrees(F.atan2("u", "v")), F.lit(360.0)).alias("heading"))


def quantise(cells: DataFrame) -> DataFrame:
    """cells with raw (0..65534, 65535 for holes), scale and offset; the range is one partial aggregate, sent to all."""
    known = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    span = cells.agg(F.min(known).alias("lo"), F.max(known).alias("hi")).select(
        F.coalesce("lo", F.lit(0.0)).alias("offset"), (F.greatest(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1e-12)) / 65534).alias("scale")
    )
    part = F.rint((known.cast("float") - F.col("offset").cast("float")).cast("float") / F.col("scale").cast("float"))
    raw = F.when(known.isNull(), FILL).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(65534.0)).cast("int"))
    return cells.crossJoin(F.broadcast(span)).withColumn("raw", raw)  # one row on the right


def dequantise(cells: DataFrame) -> DataFrame:
    """i, j, k, value of cells with raw, scale and offset."""
    value = (F.col("raw") * F.col("scale") + F.col("offset")).cast("float").cast("double")  # as a sampler returns it
    return cells.select("i", "j", "k", F.when(F.col("raw") != FILL, value).alias("value"))


def to_rate(cells: DataFrame, step: int) -> DataFrame:
    """An accumulated field per second."""
    return cells.withColumn("value", F.col("value") / step)


def midpoint(t: Column, step: int) -> Column:
    """The middle of the window that ends at t; halves go to even."""
    return t - F.bround(F.lit(step / 2)).cast("long")


def select_frames(times: DataFrame, lo: int, hi: int, stride: int = 1) -> DataFrame:
    """The lo-th to hi-th distinct t, every ``stride``-th of them, as (i, t); one row a frame, so one small sort."""
    ranked = times.select("t").distinct().select((F.row_number().over(Window.orderBy("t")) - 1).alias("i"), "t")
    return ranked.where((F.col("i") >= lo) & (F.col("i") < hi) & (F.pmod(F.col("i") - lo, F.lit(stride)) == 0))


def thin(cells: DataFrame, n: int, axes: Axes | None = None) -> DataFrame:
    """Every n-th point in both directions, renumbered; with ``axes``, fewer than two left is an error."""
    if axes is not None and min(-(-axes.nlat // n), -(-axes.nlon // n)) < 2:
        raise ValueError(f"every {n}th point leaves fewer than two")
    kept = cells.where((F.pmod("j", F.lit(n)) == 0) & (F.pmod("k", F.lit(n)) == 0))
    return kept.withColumns({"j": F.floor(F.col("j") / n).cast("int"), "k": F.floor(F.col("k") / n).cast("int")})


def crop(cells: DataFrame, axes: Axes, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells in a box that may cross any seam, with lat and lon (west + offset), and their row and eastward column there.

    A box without a point of the grid is an error.
    """
    width = (east - west) % 360.0 or 360.0
    offsets = [(axes.lon0 + k * axes.dlon - west) % 360.0 for k in range(axes.nlon)]
    inside = sorted((o, k) for k, o in enumerate(offsets) if o <= width)
    lats = [j for j in range(axes.nlat) if south <= axes.lat0 + j * axes.dlat <= north]
    if not inside or not lats:
        raise ValueError("the box holds no point of the grid")
    places = F.create_map(*[F.lit(x) for n, (_, k) in enumerate(inside) for x in (k, n)])  # a row of the grid at most
    lat, lon = axes.lat0 + F.col("j") * axes.dlat, axes.lon0 + F.col("k") * axes.dlon
    out = cells.withColumns({"lat": lat, "offset": wrapped_offset(lon, F.lit(west))})
    out = out.where((F.col("offset") <= width) & F.col("lat").between(south, north)).withColumn("lon", F.col("offset") + west)
    return out.withColumns({"row": (F.col("j") - lats[0]).cast("int"), "col": F.element_at(places, F.col("k").cast("int"))}).drop("offset")


def gaps(times: DataFrame) -> DataFrame:
    """t, d of distinct t: d is the difference to the t before. Each of 64 stretches of the axis is sorted by itself."""
    bounds = times.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    wide = max(1.0, ((bounds["hi"] or 0) - (bounds["lo"] or 0)) / 64)
    dealt = times.select("t", F.floor((F.col("t") - (bounds["lo"] or 0)) / wide).alias("b"))
    ends = dealt.groupBy("b").agg(F.max("t").alias("end"))
    before = ends.select("b", F.max("end").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # 65 rows
    own = F.lag("t").over(Window.partitionBy("b").orderBy("t"))
    return dealt.join(before, "b").select("t", (F.col("t") - F.coalesce(own, "before")).alias("d"))


def uniform_step(times: DataFrame, tolerance: float = 0) -> DataFrame:
    """n, step, uniform of a table of distinct t."""
    return gaps(times).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("step"), (F.max("d") - F.min("d") <= tolerance).alias("uniform"))


def require_uniform(times: DataFrame, what: str, tolerance: float = 0) -> float:
    """The step of an axis; an axis of fewer than two points or of uneven steps is an error."""
    got = uniform_step(times, tolerance).first()
    if not got["uniform"] or got["step"] is None:
        raise ValueError(f"{what} isn't evenly spaced")
    return got["step"]


def union_along_time(rows: DataFrame) -> DataFrame:
    """Rows (source, t, value) whose t is later than all of earlier sources; sources go by first t, then name."""
    ends = rows.groupBy("source").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    before = F.max("t1").over(Window.orderBy("t0", "source").rowsBetween(Window.unboundedPreceding, -1))  # one row a source
    limits = ends.select("source", before.alias("after"))
    return rows.join(limits, "source").where(F.col("after").isNull() | (F.col("t") > F.col("after"))).drop("after")


def skipped_sources(rows: DataFrame) -> DataFrame:
    """source: those that a union along time takes nothing from, as earlier ones reach as far."""
    return rows.select("source").distinct().join(union_along_time(rows).select("source").distinct(), "source", "left_anti")


def uneven_sources(rows: DataFrame) -> DataFrame:
    """source, shortest, longest: sources whose own times aren't evenly spaced; they can't be joined as they are."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("source").orderBy("t"))
    steps = rows.select("source", "t").distinct().select("source", gap.alias("d")).groupBy("source")
    return steps.agg(F.min("d").alias("shortest"), F.max("d").alias("longest")).where("shortest <> longest")


def nearest_time(queries: DataFrame, times: DataFrame, buckets: int = 64) -> DataFrame:
    """id, t, at: the nearest of ``times``(t) to each query(id, t); of two equally near, the earlier.

    Both are dealt into stretches of time and merged by a sort within each; what lies beyond a stretch's ends comes
    from one row a stretch.
    """
    bounds = times.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    low = bounds["lo"] or 0
    wide = max(1, -(-((bounds["hi"] or 0) - low + 1) // buckets))
    bucket = F.least(F.greatest(F.floor((F.col("t") - low) / wide), F.lit(0)), F.lit(buckets - 1)).alias("b")
    steps = times.select("t", bucket).distinct()
    ends = queries.sparkSession.range(buckets).select(F.col("id").alias("b")).join(steps.groupBy("b").agg(F.min("t").alias("first"), F.max("t").alias("last")), "b", "left")
    order = Window.orderBy("b")  # a row a stretch
    ends = ends.select("b", "first", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("past"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    order = Window.partitionBy("b").orderBy("t")
    held = steps.join(ends.select("b", "next"), "b").select("b", "t", F.struct(F.col("t").alias("x"), F.coalesce(F.lead("t").over(order), "next").alias("y")).alias("step"))
    both = held.select("b", "t", F.lit(None).cast(queries.schema["id"].dataType).alias("id"), F.lit(False).alias("asked"), "step").unionByName(queries.select(bucket, "t", "id", F.lit(True).alias("asked"), F.lit(None).cast(held.schema["step"].dataType).alias("step")))
    merge = Window.partitionBy("b").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)  # a frame that also ran ahead would be read anew for each row
    found = both.select("b", "t", "id", "asked", F.last("step", True).over(merge).alias("step")).where("asked").join(ends, "b")
    found = found.select("id", "t", F.coalesce("step.x", "past").alias("x"), F.when(F.col("step").isNull(), F.coalesce("first", "next")).otherwise(F.col("step.y")).alias("y"))
    earlier = F.col("y").isNull() | (F.col("t") - F.col("x") <= F.col("y") - F.col("t"))
    return found.select("id", "t", F.when(F.col("x").isNotNull() & earlier, F.col("x")).otherwise(F.col("y")).alias("at")).where("at is not null")
