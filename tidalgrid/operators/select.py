"""Selection along axes: windows in time, boxes, contiguous runs, rolls and flips, gaps and runs of sources.

Axes are tables of (index, value), a row a point, so what is decided on them is small however large the field is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.functions.geo import wrapped_offset
from tidalgrid.operators.fields import gaps, select_frames
from tidalgrid.plans.axes import Axes, parse_frames


def time_window(frames: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Frames from start to end, both included, either open; an end before the start, or nothing left, is an error."""
    if start is not None and end is not None and end < start:
        raise ValueError("the window ends before it begins")
    kept = frames
    if start is not None:
        kept = kept.where(F.col("t") >= start)
    if end is not None:
        kept = kept.where(F.col("t") <= end)
    if not kept.limit(1).count():
        raise ValueError("no frames in the window")
    return kept


def pick_times(times: DataFrame, frames: str | None = None, start: int | None = None, end: int | None = None, stride: int = 1) -> DataFrame:
    """i, t by a range of frames or a window of time, not both; every stride-th of what they leave."""
    if frames is not None and (start is not None or end is not None):
        raise ValueError("either frames or a window, not both")
    if frames is not None:
        lo, hi = parse_frames(frames, times.select("t").distinct().count())
        return select_frames(times, lo, hi, stride)
    kept = time_window(times, start, end)
    return select_frames(kept, 0, 2**31 - 1, stride)


def scan_times(times: DataFrame) -> DataFrame:
    """i, t of all distinct times; a table without any is an error."""
    if not times.limit(1).count():
        raise ValueError("no times")
    return select_frames(times, 0, 2**31 - 1)


def keep_times(frames: DataFrame, keep: DataFrame) -> DataFrame:
    """Frames whose t is in keep(t)."""
    return frames.join(keep.select("t").distinct(), "t", "left_semi")


def union_times(frames: DataFrame) -> DataFrame:
    """t: the times that any field has."""
    return frames.select("t").distinct()


def check_box(west: float, south: float, east: float, north: float, plain: bool = False) -> None:
    """Latitudes must rise within the globe; ``plain`` boxes don't cross the seam either."""
    if not -90 <= south < north <= 90:
        raise ValueError("south must be below north, both within 90 degrees")
    if plain and not west < east:
        raise ValueError("west must be less than east")


def label_box(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells with lat and lon between the edges, as they are written: no turn around the globe; nothing left is an error."""
    check_box(west, south, east, north)
    kept = cells.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if not kept.limit(1).count():
        raise ValueError("no field has a point in the box")
    return kept


def is_run(indices: DataFrame) -> DataFrame:
    """first, last, n, contiguous of indices(i)."""
    got = indices.agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count_distinct("i").alias("n"))
    return got.withColumn("contiguous", F.coalesce(F.col("last") - F.col("first") + 1 == F.col("n"), F.lit(False)))


def contiguous_run(indices: DataFrame, what: str) -> tuple[int, int]:
    """[lo, hi) of selected indices that form one run; else an error."""
    got = is_run(indices).first()
    if not got["contiguous"]:
        raise ValueError(f"{what}: the selection isn't one run")
    return got["first"], got["last"] + 1


def lon_window(axis: DataFrame, west: float, east: float) -> DataFrame:
    """i, lon of an axis(i, lon) that lie eastward from west to east, over any seam."""
    width = (east - west) % 360.0 or 360.0
    return axis.where(wrapped_offset(F.col("lon"), F.lit(west)) <= width)


def rolled(axis: DataFrame) -> DataFrame:
    """i, lon, at: longitudes in [-180, 180) and the new index of each, if the axis goes beyond 180 and all the way round.

    Any other axis keeps its values and order.
    """
    span = axis.agg(F.min("lon").alias("lo"), F.max("lon").alias("hi"), F.count(F.lit(1)).alias("n"))
    whole = (F.col("hi") > 180) & (F.col("n") > 1) & ((F.col("hi") - F.col("lo")) * F.col("n") / (F.col("n") - 1) >= 359.9)
    both = axis.crossJoin(F.broadcast(span.select(F.coalesce(whole, F.lit(False)).alias("whole"))))  # one row
    moved = both.select("i", F.when(F.col("whole"), F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).otherwise(F.col("lon")).alias("lon"), "whole")
    order = Window.orderBy(F.when(F.col("whole"), F.col("lon")).otherwise(F.col("i")))  # a row a column of the grid
    return moved.select("i", "lon", (F.row_number().over(order) - 1).alias("at"))


def north_up(cells: DataFrame, nlat: int) -> DataFrame:
    """Cells of a grid whose rows run southward, renumbered to run northward."""
    return cells.withColumn("j", (F.lit(nlat - 1) - F.col("j")).cast("int"))


def axis_step(axis: DataFrame) -> DataFrame:
    """start, step, n, even of axis(i, v): the step between the ends, and whether all points lie on that line.

    They do if none is off by more than eight units in the last place of the largest value, or 1e-9.
    """
    span = axis.agg(F.min_by("v", "i").alias("a"), F.max_by("v", "i").alias("b"), F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("top"))
    both = axis.crossJoin(F.broadcast(span)).withColumn("step", (F.col("b") - F.col("a")) / F.greatest(F.col("n") - 1, F.lit(1)))  # one row
    off = F.max(F.abs(F.col("v") - (F.col("a") + F.col("i") * F.col("step"))))
    got = both.groupBy(F.col("a").alias("start"), "step", "n", "top").agg(off.alias("off"))
    return got.select("start", "step", "n", (F.col("off") <= F.greatest(F.col("top") * 8 * 2.220446049250313e-16, F.lit(1e-9))).alias("even"))


def wraps(n: int, step: float, tolerance: float = 1e-6) -> bool:
    """Whether a longitude axis goes all the way round."""
    return abs(n * step - 360.0) < tolerance


def cropped_axes(axes: Axes, west: float, south: float, east: float, north: float) -> Axes:
    """The axes of a box, its first longitude being west plus the offset of the first column; no overlap is an error."""
    check_box(west, south, east, north)
    width = (east - west) % 360.0 or 360.0
    offsets = sorted(o for o in ((axes.lon0 + k * axes.dlon - west) % 360.0 for k in range(axes.nlon)) if o <= width)
    rows = [axes.lat0 + j * axes.dlat for j in range(axes.nlat) if south <= axes.lat0 + j * axes.dlat <= north]
    if not offsets or not rows:
        raise ValueError("the box holds no point of the grid")
    return Axes(axes.t0, axes.dt, axes.nt, rows[0], axes.dlat, len(rows), west + offsets[0], axes.dlon, len(offsets))


def at_index(cells: DataFrame, at: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """Cells at one index of each further dimension; 0 where none is asked for, negative ones count from the end."""
    if unknown := set(at) - set(sizes):
        raise ValueError(f"no dimension {', '.join(sorted(unknown))}")
    for dim, size in sizes.items():
        index = at.get(dim, 0)
        if not -size <= index < size:
            raise ValueError(f"{dim} has {size} points")
        cells = cells.where(F.col(dim) == index % size).drop(dim)
    return cells


def source_runs(frames: DataFrame) -> DataFrame:
    """source, lo, hi: stretches [lo, hi) of frames(i, source) from one source."""
    changed = F.coalesce((F.col("source") != F.lag("source").over(Window.orderBy("i"))).cast("int"), F.lit(0))  # a row a frame
    number = F.sum("changed").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    runs = frames.withColumn("changed", changed).withColumn("run", number)
    return runs.groupBy("run", "source").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi")).drop("run")


def joined_gaps(frames: DataFrame) -> DataFrame:
    """t, d, source, before: steps of a union of frames(t, source) that differ from its most common one, and the files there."""
    step = gaps(frames.select("t").distinct()).where("d is not null")
    usual = step.groupBy("d").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("usual"))
    odd = step.crossJoin(F.broadcast(usual)).where("d <> usual")  # one row
    here, there = frames.groupBy("t").agg(F.min("source").alias("source")), frames.groupBy("t").agg(F.min("source").alias("before"))
    return odd.join(here, "t").join(there.withColumnRenamed("t", "past"), F.col("past") == F.col("t") - F.col("d")).select("t", "d", "source", "before")


def check_joined(frames: DataFrame) -> None:
    if bad := joined_gaps(frames).orderBy("t").first():
        raise ValueError(f"a step of {bad['d']} between {bad['before']} and {bad['source']}")


def progression(values: Column) -> Column:
    """Whether an array holds an arithmetic progression of at least two numbers."""
    step = F.element_at(values, 2) - F.element_at(values, 1)
    steps = F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b - a)
    return F.when(F.size(values) < 2, F.lit(False)).otherwise(F.forall(steps, lambda d: d == step))
