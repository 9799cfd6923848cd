"""What viewers and reports ask of fields, tracks and runs: limits, inventories, pairings and positions in time.

All of it is grouping, equi-joins and sorts within a key; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.functions import geo
from tidalgrid.operators.tracks import value_at


def finite(x: str) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))


def limits(cells: DataFrame, by: list[str], diverging: bool = False, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """by, lo, hi: colour limits of value; symmetric if diverging, a unit wide if flat, and 0 to 1 without a finite value."""
    got = cells.withColumn("value", finite("value")).groupBy(*by).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("p"))
    lo, hi = F.element_at("p", 1), F.element_at("p", 2)
    if diverging:
        top = F.greatest(F.abs(lo), F.abs(hi))
        lo, hi = -top, top
    got = got.select(*by, lo.alias("lo"), hi.alias("hi"))
    return got.select(*by, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.when(F.col("lo").isNull(), 1.0).when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")).alias("hi"))


def cap(cells: DataFrame, by: list[str], share: float = 0.98) -> DataFrame:
    """by, cap: the percentile at which a colour scale ends."""
    return cells.withColumn("value", finite("value")).groupBy(*by).agg(F.percentile("value", share).alias("cap"))


def inventory(frames: DataFrame, field: str) -> DataFrame:
    """field, frames, cells, first, last of frames(field, cell, t)."""
    return frames.groupBy(field).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("cell").alias("cells"), F.min("t").alias("first"), F.max("t").alias("last"))


def axis_report(times: DataFrame, by: str) -> DataFrame:
    """by, n, first, last, step (median), shortest, longest gap of the distinct t of each group."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(by).orderBy("t"))
    rows = times.select(by, "t").distinct().select(by, "t", gap.alias("d"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.percentile("d", 0.5).alias("step"), F.min("d").alias("shortest"), F.max("d").alias("longest"))


def by_grid(fields: DataFrame) -> DataFrame:
    """ny, nx, south, north, west, east (rounded to 4), members: fields(field, ...) that lie on one grid, sorted."""
    box = [F.round(c, 4).alias(c) for c in ("south", "north", "west", "east")]
    return fields.select("field", "ny", "nx", *box).groupBy("ny", "nx", "south", "north", "west", "east").agg(F.sort_array(F.collect_set("field")).alias("members"))


def incompatible(files: DataFrame, keys: list[str]) -> DataFrame:
    """path, differs: files whose value of any key isn't that of the first path, and which keys those are."""
    first = files.agg(F.min_by(F.struct(*keys), "path").alias("want"))
    both = files.crossJoin(F.broadcast(first))  # one row
    bad = F.filter(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"want.{k}")), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    return both.select("path", bad.alias("differs")).where(F.size("differs") > 0)


def require_compatible(files: DataFrame, keys: list[str]) -> None:
    if bad := incompatible(files, keys).orderBy("path").first():
        raise ValueError(f"{bad['path']} differs in {', '.join(bad['differs'])}")


def wind_speeds(frames: DataFrame) -> DataFrame:
    """field, t, j, k, value: ws* of every u* that has a v*, by an equi-join on the rest of the name, the time and the cell."""
    part = lambda letter: frames.where(F.col("field").startswith(letter)).select(F.expr("substring(field, 2)").alias("rest"), "t", "j", "k", F.col("value").alias(letter))
    both = part("u").join(part("v"), ["rest", "t", "j", "k"])
    return both.select(F.concat(F.lit("ws"), "rest").alias("field"), "t", "j", "k", F.hypot("u", "v").alias("value"))


def accumulation_seconds(fields: DataFrame, times: DataFrame) -> DataFrame:
    """field, seconds: the field's own step if positive, else the median gap of its times if positive, else null."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("field").orderBy("t"))
    median = times.select("field", gap.alias("d")).groupBy("field").agg(F.percentile("d", 0.5).alias("d"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    return fields.select("field", "step").join(median, "field", "left").select("field", F.coalesce(positive("step"), positive("d")).alias("seconds"))


def position_at(queries: DataFrame, track: DataFrame) -> DataFrame:
    """id, lat, lng of a track(run, t, lat, lng) at queries(id, run, t): between unit vectors, so across any seam."""
    out = None
    for n, axis in enumerate("xyz"):
        xyz = geo.to_xyz(F.col("lat"), F.col("lng"))[n]
        got = value_at(queries, track.select("run", "t", xyz.alias("value"))).withColumnRenamed("value", axis)
        out = got if out is None else out.join(got, "id")
    lat, lng = geo.from_xyz(F.col("x"), F.col("y"), F.col("z"))
    return out.select("id", lat.alias("lat"), lng.alias("lng"))


def frame_at(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """id, cell, value at queries(id, t): each cell's values between the two frames around t; beyond the ends the end two hold.

    cells(cell, t, value) have one set of times. The bracket of a query is found on the times alone.
    """
    times = cells.select("t").distinct()
    order = Window.orderBy("t")  # a row a frame
    steps = times.select("t", F.lead("t").over(order).alias("next"))
    pairs = steps.where("next is not null")
    both = pairs.select(F.lit(0).alias("run"), "t", F.col("next").cast("double").alias("value"))
    asked = queries.select("id", F.lit(0).alias("run"), "t")
    merged = both.select("t", "value", F.lit(None).cast("long").alias("id")).unionByName(asked.select("t", F.lit(None).cast("double").alias("value"), "id"))
    merge = Window.orderBy("t", F.col("id").isNotNull())
    held = merged.select("id", "t", F.last(F.when(F.col("id").isNull(), F.struct("t", "value")), True).over(merge).alias("a"))
    ends = pairs.agg(F.min(F.struct("t", F.col("next").cast("double").alias("value"))).alias("first"))
    found = held.where("id is not null").crossJoin(F.broadcast(ends)).select("id", "t", F.coalesce("a", "first").alias("a"))  # one row
    found = found.select("id", "t", F.col("a.t").alias("t0"), F.col("a.value").cast("long").alias("t1"))
    share = F.least(F.greatest((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")), F.lit(0.0)), F.lit(1.0))
    one, two = (cells.select("cell", F.col("t").alias(f"t{n}"), F.col("value").alias(f"v{n}")) for n in (0, 1))
    return found.withColumn("f", share).join(one, "t0").join(two, ["cell", "t1"]).select("id", "cell", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("f")).alias("value"))


def great_circle_points(legs: DataFrame, n: int = 64) -> DataFrame:
    """id, k, lat, lng: n points along the great circle of legs(id, lat1, lng1, lat2, lng2); the two ends if they meet."""
    a, b = geo.to_xyz(F.col("lat1"), F.col("lng1")), geo.to_xyz(F.col("lat2"), F.col("lng2"))
    ends = legs.select("id", "lat1", "lng1", "lat2", "lng2", F.array(*a).alias("a"), F.array(*b).alias("b"))  # once a leg, not once a point
    dot = sum(F.col("a")[i] * F.col("b")[i] for i in range(3))
    ends = ends.withColumn("arc", F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
    near, f = F.col("arc") < 1e-9, F.col("k") / F.lit(float(n - 1))
    rows = ends.withColumn("k", F.explode(F.when(near, F.array(F.lit(0), F.lit(n - 1))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    rows = rows.withColumns({"wa": F.sin((1 - f) * F.col("arc")), "wb": F.sin(f * F.col("arc")), "sine": F.sin("arc")})
    # multiplied before it is divided: between opposite places, where all is rounding, that is the order of the SQL
    rows = rows.withColumn("at", F.when(~near, F.array(*[F.col("a")[i] * F.col("wa") / F.col("sine") + F.col("b")[i] * F.col("wb") / F.col("sine") for i in range(3)])))
    lat, lng = geo.from_xyz(*[F.col("at")[i] for i in range(3)])
    pick = lambda c, x: F.when(near, F.when(F.col("k") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))).otherwise(x).alias(c)
    return rows.select("id", "k", pick("lat", lat), pick("lng", lng))


def require_track(track: DataFrame) -> DataFrame:
    """The track itself; one without lat, lng or time is an error."""
    if lacking := [c for c in ("lat", "lng", "time") if c not in track.columns]:
        raise ValueError(f"the track has no {', '.join(lacking)}")
    return track


def select_channels(track: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The channels in the order asked for, or all but the place and time, and those that the track lacks."""
    known = [c for c in track.columns if c not in ("run", "lat", "lng", "time")]
    asked = known if names is None else names
    return track.select(*[c for c in asked if c in known]), [c for c in asked if c not in known]


def channel_sets(channels: DataFrame) -> DataFrame:
    """channel, place, runs, everywhere of channels(run, pos, channel): in order of first appearance (run, then place)."""
    total = channels.agg(F.count_distinct("run").alias("total"))
    got = channels.groupBy("channel").agg(F.min(F.struct("run", "pos")).alias("at"), F.count_distinct("run").alias("runs"))
    place = F.row_number().over(Window.orderBy("at")) - 1  # a row a channel
    return got.crossJoin(F.broadcast(total)).select("channel", place.alias("place"), "runs", (F.col("runs") == F.col("total")).alias("everywhere"))  # one row on the right


def closest_so_far(track: DataFrame) -> DataFrame:
    """run, step, nearest: the least distance up to each step of track(run, step, km)."""
    return track.select("run", "step", F.min("km").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("nearest"))


def track_report(track: DataFrame, hug: float) -> DataFrame:
    """run, points, hours, in_band, skipped of track(run, hours, shore, asked): shares in percent of all points."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return track.groupBy("run").agg(F.count(F.lit(1)).alias("points"), (F.max("hours") - F.min("hours")).alias("hours"), share(F.col("shore") <= hug).alias("in_band"), share(~F.col("asked")).alias("skipped"))


def first_runs(runs: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The runs that a chart shows, by place, and those that it leaves out: a report's limit, not a sample."""
    ranked = runs.select("run", "pos").distinct().orderBy("pos", "run")
    shown = ranked.limit(most)
    return shown, ranked.join(shown, ["run", "pos"], "left_anti")


def expand_sweeps(runs: DataFrame) -> DataFrame:
    """name, start_time and step of each run of a sweep, for runs(name, start_time, count, every): every is a duration.

    Names get the step's number, as wide as the last one's; a single run keeps its name. Counts below one, several
    runs without a positive spacing, and names used twice stop the query.
    """
    every = geo.seconds_of(F.col("every"))
    good = (F.col("count") >= 1) & ((F.col("count") == 1) | (every > 0))
    checked = runs.withColumn("seconds", F.when(good, F.coalesce(every, F.lit(0))).otherwise(F.raise_error(F.concat(F.col("name"), F.lit(": a sweep needs a count and a positive spacing"))).cast("long")))
    out = checked.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
    number = F.lpad(F.col("step").cast("string"), F.length((F.col("count") - 1).cast("string")), F.lit("0"))
    name = F.when(F.col("count") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), number))
    return out.select(name.alias("name"), (F.col("start_time") + F.col("seconds") * F.col("step")).alias("start_time"), "step")


def duplicate_names(runs: DataFrame) -> DataFrame:
    """name, n: names used more than once."""
    return runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """id and the candidate(id, pos, score, ...) of the largest score; of equals the first."""
    rest = [c for c in candidates.columns if c != "id"]
    return candidates.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("pos"))).alias("x")).select("id", "x.*")


def first_legal(candidates: DataFrame) -> DataFrame:
    """id and the first legal candidate(id, pos, legal, ...) in the fixed order; ids without one are left out."""
    rest = [c for c in candidates.columns if c != "id"]
    return candidates.where("legal").groupBy("id").agg(F.min_by(F.struct(*rest), "pos").alias("x")).select("id", "x.*")
