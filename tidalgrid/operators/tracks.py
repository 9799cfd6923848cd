"""Tracks: legs, distance run, interpolation in time and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.functions.geo import great_circle_km


def legs(track: DataFrame) -> DataFrame:
    """run, step, leg_km, run_km for track(run, step, lat, lng): a sort within each run."""
    order = Window.partitionBy("run").orderBy("step")
    leg = F.coalesce(great_circle_km(F.lag("lat").over(order), F.lag("lng").over(order), F.col("lat"), F.col("lng")), F.lit(0.0))
    return track.select("run", "step", leg.alias("leg_km")).withColumn("run_km", F.sum("leg_km").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def value_at(queries: DataFrame, series: DataFrame) -> DataFrame:
    """id, value of a channel series(run, t, value) at queries(id, run, t): linear between neighbours, held at the ends.

    Queries and samples are merged by time within a run, so there is no range join.
    """
    both = series.select("run", "t", "value", F.lit(None).cast("long").alias("id")).unionByName(queries.select("run", "t", F.lit(None).cast("double").alias("value"), "id"))
    order = Window.partitionBy("run").orderBy("t", F.col("id").isNotNull())
    point = F.when(F.col("id").isNull(), F.struct("t", "value"))
    before = F.last(point, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = both.select("id", "t", before.alias("a"), after.alias("b")).where("id is not null and (a is not null or b is not null)")
    share = F.when(F.col("b.t") > F.col("a.t"), (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0)
    value = F.col("a.value") + share * (F.col("b.value") - F.col("a.value"))
    return found.select("id", F.coalesce(value, "a.value", "b.value").alias("value"))


def summary(track: DataFrame, channels: list[str]) -> DataFrame:
    aggs = [f(F.col(c)).alias(f"{n}_{c}") for c in channels for n, f in (("min", F.min), ("max", F.max))]
    return track.groupBy("run").agg(F.count(F.lit(1)).alias("points"), *aggs)
