"""Extension: a stream of positions summed to distance run per voyage and hour, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """run, hour, points, km of stream(ts, run, km)."""
    return stream.withWatermark("ts", late).groupBy("run", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("points"), F.sum("km").alias("km")).select("run", F.col("window.start").alias("hour"), "points", "km")
