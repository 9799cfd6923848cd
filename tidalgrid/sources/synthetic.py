"""Weather in closed form: smooth in space and steady in time, so any part of it can be made anywhere and checked."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Amplitudes, wave numbers and periods of the five fields, and the grids of the presets
# (north, south, west, east, degrees, steps, hours a step).
PRESETS = {
    "small": (60.0, 50.0, -5.0, 10.0, 0.5, 4, 6),
    "medium": (62.0, 48.0, -12.0, 10.0, 0.25, 56, 3),
    "large": (65.0, 35.0, -20.0, 20.0, 0.25, 720, 1),
    "xlarge": (90.0, -90.0, -180.0, 179.75, 0.25, 56, 3),
}


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weather(lat: Column, lon: Column, step: Column, hour: Column) -> dict[str, Column]:
    """The fields at a place, for a step number and the hour of the day."""
    y, x = F.radians(lat), F.radians(lon)
    return {
        "10u": 8 * F.sin(x * 3 + step / 8.0) * F.cos(y * 2),
        "10v": 6 * F.cos(y * 3 - step / 11.0),
        "ssrd": clipped(F.sin((hour + lon / 15.0 - 6) / 12 * math.pi), 0.0, 1.0) * 3.6e6 * clipped(F.cos(y), 0.1, 1.0),
        "tcc": clipped(0.5 + 0.45 * F.sin(x * 2 + y * 2 + step / 6.0), 0.0, 1.0),
        "2t": 300 - 0.5 * (lat - 35) + 4 * F.sin((hour - 3) / 24 * 2 * math.pi),
    }


def cube(spark: SparkSession, preset: str, start: int) -> DataFrame:
    """field, t, j, k, lat, lon, value of a preset from ``start`` seconds on, rows southward; made by all tasks at once."""
    north, south, west, east, res, steps, hours = PRESETS[preset]
    ny, nx = round((north - south) / res) + 1, round((east - west) / res) + 1
    at = spark.range(steps * ny * nx).select(F.floor(F.col("id") / (ny * nx)).alias("i"), F.pmod(F.floor(F.col("id") / nx), F.lit(ny)).cast("int").alias("j"), F.pmod("id", F.lit(nx)).cast("int").alias("k"))
    at = at.withColumns({"t": F.lit(start) + F.col("i") * (hours * 3600), "lat": north - F.col("j") * res, "lon": west + F.col("k") * res})
    made = weather(F.col("lat"), F.col("lon"), F.col("i"), F.pmod(F.floor(F.col("t") / 3600), F.lit(24)))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.cast("double").alias("value")) for n, v in made.items()])).alias("x")
    return at.select("t", "j", "k", "lat", "lon", pairs).select("x.field", "t", "j", "k", "lat", "lon", "x.value")
