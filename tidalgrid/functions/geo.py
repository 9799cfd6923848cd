"""Geodesy, field and unit functions: each takes and returns columns, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius (fixed value), in kilometres.
RADIUS_KM = 6371.0088


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on the mean sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Where a great circle of a length and first bearing ends; longitude in [-180, 180)."""
    a, c, d = F.radians(lat), F.radians(bearing), km / RADIUS_KM
    sine = F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(c)
    shift = F.atan2(F.sin(c) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * sine)
    return F.degrees(F.asin(sine)), F.pmod(lon + F.degrees(shift) + 540.0, F.lit(360.0)) - 180.0


def wrapped_offset(lon: Column, lon0: Column) -> Column:
    """Eastward offset from lon0 in [0, 360)."""
    return F.pmod(lon - lon0, F.lit(360.0))


def add_flows(v1: Column, h1: Column, v2: Column, h2: Column) -> tuple[Column, Column]:
    """Speed and heading of two flows together; components are added, never angles."""
    east = v1 * F.sin(F.radians(h1)) + v2 * F.sin(F.radians(h2))
    north = v1 * F.cos(F.radians(h1)) + v2 * F.cos(F.radians(h2))
    return F.hypot(east, north), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def solar_fraction(hours: Column, lon: Column) -> Column:
    """Share of full sun at hours since midnight at longitude 0."""
    return F.greatest(F.lit(0.0), F.sin(2 * 3.141592653589793 * ((hours - lon / 15) / 24 - 0.25)))


def seconds_of(text: Column) -> Column:
    """Whole seconds of a duration like 1.5h, 2d, 30m, 45s or 90; null if it is none."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([dhms]?)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([dhms]?)\s*$", 2)
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(number != "", F.round(F.expr("1D") * F.when(number != "", number).cast("double") * factor).cast("long"))


def plain_units(units: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(units)), r"\s+", " ")


#: Units of fields accumulated over a step (fixed values).
ACCUMULATED = ["j m**-2", "j/m2", "j m-2", "j m^-2"]


def is_accumulated(units: Column, cell_methods: Column) -> Column:
    return F.coalesce(F.lower(cell_methods).rlike(r"time\s*:\s*(sum|total)"), F.lit(False)) | F.coalesce(plain_units(units).isin(ACCUMULATED), F.lit(False))


def power_policy(stored_wh: Column) -> tuple[Column, Column]:
    """Motor and avionics watts by stored energy."""
    motor = F.when(stored_wh <= 600, 0.0).otherwise(500.0)
    other = F.when(stored_wh <= 0, 0.0).when(stored_wh <= 600, 25.0).otherwise(100.0)
    return motor, other


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres, in the form with two arguments of the arc tangent."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2000 * RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def to_xyz(lat: Column, lng: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lng)
    return radius * F.cos(a) * F.cos(b), radius * F.cos(a) * F.sin(b), radius * F.sin(a)


def from_xyz(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a direction of any length; one of no length counts as the pole, as 0 / 0 does in SQL."""
    long = F.sqrt(x * x + y * y + z * z)
    sine = F.when(long == 0, F.lit(1.0)).otherwise(z / long)
    return F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0)))), F.degrees(F.atan2(y, x))


def crabbing_speed(speed: Column, along: Column, across: Column) -> Column:
    """Speed over ground along a wanted course in a current; null where the current across it can't be stemmed."""
    return F.when(F.abs(across) <= speed, along + F.sqrt(speed * speed - across * across))
