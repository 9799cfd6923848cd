"""Metadata of fields and files: stamps, units, packing, names and sizes, as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidalgrid.functions.geo import plain_units


def valid_time(date: Column, clock: Column) -> Column:
    """Epoch seconds of a validity date YYYYMMDD and time HHMM, both integers; null if there is no such moment."""
    day = F.make_date(F.floor(date / 10000).cast("int"), (F.floor(date / 100) % 100).cast("int"), (date % 100).cast("int"))
    return F.unix_date(day).cast("long") * 86400 + F.floor(clock / 100) * 3600 + clock % 100 * 60


def field_key(cf_name: Column, short_name: Column, level_type: Column, level: Column) -> Column:
    """The CF name, or the short name where that is empty or unknown, with the level unless it is the ground or a plain one."""
    known = F.when((F.trim(cf_name) != "") & (F.lower(cf_name) != "unknown"), cf_name)
    plain = level_type.isin("surface", "meanSea", "entireAtmosphere") | level.isin(0, 1)
    return F.concat(F.coalesce(known, short_name), F.when(F.coalesce(plain, F.lit(True)), "").otherwise(F.concat(F.lit("_"), level_type, level.cast("string"))))


def first_messages(messages):
    """One message of each field and valid time, the first by offset; grid and attributes are those of the field's first.

    messages(field, t, offset, grid): what a header scan of frames gives.
    """
    first = messages.groupBy("field").agg(F.min_by("grid", "offset").alias("grid"))
    return messages.groupBy("field", "t").agg(F.min("offset").alias("offset")).join(first, "field")


def unpacked(raw: Column, fill: Column, missing: Column, scale: Column, offset: Column) -> Column:
    """raw * scale + offset in single precision; null where the raw value is one of the sentinels. NaN is no sentinel."""
    hole = lambda s: F.coalesce((raw == s) & ~F.isnan(s.cast("double")), F.lit(False))
    value = (raw.cast("float") * F.coalesce(scale, F.lit(1.0)).cast("float")).cast("float") + F.coalesce(offset, F.lit(0.0)).cast("float")
    return F.when(raw.isNull() | hole(fill) | hole(missing), F.lit(None)).otherwise(value.cast("float"))


#: Calendars whose dates are those of the civil one (fixed values).
REAL_CALENDARS = ["standard", "gregorian", "proleptic_gregorian"]
#: How `<unit> since <reference>` names units (fixed values).
UNITS = {"seconds": 1, "second": 1, "secs": 1, "sec": 1, "s": 1, "minutes": 60, "minute": 60, "mins": 60, "min": 60, "hours": 3600, "hour": 3600, "hrs": 3600, "hr": 3600, "h": 3600, "days": 86400, "day": 86400, "d": 86400}
SINCE = r"^\s*([A-Za-z]+)\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?\s*(Z|UTC|[+-]\d{1,2}:?\d{2})?\s*$"


def decoded_time(value: Column, units: Column, calendar: Column) -> Column:
    """Epoch seconds of a value in `<unit> since <reference>`, to the nearest second, halves to even.

    Null for a unit longer than a day, a reference that is no date, or a calendar that isn't the civil one. An offset
    from UTC that the reference names is taken off.
    """
    part = lambda n: F.regexp_extract(units, SINCE, n)
    number = lambda n: F.when(part(n) != "", part(n).cast("int")).otherwise(0)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(part(1)))
    date = F.concat_ws("-", part(2), F.lpad(part(3), 2, "0"), F.lpad(part(4), 2, "0"))
    day = F.unix_date(F.try_to_date(F.when(part(2) != "", date)))
    zone = F.lpad(F.regexp_replace(part(8), "[+:-]", ""), 4, "0")
    hours, sign = F.substring(zone, 1, 2).cast("int") * 60 + F.substring(zone, 3, 2).cast("int"), F.when(part(8).startswith("-"), -1).otherwise(1)
    minutes = F.when(part(8).rlike(r"^[+-]"), hours * sign).otherwise(0)
    start = day.cast("long") * 86400 + number(5) * 3600 + number(6) * 60 + number(7) - minutes * 60
    return F.when(F.coalesce(F.lower(calendar), F.lit("standard")).isin(REAL_CALENDARS), start + F.rint(value * factor).cast("long"))


def stamp(t: Column) -> Column:
    """Epoch seconds as a UTC stamp to the minute."""
    day, rest = F.floor(t / 86400).cast("int"), F.pmod(t, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit("Z"))


def displayed(value: Column, units: Column, seconds: Column) -> tuple[Column, Column]:
    """Value and unit as shown: K in °C, Pa in hPa, J per square metre in watts where the accumulation time is known."""
    u = plain_units(units)
    joules = u.isin("j m**-2", "j/m2", "j m-2", "j m^-2") & (seconds > 0)
    shown = F.when(u == "k", value - 273.15).when(u == "pa", value / 100).when(joules, value / seconds).otherwise(value)
    return shown, F.when(u == "k", "°C").when(u == "pa", "hPa").when(joules, "W m⁻²").otherwise(units)


#: Names of fields whose scale is centred on zero (fixed pattern).
DIVERGING = r"(^|_)[uv]\d|wind|anomal|tendency|vort|diverg"


def scale_class(key: Column, long_name: Column, units: Column) -> Column:
    """How a field is coloured: diverging, temperature, share, radiation, pressure or plain, the first that fits."""
    text, u = F.lower(F.concat_ws(" ", key, long_name)), plain_units(units)
    speed = text.rlike(r"(^|\s)ws|speed")
    return (
        F.when(text.rlike(DIVERGING) & ~speed, "diverging").when(u.isin("k", "°c", "degc"), "temperature").when(u.isin("(0 - 1)", "1", "%"), "share")
        .when(u.rlike(r"^(j|w)( m|/m)"), "radiation").when(u.isin("pa", "hpa"), "pressure").otherwise("plain")
    )


def coord_tag(dim: Column, hours: Column, value: Column) -> Column:
    """The dimension's name and its value: whole hours of a duration, else a number without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(text, r"\.$", "")
    return F.concat(dim, F.coalesce(F.concat(hours.cast("long").cast("string"), F.lit("h")), F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(plain)))


def field_bytes(ny: Column, nx: Column, nt: Column, itemsize: Column) -> Column:
    return ny.cast("long") * nx * nt * itemsize


def human(size: Column) -> Column:
    """Bytes with a unit of 1024: whole below a kilobyte, else one decimal, halves to even."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for n, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**n, F.concat(F.format_string("%.1f", F.rint(size / 1024.0**n * 10) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def cell_size_km(dlat: Column, dlon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Height and width of a grid cell; the width shrinks with the latitude, to 2 % at most."""
    return F.abs(dlat) * 111.32, F.abs(dlon) * 111.32 * F.greatest(F.cos(F.radians(mean_lat)), F.lit(0.02))


def scale_bar_km(width_km: Column) -> Column:
    """The length of 1, 2, 5 or 10 times a power of ten that is nearest to a quarter of the width; of equals the shorter."""
    quarter = width_km / 4
    ten = F.pow(F.lit(10.0), F.floor(F.log10(quarter)))
    ladder = F.transform(F.array(*[F.lit(float(x)) for x in (1, 2, 5, 10)]), lambda x: F.struct(F.abs(x * ten - quarter).alias("d"), (x * ten).alias("v")))
    return F.array_min(ladder)["v"]


def channel_spec(spec: Column) -> tuple[Column, Column]:
    """Name and mode of `name[:unit|normalized]`; another suffix belongs to the name."""
    mode = F.regexp_extract(spec, r"^(.*):(unit|normalized)$", 2)
    return F.when(mode != "", F.regexp_extract(spec, r"^(.*):(unit|normalized)$", 1)).otherwise(spec), F.when(mode != "", mode)


def shape_text(shape: Column) -> Column:
    """An array's shape as Python writes it: (), (n,) or (a, b)."""
    return F.when(F.size(shape) == 1, F.concat(F.lit("("), F.element_at(shape, 1).cast("string"), F.lit(",)"))).otherwise(F.concat(F.lit("("), F.array_join(shape, ", "), F.lit(")")))


def index_key(path: Column, size: Column, modified_ns: Column) -> Column:
    """What a cached index of a file is kept under: it changes whenever the file does."""
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), modified_ns.cast("string")).cast("binary")), 1, 16)
