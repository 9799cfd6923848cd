"""GRIB edition 1 on regular grids: an index of headers, frames read by offset, and subsets copied as they are.

The index hops from message to message and reads headers only. Frames are then rows that any task reads at its own
offset, so a selection on the index (time, field, block of frames) is all that is ever read. Files are opened through
Arrow's file systems, so they may lie in any store that all executors reach.
"""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.plans.axes import Axes
from tidalgrid.sources.netcdf import store_of

#: Short names and units of parameters of table 128 (fixed values); others are named by their number.
NAMES = {164: ("tcc", "(0 - 1)"), 165: ("10u", "m s**-1"), 166: ("10v", "m s**-1"), 167: ("2t", "K"), 169: ("ssrd", "J m**-2")}
#: Seconds of the units of forecast time (fixed values).
UNITS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200}
#: Level types that don't enter a field's name: surface, mean sea, entire atmosphere (fixed values).
PLAIN = {1, 102, 200}
INDEX = "path string, offset long, length long, field string, units string, t long, ni int, nj int, north double, west double, south double, east double, scan int"


def _signed(data: bytes) -> int:
    value = int.from_bytes(data, "big")
    top = 1 << (8 * len(data) - 1)
    return -(value - top) if value & top else value


def _magnitude(value: int, size: int) -> bytes:
    return ((1 << (8 * size - 1)) | -value if value < 0 else value).to_bytes(size, "big")


def header(head: bytes) -> dict:
    """What the first two sections of a message tell; ``head`` begins with them."""
    p = head[8:]
    year = (p[24] - 1) * 100 + p[12]
    ahead = p[18] if p[20] in (0, 10) else p[19] if p[20] in (2, 3, 4, 5) else 0
    t = calendar.timegm((year, p[13], p[14], p[15], p[16], 0)) + ahead * UNITS.get(p[17], 3600)
    name, units = NAMES.get(p[8], (f"p{p[8]}", ""))
    level = int.from_bytes(p[10:12], "big")
    if p[9] not in PLAIN and level not in (0, 1):
        name = f"{name}_{p[9]}_{level}"
    size = int.from_bytes(p[:3], "big")
    if not p[7] & 0x80:
        raise ValueError("a message without a grid")
    g = p[size:]
    if g[5] != 0:
        raise ValueError("only regular latitude/longitude grids are known")
    milli = lambda a, b: _signed(g[a:b]) / 1000
    return {
        "field": name, "units": units, "t": t, "ni": int.from_bytes(g[6:8], "big"), "nj": int.from_bytes(g[8:10], "big"),
        "north": milli(10, 13), "west": milli(13, 16), "south": milli(17, 20), "east": milli(20, 23), "scan": g[27],
    }


def values(message: bytes) -> np.ndarray:
    """The values of a message, row by row, missing ones NaN, as single precision."""
    p = message[8:]
    size, flags, decimal = int.from_bytes(p[:3], "big"), p[7], _signed(p[26:28])
    grid = p[size:]
    n = int.from_bytes(grid[6:8], "big") * int.from_bytes(grid[8:10], "big")
    rest, known = grid[int.from_bytes(grid[:3], "big") :], None
    if flags & 0x40:
        length = int.from_bytes(rest[:3], "big")
        known = np.unpackbits(np.frombuffer(rest[6:length], np.uint8))[:n].astype(bool)
        rest = rest[length:]
    length, bits = int.from_bytes(rest[:3], "big"), rest[10]
    word = int.from_bytes(rest[6:10], "big")  # the reference is a float of base 16
    base = (-1.0) ** (word >> 31) * ((word & 0xFFFFFF) / 2**24) * 16.0 ** (((word >> 24) & 0x7F) - 64)
    count = n if known is None else int(known.sum())
    if bits == 0:
        raw = np.zeros(count)
    else:
        packed = np.unpackbits(np.frombuffer(rest[11:length], np.uint8))[: count * bits].reshape(count, bits)
        raw = packed @ (2.0 ** np.arange(bits - 1, -1, -1))
    found = (base + raw * 2.0 ** _signed(rest[4:6])) / 10.0**decimal
    if known is not None:
        out = np.full(n, np.nan)
        out[known] = found
        found = out
    return found.astype(np.float32)


def encode(field: str, t: int, cube: np.ndarray, north: float, west: float, step: tuple[float, float], bits: int = 16) -> bytes:
    """A message of a frame (rows southward); NaN is left out by a bit map."""
    number = next((k for k, (name, _) in NAMES.items() if name == field), None)
    if number is None:
        raise ValueError(f"no parameter {field}")
    when, (nj, ni) = calendar.datetime.datetime.fromtimestamp(t, calendar.datetime.timezone.utc), cube.shape
    flat = cube.ravel().astype(float)
    known = np.isfinite(flat)
    holes = not known.all()
    pds = bytearray(28)
    pds[:3], pds[3], pds[4], pds[7], pds[8], pds[9] = (28).to_bytes(3, "big"), 128, 98, 0x80 | 0x40 * holes, number, 1
    pds[12:18] = bytes([(when.year - 1) % 100 + 1, when.month, when.day, when.hour, when.minute, 1])
    pds[24] = (when.year - 1) // 100 + 1
    milli = lambda v: _magnitude(round(v * 1000), 3)
    gds = (32).to_bytes(3, "big") + bytes([0, 255, 0]) + ni.to_bytes(2, "big") + nj.to_bytes(2, "big") + milli(north) + milli(west) + b"\x80"
    gds += milli(north - (nj - 1) * step[0]) + milli(west + (ni - 1) * step[1]) + round(step[1] * 1000).to_bytes(2, "big") + round(step[0] * 1000).to_bytes(2, "big") + bytes(5)
    bms = b""
    if holes:
        bitmap = np.packbits(known).tobytes()
        bitmap += b"\0" * (len(bitmap) % 2)
        bms = (6 + len(bitmap)).to_bytes(3, "big") + bytes([8 * len(bitmap) - len(flat)]) + bytes(2) + bitmap
    found = flat[known]
    low = float(found.min()) if len(found) else 0.0
    power, share = 64, abs(low)
    while share >= 1:
        share, power = share / 16, power + 1
    while 0 < share < 1 / 16:
        share, power = share * 16, power - 1
    fraction = int(share * 2**24) + (low < 0)  # downward, so that no value lies below the reference
    word = ((low < 0) << 31) | (power << 24) | min(fraction, 2**24 - 1)
    base = (-1.0 if low < 0 else 1.0) * min(fraction, 2**24 - 1) / 2**24 * 16.0 ** (power - 64)
    span = float(found.max()) - base if len(found) else 0.0
    exponent = int(np.ceil(np.log2(span / (2**bits - 1)))) if span > 0 else 0
    raw = np.clip(np.rint((found - base) / 2.0**exponent), 0, 2**bits - 1).astype(np.uint64)
    packed = np.packbits(((raw[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()
    packed += b"\0" * ((11 + len(packed)) % 2)
    bds = (11 + len(packed)).to_bytes(3, "big") + bytes([8 * len(packed) - bits * len(raw) & 0x0F]) + _magnitude(exponent, 2) + word.to_bytes(4, "big") + bytes([bits]) + packed
    body = bytes(pds) + gds + bms + bds + b"7777"
    if len(body) + 8 >= 1 << 23:
        raise ValueError("the message is too long for this edition")
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + b"\x01" + body


def scan(path: str) -> Iterator[dict]:
    """The headers of a file's messages; a file without any is an error."""
    store, place = store_of(path)
    with store.open_input_file(place) as file:
        at, size, some = 0, file.size(), False
        while at + 8 <= size:
            head = file.read_at(min(8 + 28 + 512, size - at), at)
            if head[:4] != b"GRIB":
                at += 1 if (k := bytes(head).find(b"GRIB", 1)) < 0 else k
                continue
            if head[7] != 1:
                raise ValueError(f"{path}: only edition 1 is known")
            length = int.from_bytes(head[4:7], "big")
            yield {"path": path, "offset": at, "length": length} | header(bytes(head))
            at, some = at + length, True
    if not some:
        raise ValueError(f"{path} holds no messages")


def index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a message of the files, a task a file; of a field's messages of one time the first, by path and offset."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(list(scan(path)), columns=names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    made = files.mapInPandas(run, INDEX)
    rest = [n for n in names if n not in ("field", "t")]
    return made.groupBy("field", "t").agg(F.min(F.struct("path", "offset", *[n for n in rest if n not in ("path", "offset")])).alias("x")).select("field", "t", "x.*").select(*names)


def index_key(path: str) -> str:
    """What the index of a file is kept under; it changes whenever the file does."""
    store, place = store_of(path)
    info = store.get_file_info(place)
    return hashlib.sha1(f"{place}|{info.size}|{info.mtime_ns}".encode()).hexdigest()[:16]


def cached_index(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The index, read from ``folder`` where it was built before for the files as they are; a broken one is built anew."""
    key = hashlib.sha1("|".join(map(index_key, paths)).encode()).hexdigest()[:16]
    place = f"{folder.rstrip('/')}/{key}"
    try:
        held = spark.read.schema(INDEX).parquet(place)
        held.agg(F.max("offset"), F.max("field")).collect()
        return held
    except Exception:  # noqa: BLE001  missing or broken alike
        index(spark, paths).write.mode("overwrite").parquet(place)
        return spark.read.schema(INDEX).parquet(place)


def axes_of(rows: DataFrame) -> Axes:
    """The grid of an index of one field, rows northward; frames at uneven times or on several grids are an error."""
    grids = rows.select("ni", "nj", "north", "west", "south", "east").distinct().limit(2).collect()
    times = sorted(r["t"] for r in rows.select("t").distinct().toLocalIterator())  # a row a frame
    steps = {b - a for a, b in zip(times, times[1:])}
    if len(grids) != 1 or len(steps) != 1:
        raise ValueError("the field isn't on one grid at even times")
    g = grids[0]
    west = g["west"] if g["west"] <= 180 else g["west"] - 360
    wide = (g["east"] - g["west"]) % 360 / (g["ni"] - 1)
    return Axes(times[0], steps.pop(), len(times), min(g["north"], g["south"]), abs(g["north"] - g["south"]) / (g["nj"] - 1), g["nj"], west, wide, g["ni"])


def read(rows: DataFrame) -> DataFrame:
    """field, t, nj, ni, north, west, values of the messages of an index, rows as they are stored, holes null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                path = r["path"]
                if path not in opened:
                    store, place = store_of(path)
                    opened = {path: store.open_input_file(place)}
                got = values(bytes(opened[path].read_at(r["length"], r["offset"]))).astype(float)
                held = pa.ListArray.from_arrays([0, len(got)], pa.array(got, mask=np.isnan(got)))
                cols = [pa.array([r["field"]]), pa.array([r["t"]], pa.int64()), pa.array([r["nj"]], pa.int32()), pa.array([r["ni"]], pa.int32()), pa.array([r["north"]]), pa.array([r["west"]]), held]
                yield pa.RecordBatch.from_arrays(cols, names=["field", "t", "nj", "ni", "north", "west", "values"])

    schema = "field string, t long, nj int, ni int, north double, west double, values array<double>"
    return rows.select("path", "offset", "length", "field", "t", "nj", "ni", "north", "west").mapInArrow(run, schema)


def frames(rows: DataFrame, axes: Axes) -> DataFrame:
    """i, values of one field's messages with the rows northward, as the samplers and writers take them."""
    got = read(rows).select(F.floor((F.col("t") - axes.t0) / axes.dt).cast("int").alias("i"), "nj", "ni", "values")
    flipped = F.flatten(F.transform(F.sequence(F.col("nj") - 1, F.lit(0), F.lit(-1)), lambda j: F.slice("values", j * F.col("ni") + 1, F.col("ni"))))
    return got.select("i", flipped.alias("values"))


def frame_block(rows: DataFrame, axes: Axes, lo: int = 0, hi: int | None = None) -> DataFrame:
    """The frames [lo, hi) only; nothing else is read."""
    upto = axes.nt if hi is None else hi
    return frames(rows.where((F.col("t") >= axes.t0 + lo * axes.dt) & (F.col("t") < axes.t0 + upto * axes.dt)), axes)


def write_subset(rows: DataFrame, path: str, keep: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> int:
    """Writes the messages whose t is in keep(t) to one file, in order, as they are or cut to (west, south, east, north).

    Tasks read and cut, one writes what they hand on. Messages without a point in the box are left out; none left is
    an error. Returns how many were written.
    """
    kept = rows if keep is None else rows.join(keep.select("t").distinct(), "t", "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                store, place = store_of(r.path)
                with store.open_input_file(place) as file:
                    data = bytes(file.read_at(r.length, r.offset))
                if box is not None:
                    data = cropped(data, box)
                if data is not None:
                    yield pd.DataFrame([(r.path, r.offset, data)], columns=["path", "offset", "data"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, place), n = store_of(path), 0
        with store.open_output_stream(f"{place}.tmp") as out:
            for batch in batches:
                for data in batch["data"]:
                    out.write(data)
                    n += 1
        if n:
            store.move(f"{place}.tmp", place)
        else:
            store.delete_file(f"{place}.tmp")
        yield pd.DataFrame([(n,)], columns=["n"])

    made = kept.select("path", "offset", "length").mapInPandas(cut, "path string, offset long, data binary")
    written = made.repartition(1).sortWithinPartitions("path", "offset").mapInPandas(write, "n long").first()
    if written is None or not written["n"]:
        raise ValueError("nothing to write")
    return written["n"]


def cropped(message: bytes, box: tuple[float, float, float, float]) -> bytes | None:
    """The message cut to a box that may cross any seam, columns eastward from its west; None without a point in it."""
    west, south, east, north = box
    h = header(message)
    dlat, dlon = (h["north"] - h["south"]) / max(1, h["nj"] - 1), (h["east"] - h["west"]) % 360 / max(1, h["ni"] - 1)
    width = (east - west) % 360 or 360.0
    columns = sorted((o, k) for k in range(h["ni"]) if (o := (h["west"] + k * dlon - west) % 360) <= width)
    rows = [j for j in range(h["nj"]) if south <= h["north"] - j * dlat <= north]
    if not columns or not rows:
        return None
    cube = values(message).reshape(h["nj"], h["ni"])[np.ix_(rows, [k for _, k in columns])]
    return encode(h["field"].split("_")[0], h["t"], cube, h["north"] - rows[0] * dlat, west + columns[0][0], (dlat, dlon), 24)
