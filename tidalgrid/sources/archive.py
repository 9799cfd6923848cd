"""Field archives written by many tasks, looked up by part, and the small writers and caches around them."""

from __future__ import annotations

import io
import os
import zipfile
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.operators import fields
from tidalgrid.plans.axes import Axes, chunk_plan, part_name
from tidalgrid.sources.npz import AXES, axes_of, read_frames


def npy_image(array: np.ndarray) -> bytes:
    """An array as an npy file; the header's version follows its length."""
    held = io.BytesIO()
    np.lib.format.write_array(held, np.asanyarray(array), version=None, allow_pickle=False)
    return held.getvalue()


class NpzWriter:
    """Gathers arrays and writes them on close, all or nothing; without any, an empty archive."""

    def __init__(self, path: str, level: int = 1):
        self.path, self.level, self.images, self.open = path, level, {}, True

    def add(self, name: str, array: np.ndarray) -> None:
        if not self.open:
            raise ValueError("the archive is closed")
        if not name or name in self.images:
            raise ValueError(f"an empty or repeated name: {name!r}")
        self.images[name] = npy_image(array)

    def add_scalar(self, name: str, value: float | int) -> None:
        self.add(name, np.array(value))

    def close(self) -> None:
        if self.open:
            kind = zipfile.ZIP_DEFLATED if self.level else zipfile.ZIP_STORED
            with zipfile.ZipFile(f"{self.path}.{os.getpid()}.tmp", "w", kind, compresslevel=self.level or None) as z:
                for name, image in self.images.items():
                    z.writestr(f"{name}.npy", image)
            os.replace(f"{self.path}.{os.getpid()}.tmp", self.path)
            self.open = False

    def __enter__(self) -> NpzWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


class Recorder:
    """Columns of one sample a step, and scalars that are set anew; durations are kept as whole seconds."""

    def __init__(self) -> None:
        self.columns, self.scalars = {}, {}

    @staticmethod
    def _plain(value):
        return int(value.total_seconds()) if hasattr(value, "total_seconds") else value

    def record(self, **samples) -> None:
        for name, value in samples.items():
            self.columns.setdefault(name, []).append(self._plain(value))

    def set_scalar(self, name: str, value) -> None:
        self.scalars[name] = self._plain(value)

    def save(self, path: str) -> None:
        with NpzWriter(path) as out:
            for name, values in (self.columns | self.scalars).items():
                out.add(name, np.array(values))

    def clear(self) -> None:
        self.columns, self.scalars = {}, {}


class FrameCache:
    """Least recently used frames up to a number of bytes; a frame beyond all of them isn't kept."""

    def __init__(self, most_bytes: int = 256 << 20):
        self.most, self.used, self.held = most_bytes, 0, OrderedDict()

    def get(self, key, load: Callable[[], np.ndarray]) -> np.ndarray:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        frame = load()
        if frame.nbytes <= self.most:
            self.held[key] = frame
            self.used += frame.nbytes
            while self.used > self.most:
                self.used -= self.held.popitem(last=False)[1].nbytes
        return frame


class PartCache:
    """So many parts at once, the one loaded first making room; a part that fails to load leaves the others as they are."""

    def __init__(self, load: Callable[[str], object], limit: int = 2):
        if limit < 1:
            raise ValueError("a field needs one part in memory")
        self.load, self.limit, self.held = load, limit, OrderedDict()

    def get(self, path: str):
        if path not in self.held:
            made = self.load(path)
            if len(self.held) >= self.limit:
                self.held.popitem(last=False)
            self.held[path] = made
        return self.held[path]


def field_range(frames: DataFrame, divide_by: float | None = None) -> tuple[float, float]:
    """Scale and offset that put the finite values of frames(i, values) into 0..65534; none at all is an error."""
    known = F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    span = frames.select(F.array_min(known).alias("lo"), F.array_max(known).alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("the field holds no value")
    lo, hi = (x / (divide_by or 1.0) for x in (float(np.float32(span["lo"])), float(np.float32(span["hi"]))))
    return max(hi - lo, 1e-12) / 65534, lo


def member_arrays(axes: Axes, payload: np.ndarray, scale: float, offset: float, fill: int, part: int, spans: list[tuple[int, int]], t0: int) -> dict[str, np.ndarray]:
    """The members of one part of a field: its axes, its packing, and where it and all other parts lie in time."""
    floats, whole = np.float64, np.int64
    out: dict[str, np.ndarray] = {"version": np.int32(1), "t0": whole(t0), "dt": whole(axes.dt), "nt": whole(len(payload))}
    out |= {n: (whole if n[0] == "n" else floats)(getattr(axes, n)) for n in AXES[3:]}
    out |= {"lon_wrap": np.int32(axes.wrap), "scale": floats(scale), "offset": floats(offset), "fill": whole(fill)}
    starts = np.array([axes.t0 + lo * axes.dt for lo, _ in spans], whole)
    counts = np.array([hi - lo for lo, hi in spans], whole)
    out |= {"part": np.int32(part), "nparts": np.int32(len(spans)), "part_t0": starts, "part_nt": counts, "overlap": np.int32(len(spans) > 1 and counts[0] > 1)}
    line = lambda a, d, n: a + d * np.arange(n)
    return out | {"data": payload, "time": line(t0, axes.dt, len(payload)), "lat": line(axes.lat0, axes.dlat, axes.nlat), "lon": line(axes.lon0, axes.dlon, axes.nlon)}


def write_parts(frames: DataFrame, axes: Axes, folder: str, stem: str, limit: int = 512 << 20, divide_by: float | None = None, packed: bool = True, level: int = 1) -> DataFrame:
    """path, part, t0, nt, bytes of the archives made of frames(i, values), whose missing frames are holes.

    Parts follow the chunk plan, so neighbours share a frame; each is one task's work and at most ``limit`` bytes, and
    is renamed when it is whole, so a lost task leaves nothing behind. ``folder`` must be one that all executors share.
    """
    spans = chunk_plan(axes.nt, axes.nlat * axes.nlon * (2 if packed else 4), limit)
    scale, offset = field_range(frames, divide_by) if packed else (1.0, 0.0)
    os.makedirs(folder, exist_ok=True)
    places = frames.sparkSession.createDataFrame([(p, lo, hi) for p, (lo, hi) in enumerate(spans)], "part int, lo long, hi long")
    every = places.select("part", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        lo, hi = spans[part]
        payload = np.full((hi - lo, axes.nlat * axes.nlon), 65535 if packed else np.nan, np.uint16 if packed else np.float32)
        for i, values in zip(rows["i"], rows["values"]):
            if values is None:
                continue
            cube = np.array(values, np.float32)
            if divide_by:
                cube = cube / np.float32(divide_by)
            if packed:
                known = np.isfinite(cube)
                raw = np.clip(np.rint((np.where(known, cube, 0) - np.float32(offset)) / np.float32(scale)), 0, 65534)
                payload[i - lo] = np.where(known, raw, 65535).astype(np.uint16)
            else:
                payload[i - lo] = cube
        path, t0 = f"{folder}/{part_name(stem, part, len(spans), '.npz')}", axes.t0 + lo * axes.dt
        with NpzWriter(path, level) as out:
            for name, array in member_arrays(axes, payload.reshape(-1, axes.nlat, axes.nlon), scale, offset, 65535 if packed else -1, part, spans, t0).items():
                out.add(name, array)
        return pd.DataFrame([(path, part, t0, hi - lo, os.path.getsize(path))], columns=["path", "part", "t0", "nt", "bytes"])

    joined = every.join(frames.select(F.col("i").cast("long").alias("i"), "values"), "i", "left")
    return joined.groupBy("part").applyInPandas(one, "path string, part int, t0 long, nt long, bytes long")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """path, part, t0, end and the other axes of the archives at a path, by start; only the small members are inflated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"]):
                a = axes_of(data)
                rows.append((name, a.t0, a.t0 + (a.nt - 1) * a.dt, a.nt, a.dt, a.lat0, a.dlat, a.nlat, a.lon0, a.dlon, a.nlon))
            yield pd.DataFrame(rows, columns=["path", "t0", "end", "nt", "dt", "lat0", "dlat", "nlat", "lon0", "dlon", "nlon"])

    schema = "path string, t0 long, end long, nt long, dt long, lat0 double, dlat double, nlat long, lon0 double, dlon double, nlon long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def load_parts(spark: SparkSession, path: str) -> tuple[list, Axes]:
    """The parts by start (one row an archive), and their common grid; grids that differ, or no part, are errors."""
    found = sorted(parts(spark, path).collect(), key=lambda r: (r["t0"], r["path"]))
    if not found:
        raise ValueError(f"{path} holds no parts")
    first, grid = found[0], lambda r: [r[c] for c in ("dt", "lat0", "dlat", "nlat", "lon0", "dlon", "nlon")]
    if odd := next((r for r in found if grid(r) != grid(first)), None):
        raise ValueError(f"{odd['path']} isn't on the grid of the other parts")
    return found, Axes(first["t0"], first["dt"], max(r["nt"] for r in found), first["lat0"], first["dlat"], first["nlat"], first["lon0"], first["dlon"], first["nlon"])


def point_part(points: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """Points(id, t, ...) with the number and start of the first part, by start, whose span holds t; others are left out.

    table(number, t0, end): an equi-join on stretches of ``width`` seconds, at least a part's span, so a part is in two.
    """
    stretch = lambda t: F.floor(F.col(t) / width)
    spans = table.withColumn("s", F.explode(F.sequence(stretch("t0"), stretch("end"))))
    met = points.withColumn("s", stretch("t")).join(spans, "s").where("t >= t0 and t <= end")
    best = met.groupBy("id").agg(F.min(F.struct("t0", "number")).alias("p"))
    return points.join(best, "id").select(*points.columns, F.col("p.number").alias("number"), F.col("p.t0").alias("t0"))


def sample_archive(points: DataFrame, path: str) -> DataFrame:
    """id, value of the field in the archives at a path, at points(id, t, lat, lon); gaps between parts are misses."""
    spark = points.sparkSession
    found, axes = load_parts(spark, path)
    room = axes.nt + 1  # parts one after another on one axis, a frame apart
    table = spark.createDataFrame([(n, r["path"], r["t0"], r["end"]) for n, r in enumerate(found)], "number long, path string, t0 long, end long")
    at = point_part(points, table, max(r["end"] - r["t0"] for r in found) + 1)
    moved = at.select("id", (F.col("t") - F.col("t0") + F.col("number") * room * axes.dt).alias("t"), "lat", "lon")
    frames = read_frames(spark, path).join(table.select("path", "number"), "path")
    whole = Axes(0, axes.dt, max(2, room * len(found)), axes.lat0, axes.dlat, axes.nlat, axes.lon0, axes.dlon, axes.nlon)
    return fields.sample(moved, frames.select((F.col("number") * room + F.col("i")).cast("int").alias("i"), "values"), whole)
