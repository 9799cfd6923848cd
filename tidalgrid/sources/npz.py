"""Field cubes in npz archives: members are read one by one, so a listing of axes never inflates the payload."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.plans.axes import Axes

AXES = ("t0", "dt", "nt", "lat0", "dlat", "nlat", "lon0", "dlon", "nlon")
FRAMES = "path string, i long, t long, values array<double>"


def members(data: bytes, keep=lambda name: True) -> dict[str, np.ndarray]:
    """The arrays of an archive that ``keep`` wants."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.endswith(".npy") and keep(name[:-4]):
                out[name[:-4]] = np.load(io.BytesIO(z.read(name)), allow_pickle=False, max_header_size=1 << 20)
    return out


def axes_of(data: bytes) -> Axes:
    got = members(data, lambda n: n in (*AXES, "version"))
    if int(got.get("version", 0)) != 1:
        raise ValueError("only version 1 is known")
    kind = {"lat0": float, "dlat": float, "lon0": float, "dlon": float}
    return Axes(**{a: kind.get(a, int)(got[a]) for a in AXES})


def write_field(path: str, axes: Axes, raw: np.ndarray, scale: float = 1.0, offset: float = 0.0, level: int = 1) -> None:
    """Writes one part: all or nothing, by renaming a finished file."""
    if raw.shape != (axes.nt, axes.nlat, axes.nlon) or raw.dtype not in (np.uint16, np.float32):
        raise ValueError("the payload must be uint16 or float32 and fit the axes")
    arrays = {"version": np.int32(1), "scale": np.float64(scale), "offset": np.float64(offset), "fill": np.uint16(65535), "lon_wrap": np.int32(axes.wrap), "data": raw}
    arrays |= {a: (np.float64 if isinstance(getattr(axes, a), float) else np.int64)(getattr(axes, a)) for a in AXES}
    with zipfile.ZipFile(f"{path}.tmp", "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, array in arrays.items():
            held = io.BytesIO()
            np.lib.format.write_array(held, np.asanyarray(array), version=(1, 0))
            z.writestr(f"{name}.npy", held.getvalue())
    os.replace(f"{path}.tmp", path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, i, t, values of all archives at a path; holes are null. Spark reads the bytes, from any store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                axes, got = axes_of(data), members(data, lambda n: n in ("data", "scale", "offset"))
                for i, frame in enumerate(got["data"]):
                    flat = frame.ravel().astype(float)
                    hole = flat == 65535 if frame.dtype == np.uint16 else np.isnan(flat)
                    if frame.dtype == np.uint16:  # in single precision at the end, as a sampler returns it
                        flat = (flat * float(got["scale"]) + float(got["offset"])).astype(np.float32).astype(float)
                    values = pa.ListArray.from_arrays([0, len(flat)], pa.array(flat, mask=hole))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([axes.t0 + i * axes.dt], pa.int64()), values], names=["path", "i", "t", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FRAMES)


def union_parts(frames: DataFrame) -> DataFrame:
    """Frames of a split field as one: of a shared instant, the part that starts earlier stays."""
    starts = frames.groupBy("path").agg(F.min("t").alias("t0"))
    return frames.join(starts, "path").groupBy("t").agg(F.min_by("values", F.struct("t0", "path")).alias("values"))
