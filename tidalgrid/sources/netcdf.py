"""NetCDF classic files (CDF-1 and CDF-2): fields with time, latitude and longitude, read frame by frame.

Files of the HDF5 form are refused by name, as no reader for them is at hand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Types of the format (fixed values), and names of dimensions that are time, latitude and longitude.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
TIME, LAT, LON = {"time", "valid_time", "t"}, {"lat", "latitude", "y"}, {"lon", "longitude", "x"}
SUFFIXES = (".nc", ".nc4", ".netcdf", ".cdf")
FIELDS = "path string, field string, units string, nt long, nlat long, nlon long, time_units string, calendar string, fill double, missing double, scale double, offset double"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def collect_paths(given: list[str]) -> list[str]:
    """Files as given, and those of folders by name; a file named twice comes once. A missing or empty place is an error."""
    out: list[str] = []
    for place in given:
        store, inner = store_of(place)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{place} doesn't exist")
        found = [inner] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.path.endswith(SUFFIXES))
        if not found:
            raise ValueError(f"{place} holds no files")
        out += found
    return list(dict.fromkeys(out))


class Classic:
    """The header of a file; variables are read on demand, one record at a time."""

    def __init__(self, path: str):
        store, inner = store_of(path)
        self.file, self.at = store.open_input_file(inner), 4
        magic = bytes(self.file.read_at(4, 0))
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path}: only the classic format is known" + " (this is HDF5)" * (magic == b"\x89HDF"))
        self.wide = magic[3] == 2
        self.records = self._int()
        self.dims = self._list(lambda: (self._name(), self._int()))
        self.attributes = dict(self._list(self._attribute))
        self.variables = dict(self._list(self._variable))
        per = [v["size"] for v in self.variables.values() if v["record"]]
        self.stride = sum(per)
        if len(per) == 1:  # a lone record variable isn't padded
            only = next(v for v in self.variables.values() if v["record"])
            self.stride = int(np.prod(only["shape"][1:], dtype=np.int64)) * np.dtype(KINDS[only["kind"]]).itemsize

    def _read(self, n: int) -> bytes:
        data = bytes(self.file.read_at(n, self.at))
        self.at += n
        return data

    def _int(self, size: int = 4) -> int:
        return int.from_bytes(self._read(size), "big")

    def _name(self) -> str:
        n = self._int()
        return self._read(n + -n % 4)[:n].decode()

    def _list(self, one) -> list:
        self._int()  # which kind of list
        return [one() for _ in range(self._int())]

    def _attribute(self) -> tuple:
        name, kind, n = self._name(), self._int(), self._int()
        size = n * np.dtype(KINDS[kind]).itemsize
        data = self._read(size + -size % 4)[:size]
        return name, data.decode().rstrip("\0") if kind == 2 else np.frombuffer(data, KINDS[kind])

    def _variable(self) -> tuple:
        name, order = self._name(), [self._int() for _ in range(self._int())]
        dims = [self.dims[d] for d in order]
        attributes, kind, size, begin = dict(self._list(self._attribute)), self._int(), self._int(), self._int(8 if self.wide else 4)
        record = bool(dims) and dims[0][1] == 0
        shape = [self.records if n == 0 else n for _, n in dims]
        return name, {"dims": [d for d, _ in dims], "shape": shape, "attributes": attributes, "kind": kind, "size": size, "begin": begin, "record": record}

    def get(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        """Entries [first, first + n) along the first dimension."""
        v = self.variables[name]
        kind = np.dtype(KINDS[v["kind"]])
        count = (v["shape"][0] if v["shape"] else 1) - first if n is None else n
        inner = int(np.prod(v["shape"][1:], dtype=np.int64)) * kind.itemsize
        step = self.stride if v["record"] else inner
        if v["record"]:
            data = b"".join(bytes(self.file.read_at(inner, v["begin"] + (first + i) * step)) for i in range(count))
        else:
            data = bytes(self.file.read_at(count * inner, v["begin"] + first * step))
        return np.frombuffer(data, kind).reshape([count, *v["shape"][1:]] if v["shape"] else [])

    def field_names(self) -> list[str]:
        """Variables of three dimensions or more that have time, latitude and longitude among them."""
        has = lambda dims, names: any(d.lower() in names for d in dims)
        return [n for n, v in self.variables.items() if len(v["dims"]) >= 3 and all(has(v["dims"], s) for s in (TIME, LAT, LON))]

    def axis(self, dims: list[str], names: set[str]) -> str:
        return next(d for d in dims if d.lower() in names)


def fields(spark: SparkSession, given: list[str]) -> DataFrame:
    """One row for each field of each file: its shape, units and packing, as columns for the expressions that decode them."""
    names = [c.split()[0] for c in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                c, rows = Classic(path), []
                for name in c.field_names():
                    v = c.variables[name]
                    a, size = v["attributes"], dict(zip(v["dims"], v["shape"]))
                    time = c.variables.get(c.axis(v["dims"], TIME), {"attributes": {}})["attributes"]
                    number = lambda key, a=a: float(a[key][0]) if key in a else None
                    rows.append((path, name, a.get("units", ""), *(size[c.axis(v["dims"], s)] for s in (TIME, LAT, LON)), time.get("units"), time.get("calendar"), number("_FillValue"), number("missing_value"), number("scale_factor"), number("add_offset")))
                yield pd.DataFrame(rows, columns=names)

    paths = collect_paths(given)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(run, FIELDS)


def frames(chosen: DataFrame, at: dict[str, int] | None = None) -> DataFrame:
    """path, field, i, stamp (raw time), lats, lons, raw of rows of ``fields``: a frame a row, of plain numbers as stored.

    Dimensions beyond three are read at the index that ``at`` names, else at 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Classic(r["path"])
                v = c.variables[r["field"]]
                axes = [c.axis(v["dims"], s) for s in (TIME, LAT, LON)]
                stamps, lats, lons = (c.get(a).astype(float) for a in axes)
                first = v["dims"][0] == axes[0]
                cube = None if first else c.get(r["field"])
                for i in range(len(stamps)):
                    part, dims = (c.get(r["field"], i, 1)[0], v["dims"][1:]) if first else (cube.take(i, v["dims"].index(axes[0])), [d for d in v["dims"] if d != axes[0]])
                    for dim in [d for d in dims if d not in axes]:
                        part, dims = part.take((at or {}).get(dim, 0), dims.index(dim)), [d for d in dims if d != dim]
                    flat = (part if dims == axes[1:] else part.T).astype(float).ravel()
                    lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (lats, lons, flat)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["field"]]), pa.array([i], pa.int64()), pa.array([stamps[i]]), *lists], names=["path", "field", "i", "stamp", "lats", "lons", "raw"])

    schema = "path string, field string, i long, stamp double, lats array<double>, lons array<double>, raw array<double>"
    return chosen.select("path", "field").mapInArrow(run, schema)
