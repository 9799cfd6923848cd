"""GRIB and NetCDF files made here, read back by offset."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalgrid.functions import meta
from tidalgrid.operators import fields
from tidalgrid.sources import grib, netcdf


def test_one_message_round_trip():
    draw = np.random.default_rng(2)
    for cube in (draw.normal(size=(5, 7)) * 40, np.full((2, 3), 7.25), draw.random((3, 4)) * 3.6e6, -draw.random((4, 4)) - 270):
        for holes in (False, True):
            cube = cube.copy()
            if holes:
                cube[1, 1] = np.nan
            data = grib.encode("2t", 1704067200 + 3600 * 7, cube, 60.0, -5.0, (0.5, 0.25))
            head, got = grib.header(data), grib.values(data).reshape(cube.shape)
            assert (head["field"], head["t"], head["nj"], head["ni"], head["north"], head["west"]) == ("2t", 1704092400, *cube.shape, 60.0, -5.0)
            assert np.array_equal(np.isnan(got), np.isnan(cube))
            span = np.nanmax(cube) - np.nanmin(cube)
            assert np.nanmax(np.abs(got - cube)) <= max(span / 60_000, np.nanmax(np.abs(cube)) * 1e-6)


def make(path, times, west=-5.0, ni=6, names=("10u", "2t"), junk=b""):
    data = junk
    for n, t in enumerate(times):
        for k, name in enumerate(names):
            data += grib.encode(name, t, np.arange(4 * ni, dtype=float).reshape(4, ni) + 100 * k + n, 60.0, west, (1.0, 1.0 if ni < 30 else 10.0))
    path.write_bytes(data)
    return str(path)


def test_index_frames_and_subsets(spark, tmp_path):
    one, two = make(tmp_path / "a.grib", [0, 3600, 7200], junk=b"xx"), make(tmp_path / "b.grib", [7200, 10800])
    rows = grib.index(spark, [one, two])
    assert rows.count() == 8 and rows.where("field = '2t' and t = 7200").first()["path"] == one  # the first file's frame stays
    wind = rows.where("field = '10u'")
    axes = grib.axes_of(wind)
    assert (axes.t0, axes.dt, axes.nt, axes.nlat, axes.nlon, axes.lat0, axes.lon0) == (0, 3600, 4, 4, 6, 57.0, -5.0)
    got = {r["i"]: r["values"] for r in grib.frames(wind, axes).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[0][0] == pytest.approx(18.0, abs=1e-3) and got[1][18] == pytest.approx(1.0, abs=1e-3)
    assert sorted(r["i"] for r in grib.frame_block(wind, axes, 1, 3).collect()) == [1, 2] and grib.frame_block(wind, axes, 2, 2).count() == 0
    point = spark.createDataFrame([(1, 1800, 57.0, 355.0)], "id long, t long, lat double, lon double")
    assert fields.sample(point, grib.frames(wind, axes), axes).first()["value"] == pytest.approx(18.5, abs=1e-3)
    cache = str(tmp_path / "cache")
    held = grib.cached_index(spark, [one, two], cache)
    assert held.count() == 8 and grib.cached_index(spark, [one, two], cache).count() == 8
    keep = spark.createDataFrame([(3600,), (7200,)], "t long")
    out = str(tmp_path / "sub.grib")
    assert grib.write_subset(rows.where("path like '%a.grib'"), out, keep) == 4
    whole = (tmp_path / "a.grib").read_bytes()
    size = len(whole[2:]) // 6
    assert (tmp_path / "sub.grib").read_bytes() == whole[2 + 2 * size :]
    assert grib.write_subset(rows, out, keep, (-4.0, 58.0, -2.0, 59.0)) == 4
    cut = grib.read(grib.index(spark, [out])).where("field = '10u' and t = 3600").first()
    assert (cut["nj"], cut["ni"], cut["north"], cut["west"]) == (2, 3, 59.0, -4.0) and cut["values"] == pytest.approx([8, 9, 10, 14, 15, 16], abs=1e-3)
    for bad in (lambda: grib.write_subset(rows, out, None, (50.0, 58.0, 60.0, 59.0)), lambda: grib.axes_of(wind.where("t <> 3600")), lambda: list(grib.scan(str(tmp_path / "empty")))):
        (tmp_path / "empty").write_bytes(b"")
        with pytest.raises(ValueError):
            bad()


def test_crop_over_the_dateline():
    data = grib.encode("tcc", 0, np.arange(4 * 36, dtype=float).reshape(4, 36), 60.0, 0.0, (1.0, 10.0))
    head = grib.header(grib.cropped(data, (170.0, 58.0, -170.0, 60.0)))
    assert (head["west"], head["ni"], head["nj"]) == (170.0, 3, 3) and list(grib.values(grib.cropped(data, (170.0, 60.0, -170.0, 60.0)))) == [17, 18, 19]
    assert grib.cropped(data, (3.0, 58.0, 4.0, 60.0)) is None


def classic(path, times, records=True, extra=False):
    """A small file of the classic format: time, lat, lon and one packed field."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    att = lambda name, kind, values: text(name) + (struct.pack(">ii", 2, len(values)) + values.encode() + b"\0" * (-len(values) % 4) if kind == 2 else struct.pack(">iid", 6, 1, values))
    atts = lambda *a: (struct.pack(">ii", 12, len(a)) + b"".join(a)) if a else bytes(8)
    nt, nlat, nlon = len(times), 3, 4
    dims = [("time", 0 if records else nt), ("lat", nlat), ("lon", nlon)] + ([("level", 2)] if extra else [])
    pick = [0, 3, 1, 2] if extra else [0, 1, 2]
    cells = nlat * nlon * (2 if extra else 1)
    lat, lon = np.arange(3, dtype=">f8").tobytes(), np.arange(4, dtype=">f8").tobytes()
    raw = (np.arange(nt * cells) % 90).astype(">i2").reshape(nt, -1)
    raw[0, 0] = -999
    head = lambda begin: b"CDF\x01" + struct.pack(">i", nt if records else 0) + struct.pack(">ii", 10, len(dims)) + b"".join(text(n) + struct.pack(">i", s) for n, s in dims) + bytes(8) + struct.pack(">ii", 11, 4) + b"".join(begin)

    def variables(at):
        var = lambda name, ids, a, kind, size, place: text(name) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + a + struct.pack(">iii", kind, size, place)
        room = cells * 2 + -(cells * 2) % 4
        start = at + len(lat) + len(lon)
        return [
            var("lat", [1], atts(), 6, 24, at), var("lon", [2], atts(), 6, 32, at + 24),
            var("time", [0], atts(att("units", 2, "hours since 2024-01-01"), att("calendar", 2, "standard")), 6, 8 if records else 8 * nt, start),
            var("sst", pick, atts(att("units", 2, "K"), att("scale_factor", 6, 0.5), att("add_offset", 6, 270.0), att("_FillValue", 6, -999.0)), 3, room if records else room * nt, start + (8 if records else 8 * nt)),
        ]

    at = len(head(variables(0)))
    data = head(variables(at)) + lat + lon
    if records:
        for t, row in zip(times, raw):
            body = row.tobytes()
            data += struct.pack(">d", t) + body + b"\0" * (-len(body) % 4)
    else:
        data += np.array(times, ">f8").tobytes() + raw.tobytes()
    path.write_bytes(data)
    return raw


@pytest.mark.parametrize("records", [True, False])
@pytest.mark.parametrize("extra", [True, False])
def test_netcdf_fields_and_frames(spark, tmp_path, records, extra):
    raw = classic(tmp_path / "a.nc", [0.0, 6.0, 12.0], records, extra)
    found = netcdf.fields(spark, [str(tmp_path), str(tmp_path / "a.nc")])
    row = found.first()
    assert found.count() == 1 and (row["field"], row["nt"], row["nlat"], row["nlon"], row["scale"], row["fill"]) == ("sst", 3, 3, 4, 0.5, -999.0)
    rows = netcdf.frames(found, {"level": 1} if extra else None).join(found, ["path", "field"])
    value = F.transform("raw", lambda v: meta.unpacked(v, F.col("fill"), F.col("missing"), F.col("scale"), F.col("offset")))
    got = rows.select("i", meta.decoded_time(F.col("stamp"), F.col("time_units"), F.col("calendar")).alias("t"), value.alias("values")).orderBy("i").collect()
    assert [r["t"] for r in got] == [1704067200 + 21600 * k for k in range(3)]
    want = raw[1][12:] if extra else raw[1]
    assert got[1]["values"] == [270.0 + 0.5 * v for v in want] and (got[0]["values"][0] is None) == (not extra)


def test_paths(tmp_path):
    for name in ("b.nc", "a.cdf", "c.txt"):
        (tmp_path / name).write_bytes(b"\x89HDF\r\n")
    got = netcdf.collect_paths([str(tmp_path), str(tmp_path / "b.nc")])
    assert [p.rsplit("/", 1)[1] for p in got] == ["a.cdf", "b.nc"]
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.Classic(got[0])
    (tmp_path / "none").mkdir()
    for bad in ("none", "absent"):
        with pytest.raises(ValueError):
            netcdf.collect_paths([str(tmp_path / bad)])
