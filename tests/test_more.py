"""Archives, routes, blocks and errors: what tables and SQL don't show."""

import io
import math
import zipfile
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalgrid.functions import geo, meta
from tidalgrid.operators import fields, layers, routers, select, voyage, water
from tidalgrid.plans import axes as plan
from tidalgrid.sources import archive, npz, synthetic


def frame_rows(spark, axes, holes=()):
    cells = [(i, j, k, None if (i, j, k) in holes else float((i * 37 + j * 11 + k * 5) % 50)) for i in range(axes.nt) for j in range(axes.nlat) for k in range(axes.nlon)]
    return fields.frames(spark.createDataFrame(cells, "i int, j int, k int, value double"), axes)


def blend(values, a, t, lat, lon):
    """Brute-force trilinear value; None outside or beside a hole."""
    ti, yi, xi = (t - a.t0) / a.dt, (lat - a.lat0) / a.dlat, (lon - a.lon0) % 360 / a.dlon
    if not (0 <= ti <= a.nt - 1 and 0 <= yi <= a.nlat - 1 and (a.wrap or xi <= a.nlon - 1)):
        return None
    total = 0.0
    for di in (0, 1):
        for dj in (0, 1):
            for dk in (0, 1):
                i, j, k = min(int(ti) + di, a.nt - 1), min(int(yi) + dj, a.nlat - 1), min(int(xi), a.nlon - 1) + dk
                k = k % a.nlon if a.wrap else min(k, a.nlon - 1)
                w = [ti - int(ti), yi - int(yi), xi - min(int(xi), a.nlon - 1)]
                value = values[i][j * a.nlon + k]
                if value is None:
                    return None
                total += value * math.prod(x if d else 1 - x for x, d in zip(w, (di, dj, dk)))
    return total


@pytest.mark.parametrize("axes", [plan.Axes(100, 10, 4, -30.0, 15.0, 5, -10.0, 1.0, 9), plan.Axes(0, 10, 3, -80.0, 20.0, 9, 0.0, 20.0, 18), plan.Axes(0, 10, 3, 0.0, 5.0, 3, 350.0, 5.0, 5)])
@pytest.mark.parametrize("side", [2, 3, 32])
def test_tiles_match_brute_force(spark, axes, side):
    cube = frame_rows(spark, axes, {(1, 1, 2), (2, 2, 0)})
    values = {r["i"]: r["values"] for r in cube.collect()}
    draw = np.random.default_rng(5)
    points = [(n, int(axes.t0 + draw.integers(-2, axes.nt * axes.dt)), float(axes.lat0 + draw.integers(-1, 8 * axes.nlat) * axes.dlat / 8), float(axes.lon0 + draw.integers(-8, 8 * axes.nlon) * axes.dlon / 8 + 360 * draw.integers(-1, 2))) for n in range(300)]
    got = {r["id"]: r["value"] for r in fields.sample(spark.createDataFrame(points, "id long, t long, lat double, lon double"), cube, axes, side).collect()}
    want = {n: v for n, *at in points if (v := blend(values, axes, *at)) is not None}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want) and len(want) > 5


def test_regional_grids_take_any_longitude(spark):
    for lon0, lon in ((-10.0, -5.0), (-10.0, 355.0), (350.0, -5.0), (350.0, 355.0)):
        axes = plan.Axes(0, 10, 2, 0.0, 1.0, 2, lon0, 1.0, 20)
        point = spark.createDataFrame([(1, 0, 0.0, lon)], "id long, t long, lat double, lon double")
        assert fields.sample(point, frame_rows(spark, axes), axes).count() == 1


def test_write_parts_and_sample_them(spark, tmp_path):
    axes = plan.Axes(1000, 10, 9, 0.0, 1.0, 4, 10.0, 2.0, 5)
    frames = frame_rows(spark, axes, {(5, 1, 1)}).where("i <> 6")  # a missing frame is holes
    made = archive.write_parts(frames, axes, str(tmp_path / "f"), "waves", limit=4 * 4 * 5 * 2).orderBy("part").collect()
    assert [(r["part"], r["t0"], r["nt"]) for r in made] == [(0, 1000, 4), (1, 1030, 4), (2, 1060, 3)]
    assert made[1]["path"].endswith("waves.001.npz")
    held = npz.members(open(made[2]["path"], "rb").read())
    assert list(held["part_t0"]) == [1000, 1030, 1060] and list(held["part_nt"]) == [4, 4, 3] and held["overlap"] == 1 and held["data"].dtype == np.uint16
    path = str(tmp_path / "f" / "*.npz")
    found, grid = archive.load_parts(spark, path)
    assert [(r["t0"], r["end"]) for r in found] == [(1000, 1030), (1030, 1060), (1060, 1080)] and grid.nlon == 5
    step = 50 / 65534
    values = {r["i"]: r["values"] for r in frames.collect()} | {6: [None] * 20}
    points = [(n, 1000 + n * 2, 0.25 + n % 5 / 2, 10.5 + n % 7) for n in range(45)]
    got = {r["id"]: r["value"] for r in archive.sample_archive(spark.createDataFrame(points, "id long, t long, lat double, lon double"), path).collect()}
    want = {n: v for n, *at in points if (v := blend(values, axes, *at)) is not None}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < step for n in want)
    union = {r["t"]: r["values"] for r in npz.union_parts(npz.read_frames(spark, path)).collect()}
    assert sorted(union) == list(range(1000, 1081, 10)) and union[1060] == [None] * 20
    rated = archive.write_parts(frames, axes, str(tmp_path / "r"), "one", divide_by=10.0, packed=False).collect()
    plain = npz.members(open(rated[0]["path"], "rb").read())
    assert len(rated) == 1 and rated[0]["path"].endswith("one.npz") and plain["data"].dtype == np.float32 and abs(plain["data"][0, 0, 1] - 0.5) < 1e-6
    os_path = tmp_path / "f" / "other.npz"
    npz.write_field(str(os_path), plan.Axes(5000, 10, 2, 0.0, 1.0, 4, 10.0, 2.5, 5), np.zeros((2, 4, 5), np.uint16))
    with pytest.raises(ValueError, match="other.npz"):
        archive.load_parts(spark, path)
    with pytest.raises(ValueError):
        archive.write_parts(frames.withColumn("values", F.transform("values", lambda v: F.lit(None).cast("double"))), axes, str(tmp_path / "n"), "x")


def test_gaps_between_parts_are_misses(spark, tmp_path):
    for t0 in (0, 100):
        npz.write_field(str(tmp_path / f"p{t0}.npz"), plan.Axes(t0, 10, 3, 0.0, 1.0, 2, 0.0, 1.0, 2), np.full((3, 2, 2), t0, np.uint16))
    points = spark.createDataFrame([(1, 20, 0.0, 0.0), (2, 21, 0.0, 0.0), (3, 99, 0.0, 0.0), (4, 100, 1.0, 1.0), (5, 121, 0.0, 0.0)], "id long, t long, lat double, lon double")
    assert {r["id"]: r["value"] for r in archive.sample_archive(points, str(tmp_path / "*.npz")).collect()} == {1: 0.0, 4: 100.0}


def test_writer_and_recorder(tmp_path):
    path = str(tmp_path / "a.npz")
    out = archive.NpzWriter(path)
    out.add("x", np.arange(3))
    for name in ("", "x"):
        with pytest.raises(ValueError):
            out.add(name, np.arange(2))
    assert not (tmp_path / "a.npz").exists()
    out.close()
    out.close()
    with pytest.raises(ValueError):
        out.add("y", np.arange(2))
    assert list(np.load(path)["x"]) == [0, 1, 2]
    archive.NpzWriter(str(tmp_path / "none.npz")).close()
    assert zipfile.ZipFile(tmp_path / "none.npz").namelist() == []
    record = archive.Recorder()
    for k in range(3):
        record.record(lat=float(k), time=timedelta(seconds=90 * k + 0.9))
    record.set_scalar("speed", 1)
    record.set_scalar("speed", 2.5)
    record.save(path)
    got = np.load(path)
    assert list(got["time"]) == [0, 90, 180] and got["speed"] == 2.5 and len(got["lat"]) == 3
    record.clear()
    record.save(path)
    assert np.load(path).files == []
    wide = np.zeros(2, [(f"column_{k:06d}", "<f4") for k in range(5000)])
    image = archive.npy_image(wide)
    assert image[6] == 2 and np.load(io.BytesIO(image), max_header_size=1 << 20).dtype == wide.dtype


def test_caches():
    loads = []
    held = archive.FrameCache(100)
    for key, size in ((1, 40), (2, 40), (1, 40), (3, 40), (2, 40), (9, 200), (9, 200)):
        held.get(key, lambda key=key, size=size: loads.append(key) or np.zeros(size, np.uint8))
    assert loads == [1, 2, 3, 2, 9, 9] and held.used <= 100

    def load(path):
        if path == "bad":
            raise OSError(path)
        loads.append(path)
        return path

    loads.clear()
    parts = archive.PartCache(load, 2)
    for path in "abacbb":
        parts.get(path)
    with pytest.raises(OSError):
        parts.get("bad")
    assert loads == ["a", "b", "c"] and set(parts.held) == {"b", "c"}
    with pytest.raises(ValueError):
        archive.PartCache(load, 0)


def test_blocks_reach_the_same_fixpoint(spark):
    draw = np.random.default_rng(3)
    cells = [(r * 12 + c, r, c, r * 0.1, c * 0.1) for r in range(10) for c in range(12) if draw.random() > 0.25]
    table = spark.createDataFrame(cells, "cell long, row long, col long, lat double, lng double")
    depth = spark.createDataFrame([(c[0], float(c[0] % 7 + 1)) for c in cells], "cell long, d double")
    sources = spark.createDataFrame([(c[0], float(c[0] % 3)) for c in cells if c[0] % 31 == 0], "cell long, value double")
    near = {}
    for r in water.adjacency(table).collect():
        near.setdefault(r["src"], []).append((r["dst"], r["km"]))
    seed = next(c[0] for c in cells if c[0] in near)
    dist, wide = {r["cell"]: r["value"] for r in sources.collect()}, {seed: float(seed % 7 + 1)}
    for _ in range(200):
        for a, others in near.items():
            for b, km in others:
                if a in dist and dist[a] + km < dist.get(b, math.inf):
                    dist[b] = dist[a] + km
                if a in wide and min(wide[a], b % 7 + 1) > wide.get(b, -1):
                    wide[b] = float(min(wide[a], b % 7 + 1))
    for block in (3, 64):
        edges = water.adjacency(table, block=block)
        assert {r["cell"]: round(r["value"], 6) for r in water.shore_distance(sources, edges).collect()} == {c: round(v, 6) for c, v in dist.items()}
        assert {r["cell"]: r["value"] for r in water.access_width(depth, edges, seed).collect()} == {c: 2 * v for c, v in wide.items()}
        assert {r["cell"] for r in water.component(edges, seed).collect()} == set(wide)
    with pytest.raises(ValueError):
        water.component(water.adjacency(table), 10_000)


def nav(spark, tmp_path=None):
    rows, cols = 40, 60
    land = lambda r, c: 14 <= c <= 15 and r < 30
    base = [(r, c, -1.0 if land(r, c) else 30.0, 0.0 if land(r, c) else 4.0 * min(max(abs(c - 14.5) - 1.5, 0.0), 20.0)) for r in range(rows) for c in range(cols)]
    tree = water.pyramid(spark.createDataFrame(base, "row long, col long, margin double, budget double"), 3)
    if tmp_path is not None:
        routers.save_map(tree, str(tmp_path / "map"), {"k": 5, "w": 2})
        tree, header = routers.load_map(spark, str(tmp_path / "map"))
        assert header == {"k": 5.0, "w": 2.0}
    return routers.NavMap.of(tree, 3, 0.0, 0.0, 0.1, 5.0, 2.0)


def test_routes_go_round_land(spark, tmp_path):
    held = nav(spark, tmp_path)
    assert held.legal(1.0, 1.0) and not held.legal(1.0, 1.4) and held.decide(50.0, 0.0) == (-math.inf, 0.0)
    assert held.shore(50.0, 0.0) == math.inf and math.isnan(held.shore(1.0, 1.4)) and held.shore(1.0, 3.0) > held.shore(1.0, 2.0)
    straight = list(routers.route(held, (3.5, 0.5), (3.5, 5.0), max_hours=100.0))
    assert straight[-1][-1] == "arrived" and straight[-1][6] < len(straight) and all(0 <= r[4] <= 1 for r in straight)
    blocked = list(routers.route(held, (1.0, 0.9), (1.0, 5.0), max_hours=100.0))
    assert blocked[-1][-1] in ("blocked", "time") and all(held.legal(r[1], r[2]) for r in blocked)
    coastal = list(routers.route(held, (1.0, 2.0), (2.8, 2.2), hug_km=60.0, max_hours=60.0))
    assert coastal[-1][-1] == "arrived" and all(held.legal(r[1], r[2]) for r in coastal) and coastal[-1][6] == 21 * (len(coastal) - 1)
    with pytest.raises(ValueError):
        next(routers.route(held, (1.0, 1.4), (1.0, 5.0)))
    runs = spark.createDataFrame([("a", 3.5, 0.5, 3.5, 5.0), ("b", 1.0, 1.4, 1.0, 5.0)], "run string, start_lat double, start_lng double, end_lat double, end_lng double")
    got = routers.routes(runs, held, max_hours=100.0).collect()
    assert [r["ended"] for r in got if r["run"] == "b"] == ["illegal"] and sum(r["run"] == "a" for r in got) == len(straight)


def test_voyages_over_fields(spark):
    axes = plan.Axes(0, 3600, 12, -5.0, 1.0, 11, -5.0, 1.0, 11)
    sun, east = (fields.frames(fields.dense(spark.range(12 * 121).select(F.floor(F.col("id") / 121).cast("int").alias("i"), F.pmod(F.floor(F.col("id") / 11), F.lit(11)).cast("int").alias("j"), F.pmod("id", F.lit(11)).cast("int").alias("k"), F.lit(v).alias("value")), axes), axes) for v in (200.0, 0.5))
    shared = {"sun": voyage.field_of(sun, axes), "flow": voyage.field_of(east, axes)}
    runs = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 0.4, 9, "sun", None, None), ("b", 0, 0.0, 0.0, 0.0, 0.4, 9, "sun", "flow", "flow"), ("c", 36000, 0.0, 0.0, 3.0, 3.0, 9, "sun", None, None)], "run string, start_time long, start_lat double, start_lng double, end_lat double, end_lng double, max_steps int, solar_field string, current_u_field string, current_v_field string")
    got = voyage.simulate(runs, shared=shared).orderBy("run", "step").collect()
    a, b, c = ([r for r in got if r["run"] == n] for n in "abc")
    assert len(c) == 3 and a[0]["distance_to_end_km"] == 0 and a[0]["power_stored_wh"] == 1000 and a[1]["solar_power_in_w"] == 1000
    assert a[-1]["distance_to_end_km"] < 10 and abs(b[1]["ocean_current_velocity_ms"] - math.hypot(0.5, 0.5)) < 1e-6 and abs(b[1]["ocean_current_heading_deg"] - 45) < 1e-6
    assert a[1]["combined_velocity_ms"] == 3.0 and b[1]["combined_velocity_ms"] > 3.3
    with pytest.raises(ValueError):
        voyage.field_of(sun, plan.Axes(0, 10, 10_000, -80.0, 1.0, 161, 0.0, 1.0, 360))


def test_selection_errors(spark):
    times = spark.createDataFrame([(0,), (10,), (25,)], "t long")
    small, here = plan.Axes(0, 1, 2, 0.0, 1.0, 3, 0.0, 1.0, 3), spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    files, apart = spark.createDataFrame([("a", 1), ("b", 2)], "path string, units int"), spark.createDataFrame([(1,), (3,)], "i long")
    uneven = spark.createDataFrame([(t, "f") for t in (0, 10, 20, 40)], "t long, source string")
    wrong = [
        (select.time_window, times, 30, 20), (select.time_window, times, 100, None), (select.pick_times, times, "0:2", 1), (select.scan_times, times.where("false")),
        (fields.require_uniform, times, "time"), (select.check_box, 0, 10, 5, 5), (select.check_box, 0, -91, 5, 5), (select.check_box, 5, 0, 4, 5, True),
        (select.at_index, times, {"x": 1}, {}), (select.at_index, times, {"t": 3}, {"t": 3}), (select.contiguous_run, apart, "longitude"), (layers.require_track, times),
        (plan.time_blocks, 86400, 0, 1), (plan.space_blocks, 5, 0, 4, 1, 1), (select.label_box, here, 10, 10, 20, 20), (select.cropped_axes, small, 50, 0, 60, 2),
        (fields.thin, times, 5, small), (fields.crop, times, small, 50, 0, 60, 2), (layers.require_compatible, files, ["units"]), (select.check_joined, uneven),
    ]
    for f, *given in wrong:
        with pytest.raises(ValueError):
            f(*given)
            print(f.__name__, given)
    assert select.contiguous_run(spark.createDataFrame([(2,), (3,)], "i long"), "x") == (2, 4)
    assert [r["t"] for r in select.pick_times(times, "1:", stride=1).orderBy("t").collect()] == [10, 25]
    axes = select.cropped_axes(plan.Axes(0, 1, 2, 0.0, 1.0, 3, 0.0, 10.0, 36), 350, 0, 20, 1)
    assert (axes.lon0, axes.nlon, axes.nlat) == (350, 4, 2)
    assert select.wraps(36, 10.0) and not select.wraps(35, 10.0) and select.wraps(3, 119.9, 1.0)
    shown, left = layers.first_runs(spark.createDataFrame([(f"r{k}", k) for k in range(12)], "run string, pos int"))
    assert shown.count() == 10 and {r["run"] for r in left.collect()} == {"r10", "r11"}
    assert layers.select_channels(spark.createDataFrame([(1, 2.0, 3.0)], "run int, lat double, power double"), ["power", "x"])[1] == ["x"]
    with pytest.raises(Exception, match="positive spacing"):
        layers.expand_sweeps(spark.createDataFrame([("a", 0, 3, "0h")], "name string, start_time long, count int, every string")).collect()


def test_download_plan():
    day = 86400
    assert plan.time_blocks(5, 2 * day + 7, 2) == [(0, 2 * day - 1), (2 * day, 3 * day - 1)]
    tiles = plan.space_blocks(0.0, 0.0, 1.0, 0.7, 0.1)
    assert len(tiles) == 70 and tiles[-1][2:] == (1.0, 0.7) and max(t[0] for t in tiles) < 1.0
    assert plan.space_blocks(0, 0, 4, 2, 2, gap=0.25) == [(0, 0, 1.75, 2), (2, 0, 4, 2)]
    every = plan.download_plan("waves", 0, 3 * day, 2, (0.0, 0.0, 4.0, 2.0), 2.0)
    assert len(every) == 4 and every[0]["name"] == "waves_19700101_19700102_0_0_2_2.nc"
    assert len(plan.download_plan("waves", 0, 3 * day, 2, (0.0, 0.0, 4.0, 2.0), 2.0, {every[0]["name"]})) == 3
    assert plan.day_end("1970-01-02") == 2 * day - 1 and plan.day_end("1970-01-01T00:00:05Z") == 5


def test_metadata_edges(spark):
    one = spark.range(1)
    got = one.select(
        meta.valid_time(F.lit(20240229), F.lit(1230)).alias("a"), meta.decoded_time(F.lit(1.0), F.lit("months since 2000-01-01"), F.lit(None).cast("string")).alias("b"),
        meta.decoded_time(F.lit(0.5), F.lit("days since 2000-01-01"), F.lit("gregorian")).alias("c"), meta.unpacked(F.lit(5), F.lit(float("nan")), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(1.0)).alias("d"),
        meta.stamp(F.lit(-60)).alias("e"), meta.human(F.lit(1536)).alias("f"),
    ).first()
    assert (got["a"], got["b"], got["c"], got["d"], got["e"], got["f"]) == (1709209800, None, 946728000, 6.0, "1969-12-31T23:59Z", "1.5 KB")
    x = one.select(*[c.alias(n) for n, c in zip("xyz", geo.to_xyz(F.lit(30.0), F.lit(-120.0), 2.0))])
    back = x.select(*[F.round(c, 9).alias(n) for n, c in zip("ab", geo.from_xyz(F.col("x"), F.col("y"), F.col("z")))]).first()
    assert tuple(back) == (30.0, -120.0)
    assert synthetic.cube(spark, "small", 0).count() == 5 * 4 * 21 * 31


def test_rings_and_swept_moves(spark, tmp_path):
    square = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    hole = "[[1,1],[1,3],[3,3],[3,1],[1,1]]"
    (tmp_path / "o.json").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [%s, %s]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}}]}' % (square, hole))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 11.0, 1.0), (4, 20.0, 1.0)], "id long, x double, y double")
    got = water.contains(points, water.rings(spark, str(tmp_path / "o.json")))
    assert {r["id"]: r["inside"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}
    base = spark.createDataFrame([(r, c, -1.0 if c == 4 else 1.0, 1.0) for r in range(8) for c in range(8)], "row long, col long, margin double, budget double")
    moves = spark.createDataFrame([(1, 0, 0, 0, 3), (2, 0, 0, 0, 7), (3, 0, 5, 7, 7)], "id long, row1 long, col1 long, row2 long, col2 long")
    assert {r["id"]: r["legal"] for r in water.swept(moves, water.pyramid(base, 3), 3).collect()} == {1: True, 2: False, 3: True}


def test_config_and_labels(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "runs.yaml").write_text("defaults: {solar_field: sun.npz}\nruns:\n  - {name: a, start_time: 2024-01-01T00:00:00Z, sweep: {count: 2, every: 6h}}\n".replace("2024-01-01T00:00:00Z", "'2024-01-01T00:00:00Z'"))
    assert [(r["name"], r["start_time"]) for r in plan.load_config(str(tmp_path / "runs.yaml"))] == [("a_0", 1704067200), ("a_1", 1704088800)]
    assert plan.spread([1.0, 1.1, 5.0], 0.5) == [1.0, 1.5, 5.0] and plan.spread([3.0, 2.9], 1.0) == [3.9, 2.9]


def test_replay_counts_hourly_distance(spark, tmp_path):
    from tidalgrid.streaming import replay

    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 2.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-01 01:10:00", 4.0), ("a", "2024-01-01 09:00:00", 0.0)], "run string, ts string, km double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = replay.hourly(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    work = stream.writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    work.awaitTermination(60)
    assert sorted(r["km"] for r in spark.table("hourly").collect())[-2:] == [4.0, 5.0]
