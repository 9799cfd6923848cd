"""Small fixtures with results that follow from the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalgrid.functions import geo
from tidalgrid.operators import fields, layers, tracks, voyage, water
from tidalgrid.plans import axes as plan
from tidalgrid.sources import npz

AXES = plan.Axes(0, 10, 3, 0.0, 1.0, 3, 0.0, 90.0, 4)


def cube(spark, hole=None):
    cells = [(i, j, k, float(100 * i + 10 * j + k)) for i in range(3) for j in range(3) for k in range(4) if (i, j, k) != hole]
    return fields.frames(fields.dense(spark.createDataFrame(cells, "i int, j int, k int, value double"), AXES), AXES)


def sampled(spark, points, hole=None):
    rows = [(n, *p) for n, p in enumerate(points)]
    got = fields.sample(spark.createDataFrame(rows, "id long, t long, lat double, lon double"), cube(spark, hole), AXES)
    return {r["id"]: r["value"] for r in got.collect()}


def test_sampling_edges_and_seam(spark):
    got = sampled(spark, [(0, 0.0, 0.0), (20, 2.0, 270.0), (5, 0.5, 45.0), (0, 0.0, 315.0), (0, 0.0, -45.0 + 720), (21, 0.0, 0.0), (0, 2.1, 0.0), (0, float("nan"), 0.0)])
    assert got == {0: 0.0, 1: 223.0, 2: 55.5, 3: 1.5, 4: 1.5}


def test_holes_are_misses_even_without_weight(spark):
    assert sampled(spark, [(0, 0.0, 0.0), (0, 1.0, 180.0)], hole=(1, 0, 0)) == {1: 12.0}


def test_quantised_within_a_step(spark):
    cells = spark.createDataFrame([(0, 0, k, v) for k, v in enumerate([1.0, 2.5, None, float("nan"), 7.0])], "i int, j int, k int, value double")
    got = [r["value"] for r in fields.dequantise(fields.quantise(cells)).orderBy("k").collect()]
    assert got[2] is None and got[3] is None
    assert max(abs(a - b) for a, b in zip([got[0], got[1], got[4]], [1.0, 2.5, 7.0])) < 1e-3


@pytest.mark.parametrize("nt", range(1, 40))
@pytest.mark.parametrize("n", (2, 3, 7, 100))
def test_chunks_cover_with_one_shared_frame(nt, n):
    parts = plan.chunk_plan(nt, 10, n * 10)
    assert parts[0][0] == 0 and parts[-1][1] == nt
    assert all(b - a <= n for a, b in parts) and all(y[0] == x[1] - 1 for x, y in zip(parts, parts[1:]))


def test_frame_specs():
    assert [plan.parse_frames(s, 10) for s in ("2:4", "3", ":", "-5:99")] == [(2, 4), (3, 4), (0, 10), (0, 10)]
    with pytest.raises(ValueError):
        plan.parse_frames("4:4", 10)


def test_runs_expand():
    config = {"defaults": {"solar_field": "s", "name": "x"}, "runs": [{"sweep": {"count": 11, "every": "6h"}, "name": "feb", "start_time": "1970-01-01T00:00:10Z"}, {}]}
    got = plan.expand_runs(config)
    assert [g["name"] for g in got][::5] == ["feb_00", "feb_05", "feb_10"] and got[1]["start_time"] == 21610 and got[-1]["name"] == "run_01"
    with pytest.raises(ValueError):
        plan.expand_runs({"runs": [{"solar_field": "s", "sweep": {"count": 2}}]})
    with pytest.raises(ValueError):
        plan.expand_runs({"runs": [{"solar_field": "s", "name": "a"}, {"solar_field": "s", "name": "a"}]})


def test_nearest_time_ties_go_to_the_earlier(spark):
    times = spark.createDataFrame([(0,), (10,), (30,)], "t long")
    asked = spark.createDataFrame([(1, 5), (2, 6), (3, -9), (4, 99), (5, 20)], "id long, t long")
    assert {r["id"]: r["at"] for r in fields.nearest_time(asked, times).collect()} == {1: 0, 2: 10, 3: 0, 4: 30, 5: 10}


def test_value_at(spark):
    series = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0)], "run string, t long, value double")
    asked = spark.createDataFrame([(1, "a", 5), (2, "a", -1), (3, "a", 11), (4, "a", 10), (5, "b", 1)], "id long, run string, t long")
    assert {r["id"]: r["value"] for r in tracks.value_at(asked, series).collect()} == {1: 2.0, 2: 1.0, 3: 3.0, 4: 3.0}


def test_npz_round_trip_and_parts(spark, tmp_path):
    raw = np.arange(36, dtype=np.uint16).reshape(3, 3, 4)
    raw[1, 1, 1] = 65535
    npz.write_field(str(tmp_path / "a.npz"), AXES, raw, 0.5, 1.0)
    later = plan.Axes(20, 10, 3, 0.0, 1.0, 3, 0.0, 90.0, 4)
    npz.write_field(str(tmp_path / "b.npz"), later, raw, 0.5, 2.0)
    got = {r["t"]: r["values"] for r in npz.union_parts(npz.read_frames(spark, str(tmp_path / "*.npz"))).collect()}
    assert sorted(got) == [0, 10, 20, 30, 40] and got[0][1] == 1.5 and got[10][5] is None and got[20][0] == 13.0
    with pytest.raises(ValueError):
        npz.write_field(str(tmp_path / "c.npz"), AXES, raw[:2])


def test_voyage_stops_on_arrival_and_on_a_miss():
    run = {"run": "r", "start_time": 0, "start_lat": 0.0, "start_lng": 0.0, "end_lat": 0.0, "end_lng": 0.5, "max_steps": 99}
    got = list(voyage.voyage(run, lambda *a: 1000.0))
    assert got[0][6] == 0.0 and got[-1][6] < 10 and len(got) < 12 and all(r[5] <= 2000 for r in got)
    assert len(list(voyage.voyage(run, lambda *a: None))) == 1
    assert len(list(voyage.voyage(run | {"max_steps": 0}, lambda *a: 1.0))) == 1


def test_width_and_distance_on_a_strip(spark):
    cells = spark.createDataFrame([(c, 0, c, 0.0, c * 1.0) for c in range(5)], "cell long, row long, col long, lat double, lng double")
    edges = water.adjacency(cells)
    depth = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 9.0), (3, 1.0), (4, 9.0)], "cell long, d double")
    assert [r["value"] for r in water.access_width(depth, edges, 0).orderBy("cell").collect()] == [10.0, 4.0, 4.0, 2.0, 2.0]
    sources = spark.createDataFrame([(0, 3.0), (4, 0.0)], "cell long, value double")
    degree = 2 * math.pi * geo.RADIUS_KM / 360
    assert [round(r["value"] / degree, 3) for r in water.shore_distance(sources, edges).orderBy("cell").collect()][1:] == [round(1 + 3 / degree, 3), 2.0, 1.0, 0.0]


def test_policies_and_units(spark):
    got = spark.range(1).select(geo.seconds_of(F.lit("1.5h")).alias("a"), geo.seconds_of(F.lit("x")).alias("b"), geo.is_accumulated(F.lit(" J  m**-2"), F.lit(None).cast("string")).alias("c"), *[x.alias(n) for n, x in zip("de", geo.power_policy(F.lit(300.0)))]).first()
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == (5400, None, True, 0.0, 25.0)


def test_great_circle_of_opposite_places(spark):
    legs = spark.createDataFrame([(1, 0.0, -155.0, 0.0, 25.0), (2, 0.0, 10.0, 0.0, 80.0)], "id long, lat1 double, lng1 double, lat2 double, lng2 double")
    got = layers.great_circle_points(legs, 8).collect()
    assert len(got) == 16 and {round(r["lat"], 9) for r in got if r["id"] == 2} == {0.0}
    # halfway between opposite places the sum of both is no direction; its 0 / 0 is the pole in the query's SQL
    assert [round(r["lat"], 3) for r in sorted(got) if r["id"] == 1] == [0, 0, 0, 90, 90, 0, 0, 0]


def test_nearest_time_of_many_asked_at_once(spark):
    """Thousands asked in one stretch of time, before, after and between its steps; ids of any type."""
    times = spark.createDataFrame([(t,) for t in (0, 7, 100, 6400)], "t long")
    asked = spark.range(60_000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"), (F.col("id") % 131 - 10).alias("t"))
    got = fields.nearest_time(asked, times)
    want = {t: min((0, 7, 100, 6400), key=lambda s: (abs(s - t), s)) for t in range(-10, 121)}
    assert {(r["t"], r["at"]) for r in got.select("t", "at").distinct().collect()} == set(want.items()) and got.count() == 60_000


def test_deepest_of_points_listed_twice(spark):
    base = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, -1.0, 2.0)], "row long, col long, margin double, budget double")
    points = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 1), (2, 0, 1), (3, 9, 9)], "id long, row long, col long")
    got = sorted((r["id"], r["km"]) for r in water.deepest(points, water.pyramid(base, 1), 1, 5.0, 2.0).collect() if r["km"] is not None)
    assert got == [(1, 8.0), (1, 8.0), (3, float("inf"))] and water.deepest(points, water.pyramid(base, 1), 1, 5.0, 2.0).count() == 5


def test_width_across_many_blocks(spark):
    """A long strip of many blocks with a hole in every row takes a few rounds, and gives what one search over all cells gives."""
    kept = [(r, c) for r in range(240) for c in range(4) if (r * 7 + c * 5) % 11 != 3 and (r % 9 or c in (r % 4, (r + 1) % 4))]
    cells = spark.createDataFrame([(r * 4 + c, r, c, 0.0, 0.0) for r, c in kept], "cell long, row long, col long, lat double, lng double")
    deep = {r * 4 + c: float((r * 13 + c * 29) % 37 + 300 - r) for r, c in kept}
    depth = spark.createDataFrame(list(deep.items()), "cell long, d double")
    seed = kept[len(kept) // 2][0] * 4 + kept[len(kept) // 2][1]
    want, queue = {}, [(-deep[seed], seed)]
    while queue:
        queue.sort()
        v, x = queue.pop(0)
        if x not in want:
            want[x] = -2 * v
            r, c = divmod(x, 4)
            queue += [(-min(-v, deep[y]), y) for y in ((r + 1) * 4 + c, (r - 1) * 4 + c, r * 4 + (c + 1) % 4, r * 4 + (c - 1) % 4) if y in deep]
    rounds, cut = [], water._cut
    water._cut = lambda df: rounds.append(1) or cut(df)
    try:
        got = {r["cell"]: r["value"] for r in water.access_width(depth, water.adjacency(cells, 4, block=2), seed, grow=4).collect()}
    finally:
        water._cut = cut
    assert got == want and len(want) > 200 and len(rounds) <= 12
    alone = water.access_width(depth, water.adjacency(cells, 4, block=2).where("false"), seed)
    assert [tuple(r) for r in alone.collect()] == [(seed, 2 * deep[seed])]
