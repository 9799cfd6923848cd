"""Voyages: one run's steps follow one another, runs are independent; the runs of a batch advance together in arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.functions.geo import RADIUS_KM
from tidalgrid.plans.axes import Axes

SCHEMA = (
    "run string, step int, lat double, lng double, time_h double, power_stored_wh float, distance_to_end_km double, powered_velocity_ms double, "
    "solar_power_in_w float, ocean_current_heading_deg double, ocean_current_velocity_ms double, environment_velocity_ms double, combined_velocity_ms double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: A step's seconds, runs that advance together, and the bytes of fields that may be sent to all tasks.
STEP, TOGETHER, MOST_BYTES = 3600, 4096, 1 << 28


@dataclass(frozen=True)
class Field:
    """A cube in memory, holes being NaN, for tasks that sample it step by step."""

    axes: Axes
    values: np.ndarray

    def __call__(self, t: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        """Trilinear values as float32; NaN outside, and where any corner is a hole."""
        a = self.axes
        ti, yi, xi = (t - a.t0) / a.dt, (lat - a.lat0) / a.dlat, np.mod(lng - a.lon0, 360.0) / a.dlon
        inside = (ti >= 0) & (ti <= a.nt - 1) & (yi >= 0) & (yi <= a.nlat - 1) & (a.wrap | (xi <= a.nlon - 1))
        ti, yi, xi = (np.where(inside, x, 0.0) for x in (ti, yi, xi))
        i, j, k = (np.minimum(x.astype(np.int64), n - 1) for x, n in ((ti, a.nt), (yi, a.nlat), (xi, a.nlon)))
        right = (k + 1) % a.nlon if a.wrap else np.minimum(k + 1, a.nlon - 1)

        def plane(f: np.ndarray) -> np.ndarray:
            line = lambda y: self.values[f, y, k] * (1 - (xi - k)) + self.values[f, y, right] * (xi - k)
            return line(j) * (1 - (yi - j)) + line(np.minimum(j + 1, a.nlat - 1)) * (yi - j)

        value = plane(i) * (1 - (ti - i)) + plane(np.minimum(i + 1, a.nt - 1)) * (ti - i)
        return np.where(inside, value, np.nan).astype(np.float32)


def field_of(frames: DataFrame, axes: Axes) -> Field:
    """The field of frames(i, values); one of more than MOST_BYTES is an error, and must be cropped or thinned first."""
    if 8 * axes.nt * axes.nlat * axes.nlon > MOST_BYTES:
        raise ValueError("the field is too large to be sent to all tasks: crop, thin or shorten it")
    values = np.full((axes.nt, axes.nlat, axes.nlon), np.nan)
    for row in frames.where(F.col("i").between(0, axes.nt - 1)).toLocalIterator():
        values[row["i"]] = np.array(row["values"], float).reshape(axes.nlat, axes.nlon)
    return Field(axes, values)


def clear_sky(t, lat, lng):
    """A closed-form sun for tests and demonstrations, in W/m2."""
    return 1000.0 * np.maximum(0.0, np.sin(2 * math.pi * ((t / 3600 + lng / 15) / 24 - 0.25)))


def _distance(lat1, lng1, lat2, lng2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def voyages(runs: pd.DataFrame, solar: Callable, current: Callable | None = None) -> Iterator[pd.DataFrame]:
    """Rows of all runs, a step at a time. ``solar(t, lat, lng)`` gives W/m2 and ``current`` (east, north) in m/s; NaN is a miss.

    A step samples, decides, charges and moves; a run ends on a miss, on arrival, or after its steps.
    """
    lat, lng, end_lat, end_lng = (runs[c].to_numpy(float).copy() for c in ("start_lat", "start_lng", "end_lat", "end_lng"))
    t, left, names = runs["start_time"].to_numpy(np.int64).copy(), runs["max_steps"].to_numpy(np.int64), runs["run"].to_numpy(object)
    start, stored = t.copy(), np.full(len(runs), 1000.0, np.float32)
    zero = np.zeros(len(runs))
    yield pd.DataFrame(dict(zip(NAMES, (names, 0, lat, lng, zero, stored, zero, zero, zero, zero, zero, zero, zero))))
    go, step = np.flatnonzero(left > 0), 0
    while len(go):
        step += 1
        sun = np.asarray(solar(t[go], lat[go], lng[go]), np.float32) * np.ones(len(go), np.float32)
        east, north = (np.broadcast_to(x, len(go)) for x in (current(t[go], lat[go], lng[go]) if current else (0.0, 0.0)))
        known = ~(np.isnan(sun) | np.isnan(east) | np.isnan(north))
        go, sun, east, north = go[known], sun[known], east[known], north[known]
        if not len(go):
            return
        power = stored[go]
        motor = np.where(power <= 600, np.float32(0), np.float32(500))
        other = np.where(power <= 0, np.float32(0), np.where(power <= 600, np.float32(25), np.float32(100)))
        far = _distance(lat[go], lng[go], end_lat[go], end_lng[go])
        a, b, d = np.radians(lat[go]), np.radians(end_lat[go]), np.radians(end_lng[go] - lng[go])
        heading = np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d))
        speed = 3.0 * motor.astype(float) / 500.0
        charge = np.float32(5) * sun
        stored[go] = np.minimum(np.float32(2000), power + (charge - (motor + other)))
        x, y = speed * np.sin(heading) + east, speed * np.cos(heading) + north
        arc, course = np.hypot(x, y) * STEP / (RADIUS_KM * 1000), np.arctan2(x, y)
        sine = np.sin(a) * np.cos(arc) + np.cos(a) * np.sin(arc) * np.cos(course)
        shift = np.arctan2(np.sin(course) * np.sin(arc) * np.cos(a), np.cos(arc) - np.sin(a) * sine)
        lat[go], moved = np.degrees(np.arcsin(np.clip(sine, -1, 1))), lng[go] + np.degrees(shift)
        lng[go] = moved - 360.0 * np.rint(moved / 360.0)
        t[go] += STEP
        drift = np.hypot(east, north)
        hours = ((t[go] - start[go]) // 3600).astype(float)
        yield pd.DataFrame(dict(zip(NAMES, (names[go], step, lat[go], lng[go], hours, stored[go], far, speed, charge, np.degrees(np.arctan2(east, north)) % 360, drift, drift, np.hypot(x, y)))))
        go = go[(far >= 10.0) & (step < left[go])]


def voyage(run: dict, solar: Callable, current: Callable | None = None) -> Iterator[tuple]:
    """Rows of one run; here the callables take single numbers, and None is a miss."""

    def plain(f: Callable, n: int) -> Callable:
        def many(*at):
            got = [f(*(v.item() for v in point)) for point in zip(*at)]
            return np.array([(np.nan,) * n if g is None else g if n > 1 else (g,) for g in got], float).T.reshape(n, -1)

        return many

    sun = plain(solar, 1)
    for rows in voyages(pd.DataFrame([run]), lambda *at: sun(*at)[0], plain(current, 2) if current else None):
        yield from rows.itertuples(index=False, name=None)


def simulate(runs: DataFrame, solar=clear_sky, current=None, shared: dict[str, Field] | None = None) -> DataFrame:
    """Tracks of runs(run, start_time, start_lat, start_lng, end_lat, end_lng, max_steps).

    With ``shared``, fields by name, each sent to the tasks once, columns solar_field, current_u_field and
    current_v_field of the runs name what each samples; a run without currents drifts nowhere.
    """
    held = runs.sparkSession.sparkContext.broadcast(shared) if shared else None

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if held is None:
                groups = [(solar, current, batch)]
            else:
                groups = []
                for (s, u, v), rows in batch.fillna({"current_u_field": "", "current_v_field": ""}).groupby(["solar_field", "current_u_field", "current_v_field"]):
                    flow = (lambda *at, u=u, v=v: (held.value[u](*at).astype(float), held.value[v](*at).astype(float))) if u and v else None
                    groups.append((held.value[s], flow, rows))
            for sun, flow, rows in groups:
                for k in range(0, len(rows), TOGETHER):
                    yield from voyages(rows.iloc[k : k + TOGETHER].reset_index(drop=True), sun, flow)

    return runs.repartition("run").mapInPandas(one, SCHEMA)
