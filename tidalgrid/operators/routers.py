"""Toy routes over a clearance map: straight for the goal with side steps, or along a coast.

A route is a fold, so each is one task's work; the map is sent to the tasks once, while its size allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.functions.geo import RADIUS_KM

#: Cells of a map that may be sent to all tasks.
MOST_CELLS = 2_000_000
# Headings tried for a blocked course, the fan of a coastal one, what a turn and being far out cost,
# and the charge and draw of the toy battery an hour.
SIDESTEPS = [0, 20, -20, 40, -40, 65, -65, 90, -90, 115, -115]
FAN = list(range(-150, 151, 15))
HUG_WEIGHT, TURN_WEIGHT, LEASH = 3.0, 0.35, 4.0
CHARGE, DRAW, FIRST_BATTERY = 0.10, 0.030, 0.6
ROUTE = "run string, step int, lat double, lng double, hours double, battery double, shore_km double, asked int, ended string"


class NavMap:
    """Levels of (row, col) -> (lo, hi, budget) on a nesting grid whose finest cells are ``step`` degrees."""

    def __init__(self, levels: list[dict], lat0: float, lng0: float, step: float, k: float, w: float):
        self.levels, self.lat0, self.lng0, self.step, self.k, self.w = levels, lat0, lng0, step, k, w

    @classmethod
    def of(cls, tree: DataFrame, levels: int, lat0: float, lng0: float, step: float, k: float, w: float) -> NavMap:
        """From a pyramid's table; one of more than MOST_CELLS is an error, and points are then decided by joins."""
        if tree.limit(MOST_CELLS + 1).count() > MOST_CELLS:
            raise ValueError("the map is too large to be sent to all tasks")
        held: list[dict] = [{} for _ in range(levels)]
        for r in tree.select("level", "row", "col", "lo", "hi", "budget").toLocalIterator():
            held[r["level"]][r["row"], r["col"]] = (r["lo"], r["hi"], r["budget"])
        return cls(held, lat0, lng0, step, k, w)

    def _down(self, lat: float, lng: float) -> Iterator[tuple | None]:
        row, col = math.floor((lat - self.lat0) / self.step + 0.5), math.floor((lng - self.lng0) / self.step + 0.5)
        for level in reversed(range(len(self.levels))):
            yield self.levels[level].get((row >> level, col >> level))

    def decide(self, lat: float, lng: float) -> tuple[float, float]:
        """Margin and budget of the coarsest cell that decides; outside, minus infinity and none."""
        found = (-math.inf, 0.0)
        for cell in self._down(lat, lng):
            if cell is None:
                return -math.inf, 0.0
            lo, hi, budget = cell
            if lo >= 0:
                return lo, budget
            if hi < 0:
                return hi, 0.0
            found = (lo, budget)
        return found

    def legal(self, lat: float, lng: float) -> bool:
        return self.decide(lat, lng)[0] >= 0

    def shore(self, lat: float, lng: float) -> float:
        """Distance to shore by the finest cell stored; infinite outside, NaN where it is illegal."""
        margin = self.decide(lat, lng)[0]
        if margin == -math.inf:
            return math.inf
        if margin < 0:
            return math.nan
        last = None
        for cell in self._down(lat, lng):
            if cell is None:
                break
            last = cell
        return math.inf if last is None else last[2] + self.k + self.w / 2


class Budget:
    """What may still be travelled before the map must be asked again."""

    def __init__(self, nav: NavMap, left: float = 0.0):
        self.nav, self.left, self.asked = nav, left, 0

    def step(self, lat: float, lng: float, km: float) -> bool:
        self.left -= km
        if self.left > 0:
            return True
        self.asked += 1
        margin, budget = self.nav.decide(lat, lng)
        self.left = budget if margin >= 0 else 0.0
        return margin >= 0


def _km(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * RADIUS_KM * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def _course(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lng2 - lng1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) % 360


def _ahead(lat: float, lng: float, course: float, km: float) -> tuple[float, float]:
    a, c, d = math.radians(lat), math.radians(course), km / RADIUS_KM
    sine = math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(c)
    shift = math.atan2(math.sin(c) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * sine)
    return math.degrees(math.asin(max(-1.0, min(1.0, sine)))), (lng + math.degrees(shift) + 540) % 360 - 180


def route(nav: NavMap, start: tuple[float, float], goal: tuple[float, float], hug_km: float | None = None, speed_kmh: float = 9.0, dt_min: float = 20.0, arrive_km: float = 25.0, max_hours: float = 400.0) -> Iterator[tuple]:
    """(step, lat, lng, hours, battery, shore, asked, ended) of a route; ``hug_km`` makes it a coastal one.

    A straight route takes the first legal heading of SIDESTEPS, a coastal one the best of FAN: near the goal, within
    the band along the shore, without much turning, and never further from the goal than the leash allows.
    """
    if not nav.legal(*start):
        raise ValueError(f"the start {start} isn't navigable")
    (lat, lng), hours, charge = start, 0.0, FIRST_BATTERY
    pace = speed_kmh * dt_min / 60.0
    look = max(4.0 * pace, 20.0)
    budget, asked, turned, nearest, step = Budget(nav), 0, 0.0, _km(*start, *goal), 0
    shore = nav.shore(lat, lng) if hug_km is not None else math.nan
    while True:
        over = "arrived" if _km(lat, lng, *goal) <= arrive_km else "time" if hours >= max_hours else None
        ahead = None
        if over is None:
            course = _course(lat, lng, *goal)
            if hug_km is None:
                for offset in SIDESTEPS:
                    there, trial = _ahead(lat, lng, course + offset, pace), Budget(nav, budget.left)
                    if trial.step(*there, pace):
                        ahead, budget.left, asked = there, trial.left, asked + trial.asked
                        break
            else:
                top = -math.inf
                for offset in FAN:
                    there = _ahead(lat, lng, course + offset, pace)
                    far = nav.shore(*_ahead(lat, lng, course + offset, look))
                    asked += 1
                    left = _km(*there, *goal)
                    if not math.isfinite(far) or not nav.legal(*there) or left > nearest + LEASH * hug_km:
                        continue
                    worth = -left - HUG_WEIGHT * max(0.0, far - hug_km) - TURN_WEIGHT * abs(offset - turned) / 90.0 * pace
                    if worth > top:
                        top, ahead, shore, chosen = worth, there, far, float(offset)
                if ahead:
                    turned, nearest = chosen, min(nearest, _km(*ahead, *goal))
            over = None if ahead else "blocked"
        yield step, lat, lng, hours, charge, shore, asked, over
        if over:
            return
        (lat, lng), hours, step = ahead, hours + dt_min / 60.0, step + 1
        sun = max(0.0, math.sin(2 * math.pi * ((hours - lng / 15.0) / 24.0 - 0.25)))
        charge = min(1.0, max(0.0, charge + (CHARGE * sun - DRAW) * dt_min / 60.0))


def routes(runs: DataFrame, nav: NavMap, hug_km: float | None = None, **options) -> DataFrame:
    """Routes of runs(run, start_lat, start_lng, end_lat, end_lng); one that can't start is a single row, ended illegal."""
    held = runs.sparkSession.sparkContext.broadcast(nav)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROUTE.split(", ")]
        for batch in batches:
            for r in batch.itertuples():
                start, goal = (r.start_lat, r.start_lng), (r.end_lat, r.end_lng)
                if held.value.legal(*start):
                    rows = [(r.run, *row) for row in route(held.value, start, goal, hug_km, **options)]
                else:
                    rows = [(r.run, 0, *start, 0.0, FIRST_BATTERY, math.nan, 1, "illegal")]
                yield pd.DataFrame(rows, columns=names)

    return runs.select("run", "start_lat", "start_lng", "end_lat", "end_lng").repartition("run").mapInPandas(one, ROUTE)


def save_map(tree: DataFrame, path: str, header: dict) -> None:
    """The pyramid by level, and its header beside it."""
    tree.write.mode("overwrite").partitionBy("level").parquet(f"{path}/cells")
    tree.sparkSession.createDataFrame([(k, float(v)) for k, v in header.items()], "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    tree = spark.read.parquet(f"{path}/cells").select(F.col("level").cast("int").alias("level"), "row", "col", "lo", "hi", "budget")
    return tree, {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/header").collect()}
