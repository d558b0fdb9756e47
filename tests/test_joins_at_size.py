"""Joins on more points and zones: rows against brute force, and how many pairs they form for them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions.geo import distance, in_ring
from geoloom.operators import joins

POINT = "struct<lng:double,lat:double>"


def star(x, y, r, n, rng=None):
    """A ring of n points around a place, jagged with a generator."""
    return [(x + r * k * math.cos(2 * math.pi * i / n), y + r * k * math.sin(2 * math.pi * i / n)) for i in range(n) for k in [rng.uniform(0.2, 1.0) if rng else 1.0]]


def points_at(spark, rows):
    return spark.createDataFrame([(0, a, b, i) for i, (a, b) in enumerate(rows)], "_ord long, _lat double, _lng double, p long")


def zones_of(spark, rings):
    return spark.createDataFrame(list(enumerate(rings)), f"z long, ring array<{POINT}>")


@pytest.fixture(scope="module")
def shapes(spark):
    """Round, jagged, self-crossing, tiny, huge, open, empty and unreadable rings; points on a lattice, on corners of rings, copies and none."""
    rng = random.Random(7)
    rings = [star(rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice([0.5, 5, 20]), 24) for _ in range(12)] + [star(10, 10, 30, 300, rng), star(-50, 0, 40, 90, rng), star(0, 0, 1e-7, 5), star(0, 0, 500, 7)]
    rings += [[(rng.uniform(-90, 90), rng.uniform(-60, 60)) for _ in range(17)] for _ in range(4)]
    rings += [[(-60.0, -40.0), (70.0, -40.0), (70.0, 50.0), (-60.0, 50.0)], [(0.0, 0.0)], [], None, [(0.0, -50.0), (float("nan"), 40.0), (60.0, 20.0), (20.0, -60.0)], [(0.0, -50.0), (30.0, None), (60.0, 20.0), (-20.0, 60.0)], [(-1e9, -50.0), (1e9, 0.0), (0.0, 60.0)]]
    spots = [(lat, lng) for lat in range(-90, 91, 5) for lng in range(-180, 181, 5)] + [(y, x) for r in rings if r for x, y in r if x is not None and y is not None and abs(y) < 1e3]
    spots += [(rng.uniform(-85, 85), rng.uniform(-180, 180)) for _ in range(1500)] + [(10.0, 10.0)] * 30 + [(0.0, 0.0), (1e-8, 1e-8), (None, 1.0), (float("nan"), 5.0), (5.0, float("nan"))]
    pts, zones = points_at(spark, [(None if a is None else float(a), None if b is None else float(b)) for a, b in spots]), zones_of(spark, rings)
    held = pts.crossJoin(zones).where(in_ring("_lat", "_lng", F.col("ring"))).select("p", "z").collect()
    return pts, zones, sorted(map(tuple, held))


def test_zones_hold_what_the_ring_test_says(shapes):
    pts, zones, held = shapes
    assert sorted(map(tuple, joins.zone_join(pts, zones).select("p", "z").collect())) == held


def test_zone_counts_are_those_of_the_pairs(shapes):
    pts, zones, held = shapes
    want = {z: sum(b == z for _, b in held) for _, z in held}
    assert {r["z"]: r["n_points"] for r in joins.zone_counts(pts, zones, "z").collect()} == want


def test_zone_semi_and_anti_at_size(shapes):
    pts, zones, held = shapes
    some = zones.where("z not in (15, 26)")  # those two hold nearly everything
    want = {p for p, z in held if z not in (15, 26)}
    assert 0 < len(want) < pts.count()
    assert sorted(r["p"] for r in joins.zone_join(pts, some, how="left_semi").collect()) == sorted(want)
    assert sorted(r["p"] for r in joins.zone_join(pts, some, how="left_anti").collect()) == sorted({r["p"] for r in pts.collect()} - want)


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(3)
    pts = points_at(spark, [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(20000)])
    return pts, zones_of(spark, [star(rng.uniform(-8, 8), rng.uniform(-8, 8), 10, 24) for _ in range(20)])


def test_zone_counts_form_pairs_at_the_edges_only(crowd, monkeypatch):
    pts, zones = crowd
    met, tested = [], joins._tested
    monkeypatch.setattr(joins, "_tested", lambda *a, **b: met.extend(tested(*a, **b)) or met[-1:])
    total = sum(r["n_points"] for r in joins.zone_counts(pts, zones, "z").collect())
    assert 0 < sum(df.count() for df in met) < total / 3


def test_zone_cells_are_not_broadcast(crowd):
    pts, zones = crowd
    out = joins.zone_join(pts, zones)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(("radius", "unit"), [(800, "km"), (0.5, "m"), (0.00007, "km"), (3000, "miles"), (12000, "km"), (20016, "km"), (1234.5678, "km"), (40_000_000, "ft")])
def test_radius_join_is_the_rounded_distance(spark, radius, unit):
    rng = random.Random(radius)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(90.0, 0.0), (-90.0, 17.0), (0.0, 180.0), (0.0, -180.0), (89.9, -179.9), (float("nan"), 0.0)]
    spots += [(a + rng.uniform(-1, 1) * 10.0**-e, b + rng.uniform(-1, 1) * 10.0**-e) for a, b in spots[:60] for e in (5, 8) if abs(a) < 89]
    a = points_at(spark, spots)
    b = a.select("_lat", "_lng", F.col("p").alias("q"))
    apart = distance("a._lat", "a._lng", "b._lat", "b._lng", unit)
    want = a.alias("a").crossJoin(b.alias("b")).where(apart <= radius).select("p", "q", apart.alias("d"))
    got = joins.radius_join(a, b, radius, unit).select("p", "q", F.col("_distance").alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_radius_join_is_not_left_to_the_tasks_that_read(crowd):
    pts, _ = crowd
    out = joins.radius_join(pts.limit(500), pts.limit(500).select("_lat", "_lng", F.col("p").alias("q")), 100)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
