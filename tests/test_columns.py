"""Column functions against the scalar ones, plans, SQL functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, scalar
from geoloom.operators import filters, joins
from geoloom.sources.points import from_table, parse_float

random.seed(5)
POINTS = [(i, round(random.uniform(-90, 90), 4), round(random.uniform(-180, 180), 4)) for i in range(300)] + [(300, 90.0, 0.0), (301, -90.0, 10.0), (302, 0.0, 180.0), (303, 0.0, -180.0), (304, 89.99, -179.0)]


@pytest.fixture(scope="module")
def df(spark):
    return from_table(spark.createDataFrame(POINTS, "id long, lat double, lng double"), order="id").withColumn("id", F.col("_ord")).cache()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions(df):
    rows = df.select("id", *(geo.distance(10.5, -20.25, "_lat", "_lng", u).alias(u) for u in ("km", "mi", "m", "ft")), geo.bearing(10.5, -20.25, "_lat", "_lng").alias("deg")).withColumn("compass", geo.compass("deg")).collect()
    for r, (_, lat, lng) in zip(sorted(rows), POINTS):
        for u in ("km", "mi"):
            assert r[u] == pytest.approx(scalar.distance((10.5, -20.25), (lat, lng), u), abs=1.01e-4)
        assert r["deg"] == pytest.approx(scalar.bearing((10.5, -20.25), (lat, lng), True), abs=0.0101)
        assert r["compass"] == scalar.compass(r["deg"])


def test_half_even_compass(spark):
    deg = [11.25, 33.75, 56.25, 348.75, 360.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(deg)], "i int, d double").orderBy("i").select(geo.compass("d")).collect()]
    assert got == [scalar.compass(d) for d in deg] == ["North", "Northeast", "Northeast", "North", "North", "North"]


def test_ring(df):
    rows = df.where("id < 20").select("id", geo.buffer_ring("_lat", "_lng", 120.0, "km", 16).alias("r")).collect()
    for r in rows:
        want = scalar.circle(POINTS[r["id"]][1:], 120.0, 16)
        assert len(r["r"]) == 17 and r["r"][0] == r["r"][-1]
        for p, (x, y) in zip(r["r"], want):
            assert p["lng"] == pytest.approx(x, abs=1e-6) and p["lat"] == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("ring", [[[-60, -40], [70, -40], [70, 50], [-60, 50]], [[0, 60], [25, 20], [80, 10], [30, -10], [0, 60]], [[0, 0]], []])
def test_in_ring(df, ring):
    lit = geo.literal_ring(ring) if ring else F.array().cast("array<struct<lng:double,lat:double>>")
    got = {r[0] for r in df.where(geo.in_ring("_lat", "_lng", lit)).select("id").collect()}
    assert got == {i for i, lat, lng in POINTS if ring and scalar.in_ring(lat, lng, ring)}


def test_valid(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (90.0, -180.0), (90.1, 0.0), (math.nan, 0.0), (None, 0.0), (0.0, math.inf)], "a double, b double")
    assert [r[0] for r in rows.select(geo.is_valid("a", "b")).collect()] == [True, True, False, False, False, False]


@pytest.mark.parametrize("center, radius", [((10.0, 179.5), 3000), ((-10.0, -179.9), 500), ((89.5, 0.0), 400), ((-89.9, 20.0), 3000), ((0.0, 0.0), 19000), ((45.0, 7.0), 0.001), ((28.0, 77.0), 5000)])
def test_radius_box_loses_nothing(df, center, radius):
    got = {r["id"]: r["_distance"] for r in filters.within_radius(df, center, radius).collect()}
    assert got.keys() == {i for i, lat, lng in POINTS if scalar.distance(center, (lat, lng)) <= radius}
    assert list(got.values()) == sorted(got.values())


def test_plans(spark, tmp_path):
    spark.createDataFrame(POINTS, "id long, lat double, lng double").withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    near = filters.within_radius(from_table(table, order="id"), (10.0, 10.0), 500).select("_ord", "_distance")
    text = plan(near)
    assert "GreaterThanOrEqual(lat" in text and "more" not in text and "Python" not in text
    assert "TakeOrderedAndProject" in plan(filters.nearest(from_table(table, order="id"), (1.0, 2.0)))
    other = from_table(table.select(F.col("id").alias("other"), "lat", "lng"), order="other").withColumn("other", F.col("_ord"))
    text = plan(joins.radius_join(from_table(table, order="id"), other, 100))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("radius, unit", [(300, "km"), (2500, "km"), (9000, "km"), (30, "mi"), (20016, "km")])
def test_radius_join_is_the_full_join(df, radius, unit):
    left = df.where("id % 2 = 0 or id > 299")
    right = df.where("id % 3 = 0 or id > 299").select("_ord", "_lat", "_lng", F.col("id").alias("other"))
    got = {(r["id"], r["other"]) for r in joins.radius_join(left, right, radius, unit).collect()}
    want = {(i, j) for i, a, b in POINTS if i % 2 == 0 or i > 299 for j, c, d in POINTS if j % 3 == 0 or j > 299 if scalar.distance((a, b), (c, d), unit) <= radius}
    assert got == want
    semi = {r["id"] for r in joins.radius_join(left, right, radius, unit, "left_semi").collect()}
    assert semi == {i for i, _ in want}


def test_zone_join_is_the_full_join(df):
    sizes = [20.0, 300.0, 1500.0, 5000.0]
    zones = df.where("id % 5 = 0").withColumn("r", F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % 4 + 1).cast("int")))
    zones = zones.select(F.col("id").alias("zone"), geo.buffer_ring("_lat", "_lng", "r", num_points=12).alias("ring")).cache()
    got = {(r["id"], r["zone"]) for r in joins.zone_join(df, zones).collect()}
    rings = {r["zone"]: [(p["lng"], p["lat"]) for p in r["ring"]] for r in zones.collect()}
    want = {(i, z) for i, lat, lng in POINTS for z, ring in rings.items() if scalar.in_ring(lat, lng, ring)}
    assert got == want and len(want) > 50
    assert {r["id"] for r in joins.zone_join(df, zones, how="left_anti").collect()} == {i for i, *_ in POINTS} - {i for i, _ in want}


def test_knn_join_is_the_full_join(df):
    right = df.where("id % 7 = 0").select("_ord", "_lat", "_lng", F.col("id").alias("other"))
    got = {(r["id"], r["rank"]): r["other"] for r in joins.knn_join(df, "id", right, "other", 3).collect()}
    for i, lat, lng in POINTS:
        best = sorted((scalar.distance((lat, lng), (c, d)), j) for j, c, d in POINTS if j % 7 == 0)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in best]


def test_knn_with_fewer_centers_than_k(df):
    right = df.where("id < 2").select("_ord", "_lat", "_lng", F.col("id").alias("other"))
    assert joins.knn_join(df, "id", right, "other", 3).count() == 2 * len(POINTS)


def test_parse_float(spark):
    said = {"1": 1.0, " 2.5\t": 2.5, "1_000": 1000.0, "1e3": 1000.0, "-.5": -0.5, "5.": 5.0, "1.0d": None, "0x1p3": None, "abc": None, "": None, "　 7": 7.0, "1__0": None, "inf": math.inf}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", parse_float(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == said


def test_sql_functions(spark):
    geo.register(spark)
    row = spark.sql("SELECT geo_distance_km(28.6139, 77.2090, 19.0760, 72.8777), geo_bearing(28.6139, 77.2090, 19.0760, 72.8777), geo_compass(203.47), geo_is_valid(95, 0)").first()
    assert tuple(row) == (1148.0965, 203.47, "South-Southwest", False)
    row = spark.sql("SELECT geo_distance(28.6139, 77.2090, 19.0760, 72.8777, 'Miles'), geo_distance(28.6139, 77.2090, 19.0760, 72.8777, 'ft'), geo_distance(0, 0, 1, 1, 'cubits')").first()
    assert tuple(row) == (713.3938, 3766720.7861, None)


@pytest.mark.parametrize("ring", [[[-60, -40], [70, -40], [70, 50], [-60, 50]], [[0, 60], [25, 20], [80, 10], [30, -10], [0, 60]]])
def test_sql_in_ring(spark, df, ring):
    geo.register(spark)
    df.select("id", F.col("_lat").alias("y"), F.col("_lng").alias("x"), geo.literal_ring(ring).alias("ring")).createOrReplaceTempView("ring_points")
    got = {r[0] for r in spark.sql("SELECT id FROM ring_points WHERE geo_in_ring(y, x, ring)").collect()}
    assert got == {i for i, lat, lng in POINTS if scalar.in_ring(lat, lng, ring)}
    assert spark.sql("SELECT geo_in_ring(0, 0, cast(array() as array<struct<lng:double,lat:double>>))").first()[0] is False
