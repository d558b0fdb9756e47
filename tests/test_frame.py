"""The frame's methods on small files: loading, saving, filters, order, errors."""

import csv
import json
import warnings

import pytest

from geoloom import ColumnNotFoundError, EmptyDatasetError, GeoFrame, GeoloomError, InvalidCoordinateError, InvalidRadiusError, InvalidUnitError, NoDataError, SourceNotFoundError, UnsupportedFormatError
from geoloom.sources.points import detect_columns

CITIES = [
    ("Delhi", "Delhi", 32900000, 28.6139, 77.2090), ("Mumbai", "Maharashtra", 20700000, 19.0760, 72.8777), ("Bangalore", "Karnataka", 13200000, 12.9716, 77.5946), ("Kolkata", "West Bengal", 14900000, 22.5726, 88.3639),
    ("Chennai", "Tamil Nadu", 11300000, 13.0827, 80.2707), ("Pune", "Maharashtra", 7400000, 18.5204, 73.8567), ("Hyderabad", "Telangana", 10500000, 17.3850, 78.4867),
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "cities.csv"
    with open(p, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([("name", "state", "population", "latitude", "longitude"), *CITIES])
    return p


@pytest.fixture(scope="module")
def geo(spark, path):
    return GeoFrame(spark).load(path)


def feature(lng=77.2, lat=28.6, kind="Point", coordinates=None, **properties):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates or [lng, lat]}, "properties": properties}


def load_text(spark, tmp_path, text, name="x.csv", **kw):
    p = tmp_path / name
    p.write_bytes(text.encode() if isinstance(text, str) else text)
    return GeoFrame(spark).load(p, **kw)


def test_load(geo):
    assert geo.count() == len(geo) == 7
    first = geo.get_features()[0]
    assert first == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [77.209, 28.6139]}, "properties": {"name": "Delhi", "state": "Delhi", "population": "32900000"}}
    assert "GeoFrame" in repr(geo)


def test_csv_parity(spark, tmp_path):
    text = '﻿name,lat,note,lon\r\n"A, ""a""",1,"two\nlines",2\r\n\r\nB,3\r\nC,5,x,6,extra\r\nD,,x,7\r\n'
    rows = load_text(spark, tmp_path, text).get_features()
    assert [(f["properties"]["name"], f["properties"]["note"], f["geometry"]["coordinates"]) for f in rows] == [('A, "a"', "two\nlines", [2.0, 1.0]), ("C", "x", [6.0, 5.0])]
    rows = load_text(spark, tmp_path, "lat,LAT,lon,name,name\n1,2,3,a,b\n").get_features()
    assert rows[0]["geometry"]["coordinates"] == [3.0, 2.0] and rows[0]["properties"] == {"lat": "1", "name": "b"}


def test_csv_numbers(spark, tmp_path):
    with pytest.warns(UserWarning, match="2 rows"):
        geo = load_text(spark, tmp_path, "lat,lng,n\nabc,1,a\n1_0,2,b\n1.0d,3,c\n,4,d\n 5 ,6,e\n")
    assert [f["geometry"]["coordinates"] for f in geo.get_features()] == [[2.0, 10.0], [6.0, 5.0]]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        load_text(spark, tmp_path, "lat,lng\n1,2\n,\n")  # blanks are left out without a word
    for bad in ("95,1", "1,nan", "inf,1"):
        with pytest.raises(InvalidCoordinateError):
            load_text(spark, tmp_path, f"lat,lng\n1,1\n{bad}\n")
    with pytest.warns(UserWarning):
        assert load_text(spark, tmp_path, "lat,lng\n1,1\nx,200\n").count() == 1


def test_csv_columns(spark, tmp_path):
    text = "city,ycoord,xcoord\na,1,2\n"
    assert load_text(spark, tmp_path, text, lat_col="ycoord", lng_col="xcoord").get_features()[0]["properties"] == {"city": "a"}
    with pytest.raises(ColumnNotFoundError, match="city"):
        load_text(spark, tmp_path, text, lat_col="ycoord")
    with pytest.raises(EmptyDatasetError):
        load_text(spark, tmp_path, text, lat_col="no", lng_col="such")
    for empty in ("", "latitude,longitude,name\n"):
        with pytest.raises(EmptyDatasetError):
            load_text(spark, tmp_path, empty)
    assert detect_columns(["Y", "LON", "lat"]) == ("lat", "LON")
    with pytest.raises(ColumnNotFoundError, match="latitude"):
        detect_columns(["id", "name"])
    assert "(+3 more)" in str(ColumnNotFoundError("x", map(str, range(13))))


def test_sources_that_are_none(spark, tmp_path):
    with pytest.raises(SourceNotFoundError, match="spelling"):
        GeoFrame(spark).load("/no/such/file.csv")
    with pytest.raises(UnsupportedFormatError):
        load_text(spark, tmp_path, "x", "x.xlsx")
    for text in ("{", "[]", '{"type": "Point", "coordinates": [1, 2]}'):
        with pytest.raises(UnsupportedFormatError):
            load_text(spark, tmp_path, text, "x.geojson")
    with pytest.raises(EmptyDatasetError):
        GeoFrame(spark).load_data([])
    for text in ('{"type": "FeatureCollection"}', '{"type": "FeatureCollection", "features": []}'):
        geo = load_text(spark, tmp_path, text, "x.json")
        assert geo.count() == 0
        with pytest.raises(NoDataError):
            geo.bounds()


def test_geojson(spark, tmp_path):
    fs = [feature(77.2, 28.6, name="Delhi", pop=1.0, ok=True, none=None), feature(coordinates=[72.8, 19.0, 12.5], name="Mumbai", pop=1), feature(kind="Polygon", coordinates=[[[0, 0], [1, 0], [1, 1], [0, 0]]], name="É")]
    geo = load_text(spark, tmp_path, "﻿" + json.dumps({"type": "FeatureCollection", "name": "x", "features": fs}, indent=1), "x.geojson")
    assert geo.get_features() == fs and geo.get_geojson()["features"] == fs
    assert [geo.filter(*x).count() for x in (("pop", 1.0), ("pop", 1), ("pop", "1.0 "), ("ok", True), ("none", None), ("none", ""), ("name", " é"))] == [1, 1, 1, 1, 1, 2, 1]
    with pytest.raises(ColumnNotFoundError):
        geo.filter("missing", 1)
    with pytest.raises(GeoloomError, match="point"):
        geo.bounds()
    assert geo.filter("name", "mumbai").bounds() == {"min_lat": 19.0, "max_lat": 19.0, "min_lng": 72.8, "max_lng": 72.8}
    one = load_text(spark, tmp_path, json.dumps(fs[0]), "one.json")
    assert one.get_features() == fs[:1] and one.nearest((0, 0))["feature"] == fs[0]
    assert load_text(spark, tmp_path, json.dumps({"type": "FeatureCollection", "features": [feature(a="ü")]}).encode("latin-1"), "l.json", encoding="latin-1").count() == 1


def test_filter(geo, spark, tmp_path):
    assert geo.filter("state", "maharashtra").count() == geo.filter("state", " MAHARASHTRA　").count() == 2
    assert geo.filter("population", 32900000).count() == 1
    assert geo.filter("state", "Maharashtra").filter("name", "pune").count() == 1
    none = geo.filter("state", "none such")
    assert none.count() == 0
    for call in (none.get_features, none.bounds, none.heatmap, lambda: none.nearest((0, 0)), lambda: none.filter("state", "x"), lambda: none.save("/tmp/x.csv"), lambda: none.filter_by_radius(0, 0, 1)):
        with pytest.raises(NoDataError):
            call()
    with pytest.raises(ColumnNotFoundError, match="state"):
        geo.filter("nonexistent", "value")
    blank = load_text(spark, tmp_path, "lat,lng,a\n1,1,\n2,2,x\n")
    assert blank.filter("a", "").count() == 1 and blank.get_features()[0]["properties"] == {"a": ""}


def test_radius(geo):
    near = geo.filter_by_radius(28.61, 77.20, 400)
    assert [f["properties"]["_distance"] for f in near.get_features()] == [0.9797]
    every = geo.filter_by_radius(28.61, 77.20, 3000).get_features()
    assert [(f["properties"]["name"], f["properties"]["_distance"]) for f in every] == [("Delhi", 0.9797), ("Mumbai", 1147.349), ("Pune", 1172.3174), ("Hyderabad", 1255.0599), ("Kolkata", 1304.4011), ("Bangalore", 1739.3926), ("Chennai", 1755.5424)]
    pune = geo.filter("state", "Maharashtra").filter_by_radius(18.52, 73.85, 200)
    assert [(f["properties"]["name"], f["properties"]["_distance"]) for f in pune.get_features()] == [("Pune", 0.7078), ("Mumbai", 119.5712)]
    twice = geo.filter_by_radius(28.61, 77.20, 1300).filter_by_radius(18.52, 73.85, 700)
    assert [f["properties"]["name"] for f in twice.get_features()] == ["Pune", "Mumbai", "Hyderabad"]
    assert twice.property_names() == ["name", "state", "population", "_distance"]
    assert geo.filter_by_radius(28.61, 77.20, 1, "mi").count() == geo.filter_by_radius(28.61, 77.20, 3300, "ft").count() == 1
    assert geo.filter_by_radius(28.61, 77.20, 0.9797).count() == 1 and geo.filter_by_radius(28.61, 77.20, 0.9796).count() == 0
    with pytest.raises(InvalidRadiusError):
        geo.filter_by_radius(28.61, 77.20, 0)
    with pytest.raises(InvalidCoordinateError):
        geo.filter_by_radius(95, 0, 1)
    with pytest.raises(InvalidUnitError):
        geo.filter_by_radius(1, 0, 1, "cubits")
    with pytest.raises(ColumnNotFoundError):
        geo.filter("_distance", 1)
    assert near.filter("_distance", 0.9797).count() == 1


def test_ties_keep_their_order(spark):
    geo = GeoFrame(spark).load_data([feature(0, 1, n=i) for i in range(30)] + [feature(0, 0.5, n=30)])
    assert [f["properties"]["n"] for f in geo.filter_by_radius(0, 0, 500).get_features()] == [30, *range(30)]
    assert geo.filter("n", 3).nearest((0, 0))["index"] == 0
    assert geo.nearest((5, 0))["index"] == 0
    again = geo.filter_by_radius(0, 0, 500).filter_by_radius(1, 0.0, 500)
    assert [f["properties"]["n"] for f in again.get_features()] == [*range(30), 30]
    best = geo.filter_by_radius(0, 0, 500).nearest((5, 0))
    assert best["index"] == 1 and best["feature"]["properties"]["n"] == 0 and best["feature"]["properties"]["_distance"] == 111.1951


def test_nearest(geo):
    best = geo.nearest((19.0, 73.0))
    assert best["feature"]["properties"]["name"] == "Mumbai" and best["index"] == 1 and best["distance"] == geo.distance((19.0, 73.0), (19.0760, 72.8777))
    assert geo.filter_by_radius(28.61, 77.20, 3000).nearest((13, 80))["index"] == 6
    assert [f["properties"]["name"] for f in geo.nearest_k((19.0, 73.0), 2, "mi").get_features()] == ["Mumbai", "Pune"]
    with pytest.raises(InvalidCoordinateError):
        geo.nearest((100, 0))


def test_bounds_and_zones(geo):
    assert geo.bounds() == {"min_lat": 12.9716, "max_lat": 28.6139, "min_lng": 72.8777, "max_lng": 88.3639}
    assert geo.centroid()[0] == pytest.approx(sum(c[3] for c in CITIES) / 7)
    assert [f["properties"]["name"] for f in geo.in_zone(geo.buffer((18.8, 73.3), 100)).get_features()] == ["Mumbai", "Pune"]


def test_save(geo, spark, tmp_path):
    assert geo.save(tmp_path / "deep" / "a.geojson") is geo
    again = GeoFrame(spark).load(tmp_path / "deep" / "a.geojson")
    assert again.get_features() == geo.get_features()
    near = again.filter_by_radius(28.61, 77.20, 1200)
    near.save(tmp_path / "b.csv")
    assert (tmp_path / "b.csv").read_text().splitlines()[0] == "latitude,longitude,name,state,population,_distance"
    back = GeoFrame(spark).load(tmp_path / "b.csv").get_features()
    assert [f["properties"]["_distance"] for f in back] == ["0.9797", "1147.349", "1172.3174"]
    with pytest.raises(UnsupportedFormatError):
        geo.save(tmp_path / "new" / "x.shp")
    assert not (tmp_path / "new").exists()
    geo.save_lines(str(tmp_path / "lines"))
    assert sorted(json.loads(x)["properties"]["name"] for p in (tmp_path / "lines").glob("*.txt") for x in p.read_text().splitlines()) == sorted(c[0] for c in CITIES)


def test_save_union_of_keys(spark, tmp_path):
    GeoFrame(spark).load_data([feature(1, 2, b="ü", latitude="x"), feature(3, 4, a=1, b=None)]).save(tmp_path / "x.csv")
    with open(tmp_path / "x.csv", newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["latitude", "longitude", "b", "properties.latitude", "a"], ["2", "1", "ü", "x", ""], ["4", "3", "", "", "1"]]


def test_maps(geo, spark, tmp_path):
    assert geo.map(tmp_path / "m.html", title="<b>T</b>", center=(1, 2)) is geo and geo.heatmap(tmp_path / "h.html", intensity_col="population") is geo
    page = (tmp_path / "m.html").read_text()
    assert "<html" in page and "leaflet" in page and "Kolkata" in page and "<b>T</b>" not in page and "setView([1.0, 2.0]" in page
    bad = GeoFrame(spark).load_data([feature(1, 2, x="</script><script>alert(1)</script>"), feature(kind="LineString", coordinates=[[0, 0], [1, 1]], x="hidden")])
    bad.map(tmp_path / "e.html")
    text = (tmp_path / "e.html").read_text()
    assert "</script><script>alert" not in text and "hidden" not in text
    assert "<html" in (tmp_path / "h.html").read_text()


def test_heat(geo, spark):
    heat = {(r["lat"], r["lng"]): r["intensity"] for r in geo.heat_points("population").collect()}
    assert heat == {(c[3], c[4]): c[2] / 32900000 for c in CITIES}
    assert {r["intensity"] for r in geo.heat_points().collect()} == {r["intensity"] for r in geo.heat_points("none such").collect()} == {1.0}
    odd = GeoFrame(spark).load_data([feature(v="nan"), feature(v="x"), feature(v=4), feature(), feature(v=-2)])
    got = [r["intensity"] for r in odd.heat_points("v").orderBy("_ord").collect()]
    assert got[1:] == [0.25, 1.0, 0.25, -0.5] and got[0] != got[0]


def test_from_table(spark):
    df = spark.createDataFrame([(2, 1.5, "x"), (1, 2.5, None)], "id long, v double, s string").selectExpr("*", "cast(id as double) as lat", "cast(id * 2 as double) as lng")
    geo = GeoFrame(spark).from_table(df, order="id")
    assert [f["properties"] for f in geo.get_features()] == [{"id": 1, "v": 2.5, "s": None}, {"id": 2, "v": 1.5, "s": "x"}]
    assert geo.filter("v", 1.5).count() == geo.filter("v", "1.50").count() == geo.filter("id", 1).count() == geo.filter("s", "").count() == 1
    with pytest.raises(ValueError, match="rename"):
        GeoFrame(spark).from_table(df.withColumn("_ord", df.id))
