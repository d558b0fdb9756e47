import json

import pytest

import geoloom
from geoloom import GeoFrame, SourceNotFoundError, UnsupportedFormatError
from geoloom.operators import joins
from geoloom.sources import points


def frame(spark, rows, key="k"):
    return spark.createDataFrame([(0, a, b, k) for a, b, k in rows], f"_ord long, _lat double, _lng double, {key} string")


def test_every_row_has_its_nearest_centers(spark):
    left = frame(spark, [(10.0, 10.0, "a"), (-40.0, 100.0, "a"), (10.0, 10.0, None), (50.0, -120.0, None), (None, None, "b"), (10.0, 10.0, "a")])
    right = frame(spark, [(11.0, 11.0, "x"), (-41.0, 101.0, "y"), (51.0, -121.0, "z")], "c")
    got = sorted(((r["k"], r["c"], r["rank"]) for r in joins.knn_join(left, "k", right, "c", 1).collect()), key=repr)
    assert got == sorted([("a", "x", 1), ("a", "y", 1), (None, "x", 1), (None, "z", 1), ("a", "x", 1)], key=repr)
    # more neighbours than there are centers: the whole globe is one cell, dealt out by place
    assert joins.knn_join(left, "k", right, "c", 5).count() == 15


def test_names_that_clash(spark):
    a = frame(spark, [(0.0, 0.0, "a")])
    with pytest.raises(ValueError):
        joins.radius_join(a, a, 5)
    assert joins.radius_join(a, a, 5, how="left_semi").count() == 1
    zone = spark.sql("select 'z' as K, array(named_struct('lng', -1D, 'lat', -1D), named_struct('lng', 1D, 'lat', -1D), named_struct('lng', 0D, 'lat', 2D)) as ring")
    with pytest.raises(ValueError):
        joins.zone_join(a, zone)


def test_zone_semi_and_anti_without_order(spark):
    df = frame(spark, [(0.0, 0.0, "in"), (0.0, 0.0, "in too"), (5.0, 5.0, "out"), (None, 1.0, "nowhere")])
    ring = "array(named_struct('lng', -1D, 'lat', -1D), named_struct('lng', 1D, 'lat', -1D), named_struct('lng', 0D, 'lat', 2D))"
    zones = spark.sql(f"select {ring} as ring union all select transform({ring}, p -> named_struct('lng', p.lng * 40, 'lat', p.lat * 0.1)) as ring")
    assert sorted(r["k"] for r in joins.zone_join(df, zones, how="left_semi").collect()) == ["in", "in too"]
    assert sorted(r["k"] for r in joins.zone_join(df, zones, how="left_anti").collect()) == ["nowhere", "out"]


def feature(i, kind="Point"):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": [i, i]}, "properties": {"i": i}}


def test_geojson_lines_and_text_behind_a_document(spark, tmp_path):
    lines = tmp_path / "lines.geojson"
    lines.write_text("﻿" + "\n".join(json.dumps(feature(i)) for i in range(3)) + "\n\n")
    df = points.read_points(spark, str(lines))
    assert [(r["_lat"], r["properties"]["i"]) for r in df.orderBy("_ord").collect()] == [(0.0, "0"), (1.0, "1"), (2.0, "2")]
    for text in (json.dumps(feature(1)) + "\nrubbish", json.dumps(feature(1)) + "\n" + json.dumps({"type": "FeatureCollection", "features": [feature(2)]})):
        bad = tmp_path / "bad.geojson"
        bad.write_text(text)
        with pytest.raises(UnsupportedFormatError):
            points.read_points(spark, str(bad)).collect()
    for k, text in enumerate((json.dumps(feature(4)) + "\n", json.dumps({"type": "FeatureCollection", "features": [feature(4)]}, indent=1) + "\n \n", json.dumps({"type": "FeatureCollection", "features": [feature(4)]}) + "\n")):
        fine = tmp_path / f"fine{k}.geojson"
        fine.write_text(text)
        assert points.read_points(spark, str(fine)).count() == 1


def test_lines_and_splittable_csv_take_many_tasks(spark, tmp_path):
    lines, table = tmp_path / "many.geojson", tmp_path / "many.csv"
    lines.write_text("\n".join(json.dumps(feature(i % 90)) for i in range(4000)))
    table.write_text("lat,lng,name\n" + "\n".join(f"{i % 90},{i % 180},n{i}" for i in range(9000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 32768)
    try:
        assert points.read_points(spark, str(lines)).rdd.getNumPartitions() > 4
        assert GeoFrame(spark).load(str(table), splittable=True).df.rdd.getNumPartitions() > 2
        assert GeoFrame(spark).load(str(table), splittable=True).count() == GeoFrame(spark).load(str(table)).count() == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_files(spark):
    assert geoloom.FileNotFoundError is SourceNotFoundError and issubclass(SourceNotFoundError, FileNotFoundError)
    with pytest.raises(FileNotFoundError):
        GeoFrame(spark).load("/nowhere/x.csv")


def test_saving_to_a_uri(spark, tmp_path):
    data = [feature(i) for i in range(5)]
    for name in ("x.geojson", "x.csv"):
        GeoFrame(spark).load_data(data).save(f"file://{tmp_path}/deep/{name}")
        assert GeoFrame(spark).load(f"{tmp_path}/deep/{name}").count() == 5
    GeoFrame(spark).load_data(data).map(f"file://{tmp_path}/deep/m.html", "Ä").heatmap(f"file://{tmp_path}/deep/h.html")
    assert "Ä" in (tmp_path / "deep/m.html").read_text(encoding="utf-8")
