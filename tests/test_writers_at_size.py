"""Files of one piece: written by all executors, byte for byte what the driver wrote from an iterator."""

import json

from geoloom import GeoFrame
from geoloom.sources import sinks


def features(n):
    return [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i / 7, -i / 9]}, "properties": {"name": f'ä "{i}",\n</b>', "n": 1.0 if i % 2 else None}} for i in range(n)]


def test_files_are_those_of_the_iterator(spark, tmp_path):
    geo = GeoFrame(spark).load_data(features(50))
    near = geo.filter_by_radius(0, 0, 500)
    for frame in (geo, near, near.filter("name", "nobody")):
        for kind, old in (("geojson", lambda p: sinks.write_geojson(frame.iterate(), p)), ("csv", lambda p: sinks.write_csv(frame.iterate(), ["name", "n"], p))):
            old(str(tmp_path / f"old.{kind}"))
            if kind == "geojson":
                sinks.write_geojson_rows(frame._sorted(), str(tmp_path / f"new.{kind}"))
            else:
                sinks.write_csv_rows(frame._sorted(), ["name", "n"], f"file://{tmp_path}/new.{kind}")
            assert (tmp_path / f"new.{kind}").read_bytes() == (tmp_path / f"old.{kind}").read_bytes()


def test_files_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    def no(self):
        raise AssertionError("rows on the driver")

    data = features(300)
    data[7]["geometry"] = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    geo = GeoFrame(spark).load_table(GeoFrame(spark).load_data(data).feature_table())
    assert geo.get_features() == data
    monkeypatch.setattr(GeoFrame, "iterate", no)
    geo.map(tmp_path / "m.html")
    items = (tmp_path / "m.html").read_text().split("const items = [\n")[1].split("\n];")[0]
    assert json.loads(f"[{items}]") == data[:7] + data[8:]
    GeoFrame(spark).load_data(data).save(tmp_path / "x.geojson")
    assert json.loads((tmp_path / "x.geojson").read_text()) == {"type": "FeatureCollection", "features": data}
