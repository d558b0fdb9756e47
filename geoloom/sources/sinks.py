"""Writers: GeoJSON and CSV as one file in order, GeoJSON lines by all executors, and HTML maps.

The rows of a single file are rendered by all executors, into parts in the shared folder; the driver's JVM then copies the
bytes of one part after the other, so no row is sent to the driver. Files in another encoding than UTF-8 are written on the
driver from an iterator over the ordered rows. ``write_lines`` is the way for data that should not become one file.
"""

from __future__ import annotations

import codecs
import csv
import html
import io
import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFormatError
from ..plans.shared import shared_dir

LEAFLET, HEAT = "https://unpkg.com/leaflet@1.9.4/dist", "https://unpkg.com/leaflet.heat@0.2.0/dist/leaflet-heat.js"


class HadoopFile(io.RawIOBase):
    """A new file at any URI that Spark can write to, as a stream of bytes."""

    def __init__(self, uri: str) -> None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        where = spark._jvm.org.apache.hadoop.fs.Path(uri)
        self.out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


def open_text(path: str, encoding: str = "utf-8", newline: str | None = None):
    """A text file on the driver's disk or, with a scheme, wherever Spark can write."""
    if "://" in path or path.startswith("file:"):
        return io.TextIOWrapper(io.BufferedWriter(HadoopFile(path), 1 << 20), encoding=encoding, newline=newline)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "w", encoding=encoding, newline=newline)


def is_utf8(encoding: str) -> bool:
    return codecs.lookup(encoding).name == "utf-8"


def write_ordered(rows: DataFrame, render: Callable[[dict], str | None], path: str, head: str, between: str, tail: str, before: str = "", closed: bool = False) -> int:
    """One file: ``head``, what ``render`` makes of the rows in their order (rows of which it makes None are left out), ``tail``; how many.

    ``before`` precedes the first text, ``between`` stands between two and, if ``closed``, also behind the last.
    """

    def rendered(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([t for row in batch.to_pylist() for t in [render(row)] if t is not None], pa.string())], names=["value"])

    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts, seen = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}", Observation()
    rows.mapInArrow(rendered, "value string").observe(seen, F.count("*").alias("n")).write.option("lineSep", between).option("compression", "none").text(parts)
    there = jvm.org.apache.hadoop.fs.Path(parts)
    store = there.getFileSystem(conf)
    try:
        found = sorted((int(f.getPath().getName().split("-")[1]), f.getLen(), f.getPath()) for f in store.listStatus(there) if f.getPath().getName().startswith("part-") and f.getLen())
        if "://" in path or path.startswith("file:"):
            where = jvm.org.apache.hadoop.fs.Path(path)
            out = where.getFileSystem(conf).create(where, True)
        else:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            out = jvm.java.io.BufferedOutputStream(jvm.java.io.FileOutputStream(os.path.abspath(path)), 1 << 20)
        try:
            out.write(bytearray((head + (before if found else "")).encode()))
            for k, (_, size, part) in enumerate(found):
                more = size - (0 if closed or k < len(found) - 1 else len(between.encode()))
                into = store.open(part)
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(into, out, 0, more)
                finally:
                    into.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
    finally:
        store.delete(there, True)
    return seen.get["n"] if found else 0


def feature(row: dict) -> dict:
    """The GeoJSON Feature of a row with ``geometry_json``, ``properties_json`` and perhaps ``_distance``."""
    own = json.loads(row["properties_json"]) if row["properties_json"] is not None else {}
    if "_distance" in row:
        own["_distance"] = row["_distance"]
    return {"type": "Feature", "geometry": json.loads(row["geometry_json"] or "null"), "properties": own}


def extension(path: str) -> str:
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".csv", ".geojson", ".json"):
        raise UnsupportedFormatError(kind)
    return kind


GEOJSON = ('{\n  "type": "FeatureCollection",\n  "features": [', "\n    ", "\n  ]\n}")


def _indented(x: dict) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n    ")


def write_geojson(features: Iterable[dict], path: str, encoding: str = "utf-8") -> None:
    with open_text(path, encoding) as f:
        f.write(GEOJSON[0])
        for k, x in enumerate(features):
            f.write(("," if k else "") + GEOJSON[1] + _indented(x))
        f.write(GEOJSON[2])


def write_geojson_rows(rows: DataFrame, path: str) -> None:
    write_ordered(rows, lambda row: _indented(feature(row)), path, GEOJSON[0], "," + GEOJSON[1], GEOJSON[2], before=GEOJSON[1])


def csv_header(keys: list[str]) -> list[str]:
    """Properties that are called like the coordinates get a prefix, so that both survive."""
    return ["latitude", "longitude", *(f"properties.{k}" if k in ("latitude", "longitude") else k for k in keys)]


def _csv(cells: list) -> str:
    """A row of CSV, without its line end."""
    text = io.StringIO()
    csv.writer(text, lineterminator="").writerow(cells)
    return text.getvalue()


def _cells(x: dict, keys: list[str]) -> list:
    lng, lat = x["geometry"]["coordinates"][:2]
    own = x.get("properties") or {}
    return [lat, lng, *("" if own.get(k) is None else own[k] for k in keys)]


def write_csv(features: Iterable[dict], keys: list[str], path: str, encoding: str = "utf-8") -> None:
    with open_text(path, encoding, "") as f:
        out = csv.writer(f)
        out.writerow(csv_header(keys))
        for x in features:
            out.writerow(_cells(x, keys))


def write_csv_rows(rows: DataFrame, keys: list[str], path: str) -> None:
    write_ordered(rows, lambda row: _csv(_cells(feature(row), keys)), path, _csv(csv_header(keys)) + "\r\n", "\r\n", "", closed=True)


def write_lines(df: DataFrame, path: str) -> None:
    """One GeoJSON feature a line, written by all executors. ``df`` has ``geometry_json`` and ``properties_json``."""
    line = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry_json", F.lit("null")), F.lit(',"properties":'), F.coalesce("properties_json", F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.text(path)


def script_json(x) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(x, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def _page(title: str, more: str, script: str) -> tuple[str, str]:
    """What stands before the items of a map, and behind them."""
    head = f"""<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>{html.escape(title)}</title>
<link rel="stylesheet" href="{LEAFLET}/leaflet.css">
<style>html, body, #view {{ height: 100%; margin: 0 }} #title {{ position: absolute; z-index: 1000; left: 60px; top: 10px; padding: 6px 10px; background: #fff; font: 14px sans-serif }}</style>
<script src="{LEAFLET}/leaflet.js"></script>{more}
</head>
<body>
<div id="view"></div><div id="title">{html.escape(title)}</div>
<script>
const items = [
"""
    return head, f"""
];
const view = L.map("view");
L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png", {{attribution: "&copy; OpenStreetMap contributors"}}).addTo(view);
{script}
</script>
</body>
</html>
"""


def _look(center, zoom: int, spots: str) -> str:
    if center is not None:
        return f"view.setView([{float(center[0])}, {float(center[1])}], {int(zoom)});"
    return f"const spots = {spots}; spots.length ? view.fitBounds(spots, {{maxZoom: {max(int(zoom), 1) + 8}}}) : view.setView([0, 0], {int(zoom)});"


MARKERS = """
for (const f of items) {
  const p = document.createElement("table");
  for (const [k, v] of Object.entries(f.properties || {})) if (!k.startsWith("_")) {
    const row = p.insertRow(); row.insertCell().textContent = k; row.insertCell().textContent = typeof v === "object" ? JSON.stringify(v) : v;
  }
  L.marker([f.geometry.coordinates[1], f.geometry.coordinates[0]]).bindPopup(p).addTo(view);
}
"""


def _marker(row: dict) -> str | None:
    f = feature(row)
    return script_json(f) if (f.get("geometry") or {}).get("type") == "Point" else None


def write_map(rows: DataFrame, path: str, title: str, zoom: int, center=None) -> int:
    """Markers of the point features, with their properties (but those that begin with ``_``) as popups; how many."""
    head, tail = _page(title, "", _look(center, zoom, "items.map(f => [f.geometry.coordinates[1], f.geometry.coordinates[0]])") + MARKERS)
    return write_ordered(rows, _marker, path, head, ",\n", tail)


def _heat(row: dict) -> str:
    return json.dumps([row["lat"], row["lng"], row["intensity"]]).replace("NaN", "null")


def write_heatmap(rows: DataFrame, path: str, title: str, zoom: int, center=None) -> int:
    """A heat layer of the rows' lat, lng and intensity; how many points."""
    script = _look(center, zoom, "items.map(p => [p[0], p[1]])") + "\nL.heatLayer(items, {radius: 25}).addTo(view);"
    head, tail = _page(title, f'\n<script src="{HEAT}"></script>', script)
    return write_ordered(rows, _heat, path, head, ",\n", tail)
