"""Readers of points: CSV, GeoJSON, features in memory, any table.

Every reader gives a DataFrame with ``_ord`` (the order of the source), ``_lat`` and ``_lng`` (doubles), and the
properties: flat columns for CSV and tables; for GeoJSON ``properties`` (map of strings), ``properties_json`` and
``geometry_json``, since its schema may differ from feature to feature.
"""

from __future__ import annotations

import codecs
import json
import os
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFoundError, EmptyDatasetError, InvalidCoordinateError, SourceNotFoundError, UnsupportedFormatError
from ..functions.geo import is_valid

# Names of coordinate columns, in order of priority.
LAT_NAMES = ("latitude", "lat", "y", "ylat", "lat_deg", "latitude_deg", "geo_lat", "point_lat")
LNG_NAMES = ("longitude", "lng", "lon", "long", "x", "xlong", "lng_deg", "longitude_deg", "geo_lng", "geo_long", "point_lng")

RESERVED = ("_ord", "_lat", "_lng")
#: What Python's float() takes, once white space around it is gone; Java would also take 1.0d or 0x1p3.
NUMBER = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?(e[+-]?\d+(_\d+)*)?|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|nan|inf|infinity)$"


def parse_float(text: Column) -> Column:
    """The double that a text says, else null."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike(NUMBER), F.regexp_replace(bare, "_", "").try_cast("double"))


def detect_columns(columns: Iterable[str], source: str = "dataset") -> tuple[str, str]:
    """The names of the latitude and longitude columns, by priority of the known names and whatever their case."""
    columns = list(columns)
    by_lower = {c.strip().lower(): c for c in columns}
    found = []
    for what, names in (("latitude", LAT_NAMES), ("longitude", LNG_NAMES)):
        name = next((by_lower[n] for n in names if n in by_lower), None)
        if name is None:
            raise ColumnNotFoundError(what, columns, source)
        found.append(name)
    return found[0], found[1]


def check_path(spark: SparkSession, path: str) -> None:
    """Looks the path up where Spark would, so a URI of any store will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        raise SourceNotFoundError(path)


def read_points(spark: SparkSession, path: str, lat_col: str | None = None, lng_col: str | None = None, encoding: str = "utf-8-sig", splittable: bool = False) -> DataFrame:
    """A ``.csv``, ``.geojson`` or ``.json`` file (or a glob or folder with that ending)."""
    check_path(spark, path)
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return read_csv(spark, path, lat_col, lng_col, encoding, splittable)
    if kind in (".geojson", ".json"):
        return read_geojson(spark, path, encoding)
    raise UnsupportedFormatError(kind)


def _charset(encoding: str) -> str:
    """Spark's name of an encoding that Python knows."""
    name = codecs.lookup(encoding).name
    return {"utf-8-sig": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(name, name.upper())


def read_csv(spark: SparkSession, path: str, lat_col: str | None = None, lng_col: str | None = None, encoding: str = "utf-8-sig", splittable: bool = False) -> DataFrame:
    """Rows of a CSV with both coordinates; properties are strings, and a blank one is null.

    Rows with a blank or unreadable coordinate go (unreadable ones with a warning); one out of range raises an error.
    ``splittable`` reads large files in many tasks, which forbids line breaks inside quotes.
    """
    reader = spark.read.option("escape", '"').option("encoding", _charset(encoding)).option("multiLine", not splittable)
    names = (reader.option("header", False).csv(path).first() or [])[:]
    names = [("" if c is None else c).lstrip("\ufeff") for c in names]
    if not names:
        raise EmptyDatasetError(path)
    lat_name, lng_name = (lat_col, lng_col) if lat_col and lng_col else detect_columns(names, path)
    lat_name, lng_name = lat_col or lat_name, lng_col or lng_name
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    raw = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    last = {c: i for i, c in enumerate(names)}  # of columns with one name the last counts
    where = {c: F.col(f"c{last[c]}") if c in last else F.lit(None).cast("string") for c in (lat_name, lng_name)}
    used: dict[str, str] = {}
    for c, i in last.items():
        if c not in (lat_name, lng_name):
            used[_free(c, used)] = f"c{i}"
    rows = raw.select(F.monotonically_increasing_id().alias("_ord"), where[lat_name].alias("_lat"), where[lng_name].alias("_lng"), *(F.col(v).alias(k) for k, v in used.items()))
    return checked(rows, path)


def _free(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first of name_2, name_3, ... that differs from those taken by more than case."""
    low = {t.lower() for t in taken} | set(RESERVED)
    out, k = name, 1
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


def checked(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` with the coordinates parsed, in one job that counts, warns and finds the first invalid one."""
    lat, lng = parse_float(F.col("_lat")), parse_float(F.col("_lng"))
    said = [F.length(F.regexp_replace(F.col(c), r"(?U)\s+", "")) > 0 for c in ("_lat", "_lng")]
    bad = (lat.isNull() & said[0]) | (lng.isNull() & said[1])
    kept = lat.isNotNull() & lng.isNotNull()
    facts = rows.agg(
        F.count_if(kept).alias("n"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"),
        F.min(F.when(F.coalesce(bad, F.lit(False)), F.struct("_ord", "_lat", "_lng"))).alias("first_bad"),
        F.min(F.when(kept & ~is_valid(lat, lng), F.struct(F.col("_ord"), lat.alias("lat"), lng.alias("lng")))).alias("invalid"),
    ).first()
    if facts["bad"]:
        x = facts["first_bad"]
        warnings.warn(f"{source}: {facts['bad']} rows have a coordinate that is no number and are left out; the first has {x['_lat']!r}, {x['_lng']!r}", UserWarning, stacklevel=3)
    if facts["invalid"] is not None:
        raise InvalidCoordinateError(facts["invalid"]["lat"], facts["invalid"]["lng"])
    if not facts["n"]:
        raise EmptyDatasetError(source)
    return rows.withColumns({"_lat": lat, "_lng": lng}).where("_lat is not null and _lng is not null")


DOCUMENT = "type string, features array<struct<type:string,geometry:string,properties:string>>, geometry string, properties string"


def read_geojson(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> DataFrame:
    """The features of GeoJSON documents (a FeatureCollection or one Feature a file), or of files with one Feature a line, in file order.

    Features that aren't points stay, without coordinates. Coordinates are not checked here. Files of lines are read in
    many tasks; a document is one task. Text behind the Feature on a file's first line that is no Feature is an error.
    """
    if _charset(encoding) == "UTF-8":
        lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("value")).where("value <> ''")
        whole = F.col("value").rlike(r"^\{.*\}$") & F.coalesce(F.from_json("value", "type string")["type"] == "Feature", F.lit(False))
        facts = lines.agg(F.count("*").alias("n"), F.count_if(whole).alias("own")).first()
        if facts["n"] and facts["n"] == facts["own"]:
            own = F.from_json("value", "geometry string, properties string")
            return _features(lines.select(own.alias("f")).select("f.geometry", "f.properties"))
    if _charset(encoding) == "UTF-8":
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.read.format("binaryFile").load(path).select(F.decode("content", _charset(encoding)).alias("value"))
    doc = F.from_json(F.regexp_replace("value", "^\ufeff", ""), DOCUMENT)
    start = F.trim(F.substring_index(F.trim(F.regexp_replace("value", "^\ufeff", "")), "\n", 1))
    more = start.rlike(r"^\{.*\}$") & (F.length(start) < F.length(F.trim(F.regexp_replace("value", r"^\ufeff|\s+$", "")))) & F.coalesce(F.from_json(start, "type string")["type"].isin("Feature", "FeatureCollection"), F.lit(False))
    docs = text.select(doc.alias("d"), more.alias("more"))
    if not docs.where("more").isEmpty():
        raise UnsupportedFormatError(f"{path}: there is text behind a GeoJSON document")
    kind = docs.agg(F.min(F.coalesce("d.type", F.lit(""))).alias("a"), F.max(F.coalesce("d.type", F.lit(""))).alias("b")).first()
    if not {kind["a"], kind["b"]} <= {"FeatureCollection", "Feature"}:
        raise UnsupportedFormatError(f"{path}: not a GeoJSON FeatureCollection or Feature")
    one = F.array(F.struct(F.col("d.type").alias("type"), F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties")))
    every = F.when(F.col("d.type") == "Feature", one).otherwise(F.coalesce("d.features", F.array().cast("array<struct<type:string,geometry:string,properties:string>>")))
    return _features(docs.select(F.explode(every).alias("f")).select("f.geometry", "f.properties"))


def _features(raw: DataFrame, order: Column | None = None) -> DataFrame:
    geometry = F.from_json("geometry", "type string, coordinates string")
    spot = F.when(geometry["type"] == "Point", F.from_json(geometry["coordinates"], "array<double>"))
    return raw.select(
        (F.monotonically_increasing_id() if order is None else order).alias("_ord"),
        F.get(spot, F.lit(1)).alias("_lat"),
        F.get(spot, F.lit(0)).alias("_lng"),
        geometry["type"].alias("geometry_type"),
        F.col("geometry").alias("geometry_json"),
        F.from_json("properties", "map<string,string>").alias("properties"),
        F.col("properties").alias("properties_json"),
    )


def from_features(spark: SparkSession, features: list[dict]) -> DataFrame:
    """GeoJSON Feature dicts in memory."""
    features = list(features or ())
    if not features:
        raise EmptyDatasetError("<in-memory data>")
    rows = [(i, json.dumps(f.get("geometry")), None if f.get("properties") is None else json.dumps(f["properties"], ensure_ascii=False)) for i, f in enumerate(features)]
    raw = spark.createDataFrame(rows, "i long, geometry string, properties string")
    return _features(raw).withColumn("_ord", F.col("_ord")) if len(rows) < 2 else _features(raw.repartitionByRange(1, "i").sortWithinPartitions("i").select("geometry", "properties"))


def from_feature_table(df: DataFrame, geometry: str, properties: str, order: str) -> DataFrame:
    """Features whose geometry and properties are GeoJSON texts in a DataFrame; ``order`` is a column of distinct longs."""
    raw = df.select(F.col(order).cast("long").alias("_ord"), F.col(geometry).alias("geometry"), F.col(properties).alias("properties"))
    return _features(raw, F.col("_ord"))


def from_table(df: DataFrame, lat="lat", lng="lng", order: str | None = None) -> DataFrame:
    """Any DataFrame, batch or streaming; ``lat`` and ``lng`` are names or expressions, ``order`` a column of distinct longs.

    Without ``order`` the rows are numbered as they are read, which keeps filters from being pushed into the scan.
    """
    clash = [c for c in df.columns if c.lower() in RESERVED]
    if clash:
        raise ValueError(f"columns {clash} have names that are needed here; rename them")
    lat_, lng_ = (F.col(c) if isinstance(c, str) else c for c in (lat, lng))
    ord_ = F.col(order).cast("long") if order else F.lit(0).cast("long") if df.isStreaming else F.monotonically_increasing_id()
    rest = [c for c in df.columns if c not in (lat, lng)] if isinstance(lat, str) and isinstance(lng, str) else df.columns
    return df.select(ord_.alias("_ord"), lat_.cast("double").alias("_lat"), lng_.cast("double").alias("_lng"), *rest)
