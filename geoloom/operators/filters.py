"""Filters, nearest, bounds and heat intensities over frames of points (``_ord``, ``_lat``, ``_lng`` and properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance, in_ring, literal_ring, radius_box
from ..functions.units import checked_point, checked_radius, outer_ring, per_km
from ..sources.points import parse_float


def norm(text: Column) -> Column:
    """Lower case, without white space at the ends."""
    return F.lower(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def is_map(df: DataFrame) -> bool:
    return "properties" in df.columns and df.schema["properties"].dataType.typeName() == "map"


def prop(df: DataFrame, name: str) -> Column:
    """A property, wherever the frame keeps it; ``_distance`` is a column in any frame."""
    if is_map(df) and name != "_distance":
        return F.try_element_at("properties", F.lit(name))
    return F.col("`" + name.replace("`", "``") + "`")


def equals(df: DataFrame, name: str, value) -> Column:
    """Whether a property equals a value as texts, whatever their case and the white space around them.

    In a map a missing key counts as blank and a null as "none"; a null in a flat column counts as blank. Numbers in
    a flat column of numbers are compared as numbers.
    """
    x, want = prop(df, name), str(value).strip().lower()
    if is_map(df) and name != "_distance":
        here = F.map_contains_key("properties", F.lit(name))
        text = F.when(~F.coalesce(here, F.lit(False)), "").when(x.isNull(), "none").otherwise(norm(x))
        return text == want
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float", "integer", "long", "short", "byte", "decimal") and not isinstance(value, bool):
        try:
            return F.coalesce(x == F.lit(float(want)) if kind in ("double", "float") else x == F.lit(int(want)), F.lit(False))
        except ValueError:
            pass
    return F.coalesce(norm(x.cast("string")), F.lit("")) == want


def within_radius(df: DataFrame, center, radius: float, unit: str = "km", ordered: bool = True, order: tuple = ("_ord",)) -> DataFrame:
    """Rows within the (rounded) distance, with ``_distance``, nearest first and ties as they were.

    Plain comparisons of both coordinates come first, so that a scan can skip what is far away. ``ordered=False`` is
    for streams, which can't be sorted.
    """
    center, radius = checked_point(center), checked_radius(radius)
    per_km(unit)
    near = df.where(radius_box("_lat", "_lng", center, radius, unit))
    out = near.withColumn("_distance", distance(center[0], center[1], "_lat", "_lng", unit)).where(F.col("_distance") <= radius)
    return out.orderBy("_distance", *order) if ordered else out


def nearest(df: DataFrame, point, unit: str = "km", k: int = 1, order: tuple = ("_ord",)) -> DataFrame:
    """The ``k`` rows of least rounded distance, with ``_distance``; the first of ties. One top-k, no full sort."""
    point = checked_point(point)
    ranked = df.where("_lat is not null and _lng is not null").withColumn("_distance", distance(point[0], point[1], "_lat", "_lng", unit))
    return ranked.orderBy("_distance", *order).limit(k)


def in_zone(df: DataFrame, polygon) -> DataFrame:
    """Rows inside the outer ring of one polygon; the ring's box comes first."""
    ring = outer_ring(polygon)
    lngs, lats = [p[0] for p in ring], [p[1] for p in ring]
    return df.where(F.col("_lat").between(float(min(lats)), float(max(lats))) & F.col("_lng").between(float(min(lngs)), float(max(lngs)))).where(in_ring("_lat", "_lng", literal_ring(ring)))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("_lat").alias("min_lat"), F.max("_lat").alias("max_lat"), F.min("_lng").alias("min_lng"), F.max("_lng").alias("max_lng"))


def centroid(df: DataFrame) -> DataFrame:
    """The mean of both coordinates."""
    return df.agg(F.avg("_lat").alias("lat"), F.avg("_lng").alias("lng"))


def intensities(df: DataFrame, column: str | None = None) -> DataFrame:
    """(_ord, lat, lng, intensity): the column's number, 1.0 where there is none, all divided by the largest if that is over 1.

    The maximum is one aggregate whose single row is then joined to every point.
    """
    if column is None:
        return df.select("_ord", F.col("_lat").alias("lat"), F.col("_lng").alias("lng"), F.lit(1.0).alias("intensity"))
    known = prop(df, column) if is_map(df) or column in df.columns else F.lit(None).cast("string")
    raw = F.coalesce(parse_float(known.cast("string")), F.lit(1.0))
    points = df.select("_ord", F.col("_lat").alias("lat"), F.col("_lng").alias("lng"), raw.alias("raw"))
    most = points.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(~F.isnan("raw"), F.col("raw"))), F.lit(1.0))).alias("most"))
    return points.crossJoin(F.broadcast(most)).select("_ord", "lat", "lng", (F.col("raw") / F.col("most")).alias("intensity"))
