"""Column expressions of spherical geometry: built-in functions only, so they stay in the JVM, batch or streaming."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .units import BEARING_DECIMALS, COMPASS, DISTANCE_DECIMALS, EARTH_RADIUS_KM, PER_KM, checked_radius, km_of, per_km


def col(x) -> Column:
    """A column as it is, a name as that column, a number as a literal double."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def is_valid(lat, lng) -> Column:
    """Whether both are in range; null and NaN are not."""
    return F.coalesce(col(lat).between(-90, 90) & col(lng).between(-180, 180), F.lit(False))


def haversine_share(lat1, lng1, lat2, lng2) -> Column:
    """The squared sine of half the angle between two points, which grows with their distance."""
    p, q = F.radians(col(lat1)), F.radians(col(lat2))
    s, t = F.sin((q - p) / 2), F.sin((F.radians(col(lng2)) - F.radians(col(lng1))) / 2)
    return s * s + F.cos(p) * F.cos(q) * t * t


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in kilometres, not rounded."""
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(haversine_share(lat1, lng1, lat2, lng2)))) * EARTH_RADIUS_KM


def distance(lat1, lng1, lat2, lng2, unit: str = "km") -> Column:
    """Great-circle distance in ``unit``, rounded to four decimals."""
    return F.round(haversine_km(lat1, lng1, lat2, lng2) * F.lit(per_km(unit)), DISTANCE_DECIMALS)


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees clockwise from north, rounded to two decimals (360.0 may come of it)."""
    p, q, turn = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lng2) - col(lng1))
    east = F.sin(turn) * F.cos(q)
    north = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn)
    return F.round((F.degrees(F.atan2(east, north)) + 360) % 360, BEARING_DECIMALS)


def compass(degrees) -> Column:
    """The nearest of the sixteen compass points; a bearing halfway between two goes to the even one."""
    names = F.array(*map(F.lit, COMPASS))
    return F.element_at(names, F.pmod(F.rint(col(degrees) / 22.5), F.lit(16.0)).cast("int") + 1)


def ring_point(lat, lng, angle: Column, radius_km) -> Column:
    """The struct (lng, lat) that lies ``radius_km`` away at ``angle`` (radians from north). lng is not wrapped."""
    p, d = F.radians(col(lat)), col(radius_km) / EARTH_RADIUS_KM
    there = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(angle))
    turn = F.atan2(F.sin(angle) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(there))
    return F.struct(F.degrees(F.radians(col(lng)) + turn).alias("lng"), F.degrees(there).alias("lat"))


def buffer_ring(lat, lng, radius, unit: str = "km", num_points: int = 64) -> Column:
    """The closed ring, array of (lng, lat), of a circle; ``radius`` may be a column, else it must be positive."""
    if num_points < 1:
        raise ValueError("num_points must be at least 1")
    if not isinstance(radius, (Column, str)):
        checked_radius(radius)
    radius_km = col(radius) * F.lit(km_of(unit))
    step = F.sequence(F.lit(0), F.lit(num_points))
    return F.transform(step, lambda i: ring_point(lat, lng, F.radians((i % num_points) * 360.0 / F.lit(float(num_points))), radius_km))


def literal_ring(ring: list) -> Column:
    """A ring [[lng, lat], ...] as a constant."""
    return F.array(*(F.struct(F.lit(float(p[0])).alias("lng"), F.lit(float(p[1])).alias("lat")) for p in ring))


def in_ring(lat, lng, ring: Column) -> Column:
    """Even-odd test in the plane. Edges are half-open and the last point is joined to the first."""
    y, x, n = col(lat), col(lng), F.size(ring)

    def crosses(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, (k + n - 1) % n)
        at = (b["lng"] - a["lng"]) * (y - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"]
        return ((a["lat"] > y) != (b["lat"] > y)) & F.coalesce(x < at, F.lit(False))

    edges = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return F.when(n > 0, F.size(edges) % 2 == 1).otherwise(False)


def lng_reach(lat, angle: Column) -> Column:
    """How many degrees of longitude a cap of that angular radius (radians) spans at most; 180 if it holds a pole."""
    p = F.radians(col(lat))
    open_ = F.abs(p) + angle < math.pi / 2
    return F.when(open_, F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(p)))))).otherwise(180.0)


def radius_box(lat, lng, center: tuple[float, float], radius: float, unit: str = "km") -> Column:
    """A condition on plain comparisons that every point within the radius meets, which can reach the scan's statistics."""
    pad = 0.5 * 10.0**-DISTANCE_DECIMALS  # distances are compared after rounding
    angle = (radius + pad) / per_km(unit) / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-12
    reach = math.degrees(angle) + 1e-9
    south, north = center[0] - reach, center[0] + reach
    box = col(lat).between(south, north)
    if south <= -90 or north >= 90:
        return box
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(center[0]))))) + 1e-9
    west, east = center[1] - wide, center[1] + wide
    x = col(lng)
    if east - west >= 360:
        return box
    if west < -180:
        return box & ((x <= east) | (x >= west + 360))
    if east > 180:
        return box & ((x >= west) | (x <= east - 360))
    return box & x.between(west, east)


SQL_FUNCTIONS = {
    "geo_distance_km": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", "round(2 * asin(least(1D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lng2) - radians(lng1)) / 2), 2)))) * 6371.0088D, 4)"),
    "geo_bearing": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", "round((degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360) % 360, 2)"),
    "geo_compass": ("deg DOUBLE", "STRING", f"element_at(array({', '.join(repr(c) for c in COMPASS)}), cast(pmod(rint(deg / 22.5D), 16D) as int) + 1)"),
    "geo_distance": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE, unit STRING", "DOUBLE", None),
    "geo_in_ring": (
        "lat DOUBLE, lng DOUBLE, ring ARRAY<STRUCT<lng: DOUBLE, lat: DOUBLE>>",
        "BOOLEAN",
        "size(ring) > 0 AND size(filter(sequence(0, size(ring) - 1), k -> (ring[k].lat > lat) <> (ring[(k + size(ring) - 1) % size(ring)].lat > lat)"
        " AND coalesce(lng < (ring[(k + size(ring) - 1) % size(ring)].lng - ring[k].lng) * (lat - ring[k].lat) / nullif(ring[(k + size(ring) - 1) % size(ring)].lat - ring[k].lat, 0D) + ring[k].lng, false))) % 2 = 1",
    ),
    "geo_is_valid": ("lat DOUBLE, lng DOUBLE", "BOOLEAN", "coalesce(lat between -90 and 90 and lng between -180 and 180, false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL. Spark inlines them, so a query with them has no function call left."""
    factor = "CASE lower(unit) " + " ".join(f"WHEN '{u}' THEN {f}D" for u, f in PER_KM.items()) + " END"
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        if body is None:  # null for an unknown unit
            body = SQL_FUNCTIONS["geo_distance_km"][2].replace("6371.0088D", f"6371.0088D * {factor}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
