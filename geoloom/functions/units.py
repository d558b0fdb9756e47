"""Units, compass points and the checks of arguments, all on the driver."""

from __future__ import annotations

import math

from ..errors import InvalidBufferError, InvalidCoordinateError, InvalidRadiusError, InvalidUnitError

# Results must equal those of the definitions that users know.
EARTH_RADIUS_KM = 6371.0088
PER_KM = {"km": 1.0, "miles": 0.621371, "mi": 0.621371, "m": 1000.0, "ft": 3280.84}
KM_OF = {"km": 1.0, "miles": 1.60934, "mi": 1.60934, "m": 0.001}
COMPASS = ("North", "North-Northeast", "Northeast", "East-Northeast", "East", "East-Southeast", "Southeast", "South-Southeast", "South", "South-Southwest", "Southwest", "West-Southwest", "West", "West-Northwest", "Northwest", "North-Northwest")
#: Decimals of distances and of bearings.
DISTANCE_DECIMALS, BEARING_DECIMALS = 4, 2


def per_km(unit: str) -> float:
    """The length of a kilometre in ``unit``."""
    if unit.lower() not in PER_KM:
        raise InvalidUnitError(unit, PER_KM)
    return PER_KM[unit.lower()]


def km_of(unit: str) -> float:
    """The length of a ``unit`` in kilometres, for buffers; not the exact inverse of :func:`per_km`, by definition."""
    if unit.lower() not in KM_OF:
        raise InvalidUnitError(unit, KM_OF)
    return KM_OF[unit.lower()]


def checked_point(point) -> tuple[float, float]:
    try:
        lat, lng = point
        ok = -90.0 <= float(lat) <= 90.0 and -180.0 <= float(lng) <= 180.0
    except (TypeError, ValueError):
        lat, lng = point if isinstance(point, (tuple, list)) and len(point) == 2 else (point, None)
        ok = False
    if not ok:
        raise InvalidCoordinateError(lat, lng)
    return float(lat), float(lng)


def checked_radius(radius) -> float:
    if not radius > 0 or math.isnan(radius):
        raise InvalidRadiusError(radius)
    return float(radius)


def outer_ring(polygon) -> list:
    """The first ring, [[lng, lat], ...], of a Polygon or of a Feature with one. Holes are not looked at."""
    if isinstance(polygon, dict) and polygon.get("type") == "Feature":
        polygon = polygon.get("geometry")
    if not isinstance(polygon, dict) or polygon.get("type") != "Polygon" or not polygon.get("coordinates"):
        raise InvalidBufferError()
    return polygon["coordinates"][0]
