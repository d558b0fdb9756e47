"""What can go wrong, each error with a hint at the way out."""

from __future__ import annotations

import builtins
from collections.abc import Iterable


class GeoloomError(Exception):
    """Base of all errors of this package."""

    def __init__(self, title: str, what: str, hints: Iterable[str]) -> None:
        super().__init__("\n".join([title, what, "Fix it:", *(f"  - {h}" for h in hints)]))


class NoDataError(GeoloomError):
    """A method that needs rows was called on a frame without any."""

    def __init__(self, method: str = "this method") -> None:
        super().__init__("No data", f"{method}() needs at least one feature and there is none.", ["geo.load('points.csv') or geo.load('points.geojson')", "geo.load_data([...]) for features in memory, geo.from_table(df) for a table", "a filter may have matched nothing: test geo.count() first"])


class InvalidCoordinateError(GeoloomError):
    """A latitude outside -90..90 or a longitude outside -180..180, or no number at all."""

    def __init__(self, lat, lng) -> None:
        super().__init__("Invalid coordinate", f"lat={lat}, lng={lng}; a latitude lies in -90..90 and a longitude in -180..180.", ["points are (latitude, longitude), in this order"])


class InvalidUnitError(GeoloomError):
    """An unknown unit of length."""

    def __init__(self, unit, valid: Iterable[str]) -> None:
        super().__init__("Invalid unit", f"{unit!r} is not a known unit.", [f"use one of: {', '.join(valid)}"])


class ColumnNotFoundError(GeoloomError):
    """A column that the data don't have; the message lists up to ten that they have."""

    def __init__(self, column: str, available: Iterable[str], source: str = "dataset") -> None:
        names = [str(c) for c in available]
        shown = ", ".join(names[:10]) + (f" (+{len(names) - 10} more)" if len(names) > 10 else "")
        super().__init__("Column not found", f"{source} has no column {column!r}. Its columns: {shown or 'none'}.", [f"geo.filter({names[0] if names else 'name'!r}, value)", "geo.load(path, lat_col=..., lng_col=...) names the coordinates"])


class SourceNotFoundError(GeoloomError, builtins.FileNotFoundError):
    """A path at which there is nothing; Python's own error of that kind, too."""

    def __init__(self, path: str) -> None:
        super().__init__("File not found", f"There is nothing at {path!r}.", ["check the spelling of the path", "use an absolute path or a full URI"])


class UnsupportedFormatError(GeoloomError):
    """A format that is neither CSV nor GeoJSON, or text that is not what its extension says."""

    def __init__(self, what: str) -> None:
        super().__init__("Unsupported format", f"{what!r} can't be read or written.", ["use .csv, .geojson or .json", "geo.from_table(spark.read...) takes whatever Spark can read"])


class EmptyDatasetError(GeoloomError):
    """A source without a usable feature."""

    def __init__(self, path: str) -> None:
        super().__init__("Empty dataset", f"No row of {path!r} has both coordinates.", ["check that there are rows below the header", "check that the coordinate columns hold numbers"])


class InvalidRadiusError(GeoloomError):
    """A radius that is zero, negative or not a number."""

    def __init__(self, radius) -> None:
        super().__init__("Invalid radius", f"{radius} is not a positive number.", ["geo.buffer(center, radius=10)", "geo.filter_by_radius(lat, lng, 50)"])


class InvalidBufferError(GeoloomError):
    """A polygon argument that is neither a Polygon nor a Feature with one."""

    def __init__(self) -> None:
        super().__init__("Invalid polygon", "A GeoJSON Polygon, or a Feature with one, is expected.", ["zone = geo.buffer(center, radius=10)", "geo.point_in_polygon(point, zone)"])


#: The same under the name that users of a point library look for.
FileNotFoundError = SourceNotFoundError
