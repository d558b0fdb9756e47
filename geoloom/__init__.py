"""Point-based spatial analytics on Spark."""

from .errors import (
    ColumnNotFoundError,
    EmptyDatasetError,
    FileNotFoundError,
    GeoloomError,
    InvalidBufferError,
    InvalidCoordinateError,
    InvalidRadiusError,
    InvalidUnitError,
    NoDataError,
    SourceNotFoundError,
    UnsupportedFormatError,
)
from .frame import VERSION, GeoFrame

__version__ = VERSION
__all__ = [
    "ColumnNotFoundError",
    "EmptyDatasetError",
    "FileNotFoundError",
    "GeoFrame",
    "GeoloomError",
    "InvalidBufferError",
    "InvalidCoordinateError",
    "InvalidRadiusError",
    "InvalidUnitError",
    "NoDataError",
    "SourceNotFoundError",
    "UnsupportedFormatError",
]
