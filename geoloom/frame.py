"""``GeoFrame``: a lazily evaluated set of point features with the operations as methods."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ColumnNotFoundError, GeoloomError, NoDataError
from .functions import scalar
from .operators import filters
from .sources import points, sinks

VERSION = "0.1.0"
HIDDEN = ("_ord", "_lat", "_lng", "_distance")
#: Distances of earlier radius filters, which still decide ties.
TIE = "_tie"


class GeoFrame:
    """Loading replaces what the frame holds and gives the frame back; filters give new frames.

    ``df`` is the DataFrame behind it: ``_ord``, ``_lat``, ``_lng``, perhaps ``_distance``, and the properties. Rows
    are only collected by ``get_features``, ``get_geojson`` and the file writers, in the order of ``_ord`` or, after a
    radius filter, of the distance.
    """

    VERSION = VERSION

    def __init__(self, spark: SparkSession | None = None) -> None:
        self._spark = spark
        self.df: DataFrame | None = None
        self.source: str | None = None
        self._order: tuple[str, ...] = ("_ord",)
        self._blank = False  # null properties stand for blank ones
        self._has: bool | None = None

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return self._spark

    # --- loading and saving ---

    def load(self, path: str, lat_col: str | None = None, lng_col: str | None = None, encoding: str = "utf-8-sig", splittable: bool = False) -> GeoFrame:
        """A CSV or GeoJSON file at any path or URI that Spark can read; ``splittable`` as in :func:`geoloom.sources.points.read_csv`."""
        path = str(path)
        df = points.read_points(self.spark, path, lat_col, lng_col, encoding, splittable)
        self._set(df, blank=path.rstrip("/").lower().endswith(".csv"))
        self.source = path
        return self

    def load_data(self, features: list[dict]) -> GeoFrame:
        """GeoJSON Feature dicts."""
        self._set(points.from_features(self.spark, features))
        return self

    def load_table(self, df: DataFrame, geometry: str = "geometry_json", properties: str = "properties_json", order: str = "_ord") -> GeoFrame:
        """A DataFrame of features: GeoJSON texts of their geometry and properties, and a column of distinct longs. No feature comes to the driver."""
        self._set(points.from_feature_table(df, geometry, properties, order))
        return self

    def feature_table(self) -> DataFrame:
        """What :meth:`load_table` takes: the features of :meth:`get_features` as a DataFrame, for more than the driver can hold."""
        self._require("feature_table")
        return self._as_json()

    def from_table(self, df: DataFrame, lat="lat", lng="lng", order: str | None = None) -> GeoFrame:
        """Any DataFrame with coordinates; see :func:`geoloom.sources.points.from_table`."""
        self._set(points.from_table(df, lat, lng, order))
        return self

    def _set(self, df: DataFrame, blank: bool = False) -> None:
        self.df, self._blank, self._has, self._order = df, blank, None, ("_ord",)

    def save(self, path: str, encoding: str = "utf-8") -> GeoFrame:
        """All features to one GeoJSON or CSV file, in order."""
        path = str(path)
        self._require("save")
        if sinks.extension(path) == ".csv":
            names = self.property_names()
            sinks.write_csv_rows(self._sorted(), names, path) if sinks.is_utf8(encoding) else sinks.write_csv(self.iterate(), names, path, encoding)
        elif sinks.is_utf8(encoding):
            sinks.write_geojson_rows(self._sorted(), path)
        else:
            sinks.write_geojson(self.iterate(), path, encoding)
        return self

    def save_lines(self, path: str) -> GeoFrame:
        """One feature a line, written by all executors to a folder: the way for data too large for one file."""
        self._require("save_lines")
        sinks.write_lines(self._as_json(), path)
        return self

    # --- single points ---

    def distance(self, point_a, point_b, unit: str = "km") -> float:
        return scalar.distance(point_a, point_b, unit)

    def bearing(self, point_a, point_b, as_degrees: bool = False) -> float | str:
        return scalar.bearing(point_a, point_b, as_degrees)

    def buffer(self, center, radius: float, unit: str = "km", num_points: int = 64) -> dict:
        return scalar.buffer(center, radius, unit, num_points)

    def point_in_polygon(self, point, polygon: dict) -> bool:
        return scalar.point_in_polygon(point, polygon)

    # --- queries ---

    def filter(self, column: str, value) -> GeoFrame:
        """Features whose property equals the value as text, whatever the case and the white space around it."""
        self._require("filter")
        flat = not filters.is_map(self.df)
        if column not in self.df.columns if flat or column == "_distance" else not self._has_key(column):
            raise ColumnNotFoundError(column, self.property_names(), self.source or "dataset")
        return self._with(self.df.where(filters.equals(self.df, column, value)))

    def filter_by_radius(self, lat: float, lng: float, radius: float, unit: str = "km") -> GeoFrame:
        """Features within the radius, nearest first, with ``_distance``."""
        self._require("filter_by_radius")
        df, order = self._ranked("filter_by_radius")
        out = self._with(filters.within_radius(df, (lat, lng), radius, unit, order=order))
        out._order = ("_distance", *order)
        return out

    def in_zone(self, polygon: dict) -> GeoFrame:
        """Features inside the outer ring of the polygon."""
        self._require("in_zone")
        return self._with(filters.in_zone(self.df, polygon))

    def nearest(self, point, unit: str = "km") -> dict:
        """The feature of least distance (the first of ties), that distance, and its position in the current order."""
        self._require("nearest")
        filters.checked_point(point)
        df, order = self._ranked("nearest")
        row = self._as_json(filters.nearest(df, point, unit, 1, order), order).first()
        index = df.where(F.struct(*order) < F.struct(*(F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order))).count()
        feature = self._feature(row, with_distance=False)
        if "_distance" in self.df.columns:
            feature["properties"]["_distance"] = row[next(c for c in order if c.startswith(TIE))]
        return {"feature": feature, "distance": row["_distance"], "index": index}

    def nearest_k(self, point, k: int, unit: str = "km") -> GeoFrame:
        """The ``k`` nearest features as a frame, nearest first."""
        self._require("nearest_k")
        df, order = self._ranked("nearest_k")
        out = self._with(filters.nearest(df, point, unit, k, order))
        out._order = ("_distance", *order)
        return out

    def count(self) -> int:
        return 0 if self.df is None else self.df.count()

    def bounds(self) -> dict:
        self._require("bounds")
        return filters.bounds(self._placed("bounds")).first().asDict()

    def centroid(self) -> tuple[float, float]:
        self._require("centroid")
        return tuple(filters.centroid(self.df).first())

    def heat_points(self, intensity_col: str | None = None) -> DataFrame:
        self._require("heatmap")
        return filters.intensities(self._placed("heatmap"), intensity_col)

    # --- rows on the driver ---

    def iterate(self) -> Iterator[dict]:
        """The features in order, a partition at a time."""
        for row in self._sorted().toLocalIterator():
            yield self._feature(row)

    def get_features(self) -> list[dict]:
        self._require("get_features")
        return list(self.iterate())

    def get_geojson(self) -> dict:
        self._require("get_geojson")
        return {"type": "FeatureCollection", "features": list(self.iterate())}

    def property_names(self) -> list[str]:
        """Names of all properties; of a map those that occur, in the order in which they first do."""
        more = ["_distance"] if "_distance" in self.df.columns else []
        if not filters.is_map(self.df):
            return [c for c in self.df.columns if c not in HIDDEN and not c.startswith(TIE)] + more
        keys = self.df.select("_ord", F.posexplode(F.map_keys("properties")).alias("pos", "key"))
        first = keys.groupBy("key").agg(F.min(F.struct("_ord", "pos")).alias("at")).orderBy("at")
        return [r["key"] for r in first.collect()] + more

    # --- maps ---

    def map(self, output_path: str = "map.html", title: str = "Map", zoom: int = 5, center=None) -> GeoFrame:
        self._require("map")
        n = sinks.write_map(self._sorted(), str(output_path), title, zoom, center)
        print(f"{output_path}: map of {n} points")
        return self

    def heatmap(self, output_path: str = "heatmap.html", title: str = "Heatmap", intensity_col: str | None = None, zoom: int = 5, center=None) -> GeoFrame:
        n = sinks.write_heatmap(self.heat_points(intensity_col).orderBy("_ord"), str(output_path), title, zoom, center)
        print(f"{output_path}: heat map of {n} points")
        return self

    def __len__(self) -> int:
        return self.count()

    def __bool__(self) -> bool:
        return True

    def __repr__(self) -> str:
        """Without a job: what is known of the plan, not how many rows it gives."""
        if self.df is None:
            return "<GeoFrame [no data loaded]>"
        return f"<GeoFrame [{self.source or 'table'}: {', '.join(self.df.columns)}]>"

    # --- helpers ---

    def _with(self, df: DataFrame) -> GeoFrame:
        new = GeoFrame(self._spark)
        new.df, new.source, new._order, new._blank = df, self.source, self._order, self._blank
        return new

    def _require(self, method: str) -> None:
        if self.df is not None and self._has is None:
            self._has = not self.df.isEmpty()
        if not self._has:
            raise NoDataError(method)

    def _placed(self, method: str) -> DataFrame:
        """The frame, once it is certain that all features are points (those of GeoJSON need not be)."""
        if filters.is_map(self.df) and not self.df.where("_lat is null or _lng is null").isEmpty():
            raise GeoloomError("Not a point", f"{method}() needs points; some features have another geometry or none.", ["geo.df.where(\"geometry_type = 'Point'\")"])
        return self.df

    def _has_key(self, column: str) -> bool:
        return not self.df.where(F.coalesce(F.map_contains_key("properties", F.lit(column)), F.lit(False))).isEmpty()

    def _ranked(self, method: str) -> tuple[DataFrame, tuple]:
        """The frame and its order with the present distance under another name, so that a new one can take its place."""
        df, order = self._placed(method), self._order
        if "_distance" in df.columns:
            name = f"{TIE}{sum(c.startswith(TIE) for c in df.columns)}"
            df, order = df.withColumnRenamed("_distance", name), tuple(name if c == "_distance" else c for c in order)
        return df, order

    def _as_json(self, df: DataFrame | None = None, order: tuple | None = None) -> DataFrame:
        df = self.df if df is None else df
        more = [c for c in dict.fromkeys(("_distance", *(order or self._order))) if c in df.columns and c != "_ord"]
        if filters.is_map(df):
            return df.select("_ord", *more, "_lat", "_lng", "geometry_json", "properties_json")
        flat = [F.col(f"`{c}`") for c in self.property_names() if c != "_distance"]
        if self._blank:
            flat = [F.coalesce(c, F.lit("")).alias(n) for c, n in zip(flat, (c for c in self.property_names() if c != "_distance"))]
        own = F.to_json(F.struct(*flat), {"ignoreNullFields": "false"}) if flat else F.lit("{}")
        place = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("_lng", "_lat").alias("coordinates")))
        return df.select("_ord", *more, "_lat", "_lng", place.alias("geometry_json"), own.alias("properties_json"))

    def _sorted(self) -> DataFrame:
        return self._as_json().orderBy(*self._order)

    def _feature(self, row, with_distance: bool = True) -> dict:
        known = row.asDict()
        if not with_distance:
            known.pop("_distance", None)
        return sinks.feature(known)
