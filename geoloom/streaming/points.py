"""Operators on streams of points. Row-wise ones are those of batches; sorting and top-k need a bounded window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import bounds, within_radius


def stream_within_radius(df: DataFrame, center, radius: float, unit: str = "km") -> DataFrame:
    """Rows within the radius, with ``_distance``, in append mode; unlike the batch form not sorted, which streams can't be."""
    return within_radius(df, center, radius, unit, ordered=False)


def stream_bounds(df: DataFrame) -> DataFrame:
    """The bounds so far, for complete or update mode. The state is one row."""
    return bounds(df)


def stream_cell_counts(df: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour", cell: float = 1.0) -> DataFrame:
    """Points by time window and grid cell of ``cell`` degrees; the watermark bounds the state and drops later rows."""
    cells = df.withWatermark(time, late).withColumns({"cell_lat": F.floor(F.col("_lat") / cell).cast("int"), "cell_lng": F.floor(F.col("_lng") / cell).cast("int")})
    return cells.groupBy(F.window(time, window).alias("w"), "cell_lat", "cell_lng").agg(F.count("*").alias("n_points")).select("w.start", "w.end", "cell_lat", "cell_lng", "n_points")


def write_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a folder with exactly-once files; a restart goes on after what is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
