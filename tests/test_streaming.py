"""Streams of points."""

import datetime

import pytest
from pyspark.errors import AnalysisException

from geoloom.operators.filters import within_radius
from geoloom.sources.points import from_table
from geoloom.streaming.points import stream_bounds, stream_cell_counts, stream_within_radius, write_parquet

SCHEMA = "id long, at timestamp, lat double, lng double"


@pytest.fixture
def source(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=i), i % 80 / 1.0, i % 170 / 1.0) for i in range(400)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    return folder


def test_radius(spark, source, tmp_path):
    stream = from_table(spark.readStream.schema(SCHEMA).parquet(source))
    write_parquet(stream_within_radius(stream, (10, 10), 2000).select("id", "_distance"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = within_radius(from_table(spark.read.parquet(source)), (10, 10), 2000).select("id", "_distance")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want.collect()) != []
    # nothing new, nothing twice
    write_parquet(stream_within_radius(stream, (10, 10), 2000).select("id", "_distance"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()
    with pytest.raises(AnalysisException):
        write_parquet(within_radius(stream, (10, 10), 2000), str(tmp_path / "o2"), str(tmp_path / "s2"))


def test_bounds(spark, source):
    q = stream_bounds(from_table(spark.readStream.schema(SCHEMA).parquet(source))).writeStream.format("memory").queryName("stream_bounds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("stream_bounds").first()) == (0.0, 79.0, 0.0, 169.0)


def test_cells(spark, source, tmp_path):
    stream = from_table(spark.readStream.schema(SCHEMA).parquet(source))
    write_parquet(stream_cell_counts(stream, "at", "1 hour", "10 minutes", 10.0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("start = timestamp'2024-01-01 00:00:00'").groupBy().sum("n_points").first()[0] == 60
