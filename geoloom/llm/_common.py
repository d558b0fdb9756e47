"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space and U+0009..U+000D. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process, as in tests."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if there:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(there)
        return there.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="geoloom-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read again, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a compressed table in the shared folder, and its place for :func:`discard`: for what is large, or read by columns."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place), place


def discard(spark: SparkSession, *places: str) -> None:
    """Removes tables of :func:`stored` that nothing will read any more."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, at once rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(column):
    """A-Z lowered, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def binary_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def label_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by the pairs (a[i], b[i]): the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    return label


def expand_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside consecutive groups that begin at ``starts`` and have ``sizes`` rows."""
    first = np.repeat(starts, sizes)
    pos = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = first + pos
    left = np.repeat(own, pos)
    right_base = np.repeat(first, pos)
    step = np.arange(len(left)) - np.repeat(np.cumsum(pos) - pos, pos)
    return right_base + step, left


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65536) -> Iterator[pa.Table]:
    """Batches sorted by ``keys``, put together so that no group is cut; each piece has about ``rows`` rows."""
    held: list[pa.Table] = []
    count = 0

    def codes(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            x = t.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            t = pa.concat_tables(held).combine_chunks()
            last = int(codes(t)[-1])
            if last:
                yield t.slice(0, last)
            held = [t.slice(last)]
            count = t.num_rows - last
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


#: Bits of a filter: so many for each value, within these bounds (8 KB to 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 28


def filter_bits(n: int) -> int:
    """Bits of a filter of n values, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))


def bitmap_parts(ids: DataFrame, bits: int) -> DataFrame:
    """(k, part): a bit for each value of the long column ``c``, by its lowest bits but one, in parts of 4 KB; 2 ** (bits - 3) bytes at most."""
    at = F.shiftright("c", 1).bitwiseAND(F.lit((1 << bits) - 1))
    # dealt by place first: a value takes less than the 4 KB of its part of the map
    places = ids.select(at.alias("x"), F.shiftright(at, 15).alias("k")).repartition("k")
    return places.groupBy("k").agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("part"))


def suspected(df: DataFrame, c: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose long column ``c`` may be among ``ids(c)`` (a written frame), and the others.

    A bitmap of bounded size, broadcast, tells them apart, so only the first have to be shuffled to be sure.
    """
    bits = filter_bits(ids.count())
    parts = F.broadcast(bitmap_parts(ids, bits).select(F.col("k").alias("_gl_k"), F.col("part").alias("_gl_part")))
    x = F.shiftright(F.col(c), 1).bitwiseAND(F.lit((1 << bits) - 1))
    told = df.join(parts, F.shiftright(x, 15) == F.col("_gl_k"), "left")
    low = x.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_gl_part"), F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, low.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    told = told.withColumn("_gl_maybe", maybe)
    return tuple(told.where(F.col("_gl_maybe") if m else ~F.col("_gl_maybe")).drop("_gl_k", "_gl_part", "_gl_maybe") for m in (True, False))


def bucket_count(partitions: int) -> int:
    """Buckets of :func:`packed`: some to a partition where there are few, so that a task holds a part of its partition at a time."""
    return partitions * max(1, 2048 // partitions)


def packed(kind: int, key: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows dealt to buckets by key, the columns of each bucket as bytes: (kind, bucket, data). The JVM moves them without looking at rows."""
    with np.errstate(over="ignore"):
        mixed = key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (mixed >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(at, kind="stable")
    edge = np.flatnonzero(np.diff(at[order], prepend=-1)).tolist()
    columns = [c[order] for c in columns]
    data = [b"".join(c[a:e].tobytes() for c in columns) for a, e in zip(edge, [*edge[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), kind, np.int8)), pa.array(at[order][edge].astype(np.int32)), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


def buckets_of(batches: Iterator[pa.RecordBatch], types: dict[int, list]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns) of each bucket of batches sorted by bucket; ``types``: the columns' types by kind."""
    held: dict[int, list[bytes]] = {}
    now = None

    def whole():
        for kind, blobs in sorted(held.items()):
            parts = []
            for raw in blobs:
                n, off, own = len(raw) // sum(np.dtype(t).itemsize for t in types[kind]), 0, []
                for t in types[kind]:
                    own.append(np.frombuffer(raw, t, n, off))
                    off += n * np.dtype(t).itemsize
                parts.append(own)
            yield kind, [np.concatenate(c) for c in zip(*parts)]
        held.clear()

    for b in batches:
        for kind, bucket, raw in zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist(), b.column("data").to_pylist()):
            if bucket != now:
                yield from whole()
                now = bucket
            held.setdefault(kind, []).append(raw)
    yield from whole()


PACKED = "kind byte, bucket int, data binary"


def dealt(df: DataFrame) -> DataFrame:
    """Packed rows by bucket."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


#: Bytes of a batch that goes to or from Python, so that very long texts don't fill a worker.
BATCH_BYTES = 8 << 20
#: How to drop what each operator keeps in a worker from task to task.
KEPT: dict[str, Callable[[], None]] = {}


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return None


def give_back() -> None:
    """Returns freed memory to the system: a worker's allocators hold it from task to task otherwise, beside the JVM and the other workers."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def pieces_of(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes (a row at least)."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    if rows >= batch.num_rows:
        yield batch
        return
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Alone:
    """A function on batches that first drops what other operators keep, gives its results in batches of bounded size, and gives back what it freed.

    A class, so that workers use their own ``KEPT``.
    """

    def __init__(self, fn, keeps: str) -> None:
        self.fn, self.keeps = fn, keeps

    def __call__(self, batches):
        for name, drop in KEPT.items():
            if name != self.keeps:
                drop()
        give_back()
        batch = None
        for batch in self.fn(batches):
            yield from pieces_of(batch)
        del batch
        give_back()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size.

    Workers that don't know this package look where the driver found it. What operators other than ``keeps`` have
    left in a worker goes when it starts.
    """
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(Alone(fn, keeps), schema)
