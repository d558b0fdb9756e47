"""Vectors packed into blocks, for the operators that compare embeddings.

Blocks lie in files of the shared folder; only their places, boxes and counts are rows of frames. A task reads the
blocks that it needs, so vectors are shuffled once, into their order, however many blocks each one meets.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_frames import open_fs

#: Vectors that the axes are fitted on. They steer what can be skipped, never what is found.
SAMPLE = 8192
MAX_AXES = 2048


def usable(column: pa.Array, offset: int = 0) -> list[np.ndarray | None]:
    """Each row's vector as doubles; None for null rows, empty ones and those with a null or non-finite component."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    flat = column.flatten().cast(pa.float64())
    ends = np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))))
    values = flat.to_numpy(zero_copy_only=False)
    ok = np.isfinite(values)
    if flat.null_count:
        ok &= ~np.asarray(flat.is_null())
    bad = np.concatenate(([0], np.cumsum(~ok)))
    valid = np.asarray(column.is_valid())
    return [values[a:b] if v and b > a and bad[a] == bad[b] else None for a, b, v in zip(ends[:-1].tolist(), ends[1:].tolist(), valid.tolist())]


def unpack(data: bytes, dim: int, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(data, dtype).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_of(rows: list[np.ndarray], most: int | None = None) -> dict[int, np.ndarray]:
    """The principal axes [dim][dim, or the leading ``most``] of the sampled vectors of each length, by falling variance."""
    by: dict[int, list] = {}
    for x in rows:
        by.setdefault(len(x), []).append(x)
    out = {}
    for dim, own in by.items():
        if dim <= MAX_AXES:
            u = np.stack(own)
            _, vec = np.linalg.eigh(np.cov(u.T).reshape(dim, dim) if len(u) > 1 else np.eye(dim))
            out[dim] = np.ascontiguousarray(vec[:, ::-1][:, :most])
    return out


def leading(x: np.ndarray, axes: dict[int, np.ndarray], most: int) -> np.ndarray:
    """Coordinates on the leading axes, [n][most]; zero where there are fewer dimensions. Distances only shrink."""
    dim = x.shape[1]
    y = x @ axes[dim][:, :most] if dim in axes else x[:, :most]
    return np.pad(y, ((0, 0), (0, most - y.shape[1])))


class BlockWriter:
    """Appends blocks to one file of a task; a task that runs again writes another file, and only one's places are told."""

    def __init__(self, out: str, part: int) -> None:
        self.uri, self.file, self.at = f"{out}/{part:06d}-{uuid.uuid4().hex}", None, 0

    def add(self, *arrays: np.ndarray) -> tuple[str, int, int]:
        if self.file is None:
            fs, path = open_fs(self.uri)
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.file = fs.open_output_stream(path)
        data = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
        self.file.write(data)
        self.at += len(data)
        return self.uri, self.at - len(data), len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class BlockReader:
    """Reads blocks and keeps those of the last ``most`` that were decoded."""

    def __init__(self, decode, most: int) -> None:
        self.decode, self.most = decode, most
        self.kept: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def get(self, uri: str, offset: int, size: int, dim: int):
        key = (uri, offset)
        if key not in self.kept:
            if uri not in self.files:
                fs, path = open_fs(uri)
                self.files[uri] = fs.open_input_file(path)
                if len(self.files) > 16:
                    self.files.popitem(last=False)[1].close()
            self.kept[key] = self.decode(self.files[uri].read_at(size, offset), dim)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]


def numbered(blocks: DataFrame) -> DataFrame:
    """``blocks(part, seq, ...)`` with ``lin``, their number in the order; the driver holds one count a partition."""
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    at, rows = 0, []
    for part in sorted(counts):
        rows.append((part, at))
        at += counts[part]
    first = blocks.sparkSession.createDataFrame(rows, "part long, first long")
    return blocks.join(F.broadcast(first), "part").withColumn("lin", F.col("first") + F.col("seq")).drop("first")
