"""Embedding near-duplicates by the epsilon grid order join.

Unit vectors are sorted by the grid cells (side epsilon) of their leading principal dimensions and cut into blocks, so
that a block is an interval of that order. A tree over the intervals is joined with itself from the root down, two
intervals whose boxes are more than epsilon apart are skipped with all that is below them, and the intervals that
remain at the bottom are joined in the same recursive way inside a task. cos >= c is distance <= sqrt(2 - 2c).

Blocks lie in the shared folder. The pairs that remain are dealt in tiles of ``TILE`` by ``TILE`` blocks, and a task
reads each block of a tile once, so no vector is shuffled after it has been put in order.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, label_min, map_arrow, shared_dir, stored
from .components import connected_components
from .vectors import SAMPLE, BlockReader, BlockWriter, axes_of, leading, numbered, units, usable

COSINE = 0.9
#: Distinct vectors of a block, of an interval joined at once inside a task, children of an interval of the tree, blocks of a side of a tile.
BLOCK, STEP, FAN, TILE = 2048, 256, 8, 8
#: Principal dimensions of the boxes, and those that make cells.
BOX, CELLS = 8, 4


def _valid(batches):
    """(vec_id, key, k1, k2): the bytes of a vector that can link, else null, and 128 bits of their hash."""
    for b in batches:
        keys = [None if v is None or not v.any() else v.tobytes() for v in usable(b.column(1))]
        hashes = [None if k is None else xxhash.xxh3_128_digest(k) for k in keys]
        halves = (pa.array([None if h is None else int.from_bytes(h[i : i + 8], "little", signed=True) for h in hashes], pa.int64()) for i in (0, 8))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), *halves], names=["vec_id", "key", "k1", "k2"])


def _cells(axes, eps):
    def run(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            cells = np.zeros((len(keys), CELLS), np.int64)
            dims = np.array([len(k) // 8 for k in keys], np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cells[at] = np.floor(leading(units(np.frombuffer(b"".join(keys[i] for i in at)).reshape(-1, dim)), axes, CELLS) / eps)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "k1", "k2", "weight")), pa.array(dims), *(pa.array(cells[:, k]) for k in range(CELLS))], names=["key", "k1", "k2", "weight", "dim", *(f"c{k}" for k in range(CELLS))])

    return run


BOXES = [f"{x}{k}" for x in ("lo", "hi") for k in range(BOX)]
PLACE = "uri string, off long, size long"


def _blocks(axes, out, block):
    """Writes the blocks of a partition; one row each: its place and box, and the hashes of its vectors."""

    def run(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        writer = BlockWriter(out, part)

        def pack():
            nonlocal seq, held
            x = np.frombuffer(b"".join(h[0] for h in held)).reshape(len(held), -1)
            y = leading(units(x), axes, BOX)
            weights = np.array([h[3] for h in held], np.int64)
            place = writer.add(weights, x)
            row = [part, seq, x.shape[1], *place, *(np.array([h[i] for h in held], np.int64).tobytes() for i in (1, 2)), weights.tobytes(), *y.min(0).tolist(), *y.max(0).tolist()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * (2 * BOX)]
            seq, held = seq + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "seq", "dim", "uri", "off", "size", "k1", "k2", "weights", *BOXES])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "k1", "k2", "weight"))):
                if held and (len(held) == block or len(held[0][0]) != len(row[0])):
                    yield pack()
                held.append(row)
        if held:
            yield pack()
        writer.close()

    return run


def _decode(axes):
    def decode(data: bytes, dim: int):
        n = len(data) // (8 * dim + 8)
        u = units(np.frombuffer(data, np.float64, offset=8 * n).reshape(n, dim))
        return u, leading(u, axes, BOX), np.frombuffer(data, np.int64, n)

    return decode


def join_intervals(u1, y1, u2, y2, same: bool, cosine: float, step: int = STEP):
    """Index pairs (i, j) with cos >= ``cosine`` of two intervals (i < j where they are the same), in pieces."""
    eps2 = 2 - 2 * cosine + 1e-9
    f1, f2 = u1.astype(np.float32), u2.astype(np.float32)
    loose = np.float32(cosine - 1e-6 - 2e-7 * u1.shape[1])
    todo = [(0, len(u1), 0, len(u2))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        gap = np.maximum(0, np.maximum(y1[a:b].min(0) - y2[c:d].max(0), y2[c:d].min(0) - y1[a:b].max(0)))
        if gap @ gap > eps2:
            continue
        if b - a <= step and d - c <= step:
            i, j = np.nonzero(f1[a:b] @ f2[c:d].T >= loose)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65536):
                x, y = i[at : at + 65536], j[at : at + 65536]
                ok = np.einsum("nd,nd->n", u1[x], u2[y]) >= cosine
                if ok.any():
                    yield x[ok], y[ok]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(m, b, c, d), (a, m, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, m, d), (a, b, c, m)]


def _join(axes, cosine, block):
    """Rows (lin1, place1, lin2, place2, dim) of a tile to links: (u, v) joins two nodes, n counts u's."""

    def run(batches):
        reader = BlockReader(_decode(axes), TILE + 2)
        for batch in batches:
            for l1, uri1, off1, size1, l2, uri2, off2, size2, dim in zip(*(batch.column(c).to_pylist() for c in ("l1", "uri1", "off1", "size1", "l2", "uri2", "off2", "size2", "dim"))):
                same = l1 == l2
                u1, y1, w1 = reader.get(uri1, off1, size1, dim)
                u2, y2, w2 = (u1, y1, w1) if same else reader.get(uri2, off2, size2, dim)
                n1, n2 = np.zeros(len(u1), np.int64), np.zeros(len(u2), np.int64)
                off = 0 if same else len(u1)
                label = np.arange(off + len(u2))
                for i, j in join_intervals(u1, y1, u2, y2, same, cosine):
                    np.add.at(n1, i, w2[j])
                    np.add.at(n1 if same else n2, j, w1[i])
                    child = np.flatnonzero(label != np.arange(len(label)))
                    label = label_min(len(label), np.concatenate((i, child)), np.concatenate((j + off, label[child])))
                node = np.concatenate((l1 * block + np.arange(len(u1)), [] if same else l2 * block + np.arange(len(u2)))).astype(np.int64)
                n = n1 if same else np.concatenate((n1, n2))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]]), pa.array(n[at])], names=["u", "v", "n"])

    return run


def _interval_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """Pairs of blocks (l1 <= l2) that may hold a link, by a join of the tree of intervals with itself."""
    top = blocks.agg(F.max("lin").alias("l")).first()["l"] or 0
    height = 0
    while FAN**height <= top:
        height += 1
    eps2 = 2 - 2 * cosine + 1e-9
    boxes = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(BOX)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(BOX)]

    def level(h: int) -> DataFrame:
        return blocks.groupBy(F.expr(f"lin div {FAN**h}").alias("l")).agg(F.min("dim").alias("d0"), F.max("dim").alias("d1"), *boxes).withColumn("up", F.expr(f"l div {FAN}"))

    pairs = level(height).select(F.col("l").alias("l1"), F.col("l").alias("l2")).distinct()
    for h in range(height - 1, -1, -1):
        child = level(h)
        one, two = (child.select(*(F.col(c).alias(f"{x}_{c}") for c in child.columns)) for x in "xy")
        gap = [F.greatest(F.lit(0.0), F.col(f"x_lo{k}") - F.col(f"y_hi{k}"), F.col(f"y_lo{k}") - F.col(f"x_hi{k}")) for k in range(BOX)]
        far = sum((g * g for g in gap), F.lit(0.0))
        pairs = pairs.join(one, F.expr("l1 = x_up")).join(two, F.expr("l2 = y_up and x_l <= y_l and x_d0 <= y_d1 and y_d0 <= x_d1") & (far <= eps2)).select(F.col("x_l").alias("l1"), F.col("y_l").alias("l2"))
    return pairs


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of
    different lengths. Equal vectors are joined once and counted as often as they occur. Repeated rows are vectors of
    their own; a null vec_id is a vector too and never names a component that has another. No rows give no rows.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    eps = math.sqrt(2 - 2 * cosine)
    out = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows, place = stored(map_arrow(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), embedding), _valid, "vec_id long, key binary, k1 long, k2 long"))
    distinct = rows.where("key is not null").groupBy("k1", "k2").agg(F.first("key").alias("key"), F.count("*").alias("weight"))
    some = rows.where("key is not null").select("k1", "k2", "key").orderBy("k1", "k2").limit(SAMPLE)
    axes = axes_of([units(np.frombuffer(r["key"])[None, :])[0] for r in some.collect()], BOX)
    celled = map_arrow(distinct, _cells(axes, eps), "key binary, k1 long, k2 long, weight long, dim int, " + ", ".join(f"c{k} long" for k in range(CELLS)))
    order = ["dim", *(f"c{k}" for k in range(CELLS)), "k1", "k2"]
    blocks = map_arrow(celled.repartitionByRange(n, *order).sortWithinPartitions(*order), _blocks(axes, out, block), f"part long, seq long, dim int, {PLACE}, k1 binary, k2 binary, weights binary, " + ", ".join(f"{c} double" for c in BOXES))
    blocks = cut(numbered(cut(blocks)))
    pairs = _interval_pairs(blocks.select("lin", "dim", *BOXES), cosine)
    one, two = (blocks.select(F.col("lin").alias(f"b{k}"), F.col("dim").alias(f"dim{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("uri", "off", "size"))) for k in "12")
    met = pairs.join(one, F.expr("l1 = b1")).join(two, F.expr("l2 = b2 and dim1 = dim2")).withColumn("dim", F.col("dim1"))
    met = met.withColumn("tile", F.xxhash64(F.expr(f"l1 div {TILE}"), F.expr(f"l2 div {TILE}"))).repartition(n, "tile").sortWithinPartitions("tile", "l1", "l2")
    found = cut(map_arrow(met, _join(axes, cosine, block), "u long, v long, n long"))
    comps = connected_components(found.select("u", "v"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    nodes = map_arrow(blocks.select("lin", "k1", "k2", "weights"), _nodes(block), "node long, n1 long, n2 long, weight long")
    facts = nodes.join(links, "node", "left").join(comps, "node", "left")
    facts = facts.select("n1", "n2", F.coalesce("comp", "node").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    all_ = cut(rows.select("vec_id", "k1", "k2").join(facts, F.expr("k1 = n1 and k2 = n2"), "left").select("vec_id", "comp", F.coalesce("n", F.lit(0)).cast("long").alias("n_links")))
    discard(spark, place, out)
    low = all_.where("comp is not null").groupBy(F.col("comp").alias("c")).agg(F.min("vec_id").alias("component_id"))
    result = all_.join(low, F.expr("comp = c"), "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return result.select("vec_id", "n_links", "component_id", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)).alias("kept"))


def _nodes(block):
    def run(batches):
        for b in batches:
            for lin, *packed in zip(*(c.to_pylist() for c in b.columns)):
                own = [np.frombuffer(x, np.int64) for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array(lin * block + np.arange(len(own[0]))), *map(pa.array, own)], names=["node", "n1", "n2", "weight"])

    return run
