"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, label_min, map_arrow


#: Edges of a task; with few edges there are few tasks, whatever the number of shuffle partitions.
TASK_EDGES = 100_000


#: Edges that are contracted together before the first shuffle.
PIECE = 1 << 20


def _contract(batches):
    """Edges of a piece of the input as stars around the smallest node of each of its components: at most one edge a node."""
    held, count = [], 0

    def stars():
        u, v = (np.concatenate(c) for c in zip(*held))
        held.clear()
        names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = label_min(len(names), at[: len(u)], at[len(u) :])
        node = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[label[node]])], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in ("u", "v")))
            count += b.num_rows
            if count >= PIECE:
                yield stars()
                count = 0
    if held:
        yield stars()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)``, longs, to ``(node, comp)``: comp is the smallest node reachable; nodes without edges are absent.

    Edges are contracted in each piece of the input first, so a hub reaches the shuffles at most once a piece and node.

    Alternating large-star and small-star steps: every step keeps at most as many edges as there were, sums up on
    the map side, and is written to the shared checkpoint folder, so neither links nor components reach the driver;
    only a count and a checksum do. Loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    cur = cut(map_arrow(pairs, _contract, "u long, v long").distinct())
    mark = None
    for _ in range(max_rounds):
        new = _sign(cur)
        if new == mark or new[0] == 0:
            break
        mark = new
        tasks = 1 + new[0] // TASK_EDGES
        cur = cur.coalesce(tasks)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).coalesce(2 * tasks)
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m").coalesce(tasks)
        small = large.join(low, large.u == low.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]
