"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

Coordinates are taken on the principal axes, so that segments hold dimensions of like variance, the leading ones in the
shortest segments. For a segment of length L with means m and deviations s of a query and a candidate, their inner
product is at most L * (m m' + s s') (Cauchy-Schwarz on the centred parts), the counterpart of the lower bound of the
distance. Rows are put in the order of their leading coordinates and cut into blocks; each query's tenth score in its
own block is its first floor. A block of candidates whose box no query of a group can reach is skipped before anything
of it is read; inside a block the box, the coarse and the fine segments drop queries and candidates, and what is left
is scored exactly.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, discard, map_arrow, shared_dir, stored
from .vectors import SAMPLE, BlockReader, BlockWriter, axes_of, leading, numbered, usable

SCALE = 1024
TOP = 10
EVERY = 100
#: Vectors of a block, blocks whose queries form a group, and ranges of candidate blocks that a group meets in tasks of their own.
BLOCK, GROUP, RANGES = 4096, 64, 64
STEP = 512
COARSE, FINE = 6, 16
#: Leading coordinates of the boxes, and those that make cells of the order.
BOX, CELLS = 8, 4
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def segment_edges(dim: int, segments: int) -> np.ndarray:
    """Borders of segments that grow from the leading coordinate to the last."""
    return np.unique(np.round(np.concatenate(([0], np.geomspace(1, dim, segments)[: max(0, segments - 1)], [dim]))).astype(int))


def segment_stats(y: np.ndarray, segments: int) -> np.ndarray:
    """[n][2 * segments]: sqrt(L) * mean and sqrt(L) * deviation of each segment, so that a bound is one inner product."""
    edges = segment_edges(y.shape[1], segments)
    size = np.diff(edges)
    mean = np.add.reduceat(y, edges[:-1], axis=1) / size
    square = np.add.reduceat(y * y, edges[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean * size, 0))], 1)


def rotated(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """All coordinates on the principal axes; where none are known, as they are."""
    return x @ axes[x.shape[1]] if x.shape[1] in axes else x


def boxed(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading coordinates [n][BOX], length of the rest)."""
    head = np.pad(y[:, :BOX], ((0, 0), (0, max(0, BOX - y.shape[1]))))
    return head, np.sqrt((y[:, BOX:] ** 2).sum(1))


def box_bound(head: np.ndarray, rest: np.ndarray, low: np.ndarray, high: np.ndarray, far: float) -> np.ndarray:
    """For each query the most that its inner product with anything in the box can be."""
    return np.maximum(head * low, head * high).sum(1) + rest * far


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs, exact; beyond a long's range its bounds."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if largest < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(exact, LEAST + 1, MOST).astype(np.int64)


def nth_score(score: np.ndarray, top: int) -> np.ndarray:
    """The ``top``-th largest score of each row, or less than any where there are fewer."""
    if score.shape[1] < top:
        return np.full(len(score), LEAST)
    return np.partition(score, score.shape[1] - top, axis=1)[:, -top]


class Best:
    """The best ``top`` of some queries so far, and how many candidates each bound left."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, floors: np.ndarray, axes, top: int = TOP) -> None:
        self.q, self.own, self.ids, self.floor, self.top = queries, own, ids, floors.copy(), top
        self.y = rotated(queries, axes)
        self.head, self.rest = boxed(self.y)
        self.stats = [segment_stats(self.y, k) for k in (COARSE, FINE)]
        self.score = np.full((len(queries), top), LEAST)
        self.cand = np.full((len(queries), top), MOST)
        self.pairs = {"all": 0, "box": 0, "coarse": 0, "fine": 0, "scored": 0}

    def meet(self, x: np.ndarray, ids: np.ndarray, own: np.ndarray, box, axes) -> None:
        """Takes the candidates of a block in; ``box``: (low, high, largest rest)."""
        slack = 1e-9 * float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] + 1e-6
        self.pairs["all"] += len(self.q) * len(x)
        may = np.flatnonzero(box_bound(self.head, self.rest, *box) + slack >= self.floor)
        self.pairs["box"] += len(may) * len(x)
        if not len(may):
            return
        y = rotated(x, axes)
        stats = [segment_stats(y, k) for k in (COARSE, FINE)]
        for at in range(0, len(x), STEP):
            cols, rows = np.arange(at, min(at + STEP, len(x))), may
            for name, q_stats, x_stats in zip(("coarse", "fine"), self.stats, stats):
                left = q_stats[rows] @ x_stats[cols].T + slack >= self.floor[rows].astype(float)[:, None]
                self.pairs[name] += int(left.sum())
                rows, cols = rows[left.any(1)], cols[left.any(0)]
                if not len(rows):
                    break
            if not len(rows):
                continue
            self.pairs["scored"] += len(rows) * len(cols)
            self._add(rows, products(self.q[rows], x[cols]), ids[cols], own[cols])

    def _add(self, rows, score, ids, own) -> None:
        same = self.own[rows][:, None] == own[None, :]
        score[same] = LEAST
        order = np.argsort(ids, kind="stable")
        score, cand = score[:, order], np.broadcast_to(ids[order], score.shape)
        keep = score >= np.maximum(nth_score(score, self.top), self.floor[rows])[:, None]
        keep &= score > LEAST
        width = int(keep.sum(1).max())
        if not width:
            return
        pick = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        score = np.where(np.take_along_axis(keep, pick, 1), np.take_along_axis(score, pick, 1), LEAST)
        cand = np.where(score > LEAST, np.take_along_axis(cand, pick, 1), MOST)
        s, c = np.concatenate([self.score[rows], score], 1), np.concatenate([self.cand[rows], cand], 1)
        first = np.lexsort((c, ~s), axis=1)[:, : self.top]  # ~s falls as s grows, and has no overflow
        self.score[rows], self.cand[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(c, first, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])

    def found(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.own[row], self.ids[row], self.cand[row, col], self.score[row, col])], names=["q", "query_id", "vec_id", "score"])


def _cells(axes, cell):
    def run(batches):
        for b in batches:
            ids, vectors = b.column(0).to_pylist(), usable(b.column(1))
            use = [k for k, (i, v) in enumerate(zip(ids, vectors)) if i is not None and v is not None]
            dims = np.array([len(vectors[k]) for k in use], np.int32)
            cells = np.zeros((len(use), CELLS), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                y = leading(np.stack([vectors[use[k]] for k in at]), axes, CELLS) / cell.get(dim, 1.0)
                cells[at] = np.clip(np.floor(y), -(2.0**62), 2.0**62).astype(np.int64)
            data = [np.floor(SCALE * vectors[k]).tobytes() for k in use]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in use], pa.int64()), pa.array(dims), pa.array(data, pa.binary()), *(pa.array(cells[:, k]) for k in range(CELLS))], names=["vec_id", "dim", "data", *(f"c{k}" for k in range(CELLS))])

    return run


BOXES = [f"{x}{k}" for x in ("lo", "hi") for k in range(BOX)]
SPOT = "uri string, off long, size long"


def _blocks(axes, out, every, top, block):
    """Writes blocks of all rows and, beside them, their queries with first floors; one row each with places and boxes."""

    def run(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        writer, questions = BlockWriter(f"{out}/rows", part), BlockWriter(f"{out}/queries", part)

        def pack():
            nonlocal seq, held
            ids = np.array([h[0] for h in held], np.int64)
            x = np.frombuffer(b"".join(h[1] for h in held)).reshape(len(held), -1)
            head, rest = boxed(rotated(x, axes))
            place = writer.add(ids, x)
            at = np.flatnonzero(ids % every == 0)
            own = [None] * 4 + [0.0, 0.0] + [0.0] * (2 * BOX)
            if len(at):
                floors = np.empty(len(at), np.int64)
                for a in range(0, len(at), STEP):
                    score = products(x[at[a : a + STEP]], x)
                    score[np.arange(len(score)), at[a : a + STEP]] = LEAST
                    floors[a : a + STEP] = nth_score(score, top)
                own = [len(at), *questions.add(at.astype(np.int64), ids[at], floors, x[at]), float(rest[at].max()), float(floors.min()), *head[at].min(0).tolist(), *head[at].max(0).tolist()]
            row = [part, seq, x.shape[1], *place, float(rest.max()), *head.min(0).tolist(), *head.max(0).tolist(), *own]
            seq, held = seq + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for b in batches:
            for i, dim, data in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "data"))):
                if held and (len(held) == block or len(held[0][1]) != len(data)):
                    yield pack()
                held.append((i, data))
        if held:
            yield pack()
        writer.close()
        questions.close()

    place = [pa.string(), pa.int64(), pa.int64()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *place, *[pa.float64()] * (1 + 2 * BOX), pa.int64(), *place, *[pa.float64()] * (2 + 2 * BOX)]
    names = ["part", "seq", "dim", "uri", "off", "size", "far", *BOXES, "qn", "quri", "qoff", "qsize", "qfar", "floor", *(f"q{b}" for b in BOXES)]
    return run


BLOCKS = f"part long, seq long, dim int, {SPOT}, far double, {', '.join(f'{b} double' for b in BOXES)}, qn long, quri string, qoff long, qsize long, qfar double, floor double, {', '.join(f'q{b} double' for b in BOXES)}"


def _answers(axes, top, block):
    """Rows of a group and a range: first the places of the group's queries, then those of candidate blocks, in order."""

    def run(batches):
        rows = BlockReader(lambda data, dim: (np.frombuffer(data, np.int64, len(data) // (8 * dim + 8)), np.frombuffer(data, np.float64, offset=8 * (len(data) // (8 * dim + 8))).reshape(-1, dim)), 1)
        asked = BlockReader(lambda data, dim: data, 1)
        now, best, held = None, {}, {}

        def begin():
            for dim, own in held.items():
                parts = []
                for lin, raw in own:
                    n = len(raw) // (8 * dim + 24)
                    at, ids, floors = np.frombuffer(raw, np.int64, 3 * n).reshape(3, n)
                    parts.append((lin * block + at, ids, floors, np.frombuffer(raw, np.float64, offset=24 * n).reshape(n, dim)))
                own_, ids, floors, x = (np.concatenate(c) for c in zip(*parts))
                best[dim] = Best(x, own_, ids, floors, axes, top)
            held.clear()

        for b in batches:
            box = np.stack([b.column(c).to_numpy() for c in BOXES], 1)
            for k, (g, r, kind, lin, dim, uri, off, size, far) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "r", "kind", "lin", "dim", "uri", "off", "size", "far")))):
                if (g, r) != now:
                    yield from (x.found() for x in best.values())
                    now, best, held = (g, r), {}, {}
                if kind == 0:
                    held.setdefault(dim, []).append((lin, asked.get(uri, off, size, dim)))
                    continue
                if held:
                    begin()
                if dim in best:
                    ids, x = rows.get(uri, off, size, dim)
                    best[dim].meet(x, ids, lin * block + np.arange(len(ids)), (box[k, :BOX], box[k, BOX:], far), axes)
        yield from (x.found() for x in best.values())

    return run


def block_pairs(blocks: DataFrame, groups: int) -> DataFrame:
    """(g, b): groups of queries and candidate blocks that their boxes do not keep apart."""
    corner = lambda f, name: [f(name.format(k=k)).alias(name.format(k=k)) for k in range(BOX)]
    asked = blocks.where("qn > 0").groupBy(F.expr(f"lin div {GROUP}").alias("g")).agg(F.min("dim").alias("d0"), F.max("dim").alias("d1"), F.max("qfar").alias("qfar"), F.min("floor").alias("floor"), *corner(F.min, "qlo{k}"), *corner(F.max, "qhi{k}"))
    terms = [F.greatest(*(F.col(f"q{a}{k}") * F.col(f"{b}{k}") for a in ("lo", "hi") for b in ("lo", "hi"))) for k in range(BOX)]
    bound = sum(terms, F.col("qfar") * F.col("far"))
    slack = 1e-9 * F.abs(bound) + 1e-6 * (1 + F.col("qfar") * F.col("far")) + sum((1e-9 * F.abs(t) for t in terms), F.lit(0.0))
    near = (F.col("d0") < F.col("d1")) | (bound + slack >= F.col("floor"))
    each = blocks.select("lin", "dim", "far", *BOXES, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("bg"))
    return each.join(asked, F.expr("bg = g and dim between d0 and d1")).where(near).select("g", F.col("lin").alias("b"))


def top_products(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of the ``top`` largest inner products.

    Components are floor(1024 * x), as double; a product beyond the range of a long counts as that range's end. Ties go
    to the smaller vec_id; a repeated vec_id is a row of its own, and a row is only kept from meeting itself. Vectors that
    are null, empty or hold a null or non-finite component, and rows without an id, take no part; vectors of different
    lengths never meet. No queries give no rows.

    Rows are shuffled once, into the order of the blocks. Tasks then read blocks from the shared folder; a group of
    queries meets at most ``RANGES`` ranges of candidate blocks in tasks of their own, and only each task's best
    ``top`` of a query are shuffled again.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    some = slim.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = [v for c in some.column(0).chunks for v in usable(c) if v is not None]
    axes = axes_of([SCALE * v for v in sample])
    cell = {d: max(1e-300, float(np.std(np.stack([v for v in sample if len(v) == d]) @ axes[d][:, 0])) / 2) for d in axes}
    order = ["dim", *(f"c{k}" for k in range(CELLS)), "vec_id", "tie"]
    celled = map_arrow(slim, _cells(axes, cell), "vec_id long, dim int, data binary, " + ", ".join(f"c{k} long" for k in range(CELLS))).withColumn("tie", F.xxhash64("data"))
    blocks = cut(numbered(cut(map_arrow(celled.repartitionByRange(n, *order).sortWithinPartitions(*order), _blocks(axes, out, every, top, block), BLOCKS))))
    count = blocks.agg(F.max("lin").alias("l")).first()["l"]
    if count is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranges = max(1, min(RANGES, (count + 1) // 16))
    pairs = block_pairs(blocks, count // GROUP + 1)
    place = ("lin", "dim", "uri", "off", "size", "far", *BOXES)
    rows = pairs.join(blocks.select(*place), F.expr("b = lin")).select("g", F.expr(f"lin * {ranges} div {count + 1}").alias("r"), F.lit(1).alias("kind"), *place)
    asked = blocks.where("qn > 0").select(F.expr(f"lin div {GROUP}").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("r"), F.lit(0).alias("kind"), "lin", "dim", F.col("quri").alias("uri"), F.col("qoff").alias("off"), F.col("qsize").alias("size"), "far", *BOXES)
    dealt = rows.unionByName(asked).repartition(n, "g", "r").sortWithinPartitions("g", "r", "kind", "lin")
    scored, kept = stored(map_arrow(dealt, _answers(axes, top, block), "q long, query_id long, vec_id long, score long"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = cut(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    discard(spark, out, kept)
    return ranked
