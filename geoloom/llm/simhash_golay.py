"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four exact segments of 16 bits and, for each, two halves of 24 bits of the rest.
Three differing bits leave one segment untouched, and one of its two halves then has one differing bit at most. A
half is decoded by the perfect [23,12,7] Golay code: a word and any word one bit away from it share the first one's
nearest codeword among their codewords at distance four or less (one or six for any word). So each fingerprint has
eight "near" keys and up to 48 "list" keys, and two fingerprints within three bits meet where one is near.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import PACKED, binary_list, bucket_count, buckets_of, cut, dealt, expand_pairs, group_starts, label_min, map_arrow, packed, suspected, whole_groups
from .components import connected_components
from .paragraph_dedup import near_texts

SEED = 42
MAX_BITS = 3
#: Rows of one block of a key; a key with more is dealt out in pairs of blocks.
BLOCK = 2048


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of every 12-bit part in its place: [2][4096], error patterns of weight <= 4 by syndrome: [2048][6])."""
    poly = 0b110001110101
    column = []
    x = 1
    for _ in range(23):
        column.append(x)
        x <<= 1
        if x >> 11 & 1:
            x ^= poly
    part = np.zeros((2, 4096), np.int64)
    for place in (0, 1):
        for i in range(12):
            if place * 12 + i < 23:
                has = (np.arange(4096) >> i & 1).astype(bool)
                part[place][has] ^= column[place * 12 + i]
    lists: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for i in at:
                s ^= column[i]
            lists[s].append(sum(1 << i for i in at))
    return part, np.array([(x + [x[0]] * 6)[:6] for x in lists], np.int64)


def codewords(words: np.ndarray) -> np.ndarray:
    """For 23-bit words: indices (12 bits) of the nearest codeword, then of all others within four bits; [n][6], repeats fill up."""
    part, errors = golay()
    s = part[0][words & 4095] ^ part[1][words >> 12]
    return (words[:, None] ^ errors[s]) >> 11


def fuzzy_keys(fps: np.ndarray) -> np.ndarray:
    """[n][8][6] keys of uint64 fingerprints; [:, :, 0] are the near keys."""
    out = np.empty((len(fps), 8, 6), np.int64)
    seg = [((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i in range(4):
        rest = [seg[j] for j in range(4) if j != i]
        halves = (rest[0] | (rest[1] & 0xFF) << 16, rest[1] >> 8 | rest[2] << 8)
        for h, x in enumerate(halves):
            out[:, 2 * i + h] = (2 * i + h) << 28 | (seg[i] << 12)[:, None] | codewords(x & 0x7FFFFF)
    return out


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        n = len(words) - width + 1
        hashes = [h(line[i:j], SEED) for i, j in zip(begins[:n].tolist(), (ends[width - 1 :] - 1).tolist())]
    x = np.array(hashes, np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(x), 1 << 16):
        bits += np.unpackbits(x[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(x), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        fps = np.fromiter(map(fingerprint, binary_list(b.column(1))), np.uint64, b.num_rows).view(np.int64)
        more = [b.column(i) for i in range(2, b.num_columns)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *more], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text over its three-word shingles, as a signed long."""
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), _fingerprints, "doc_id long, fp long")


KEY_TYPES = {0: [np.int64, np.int64, np.int8]}


def _keys(buckets: int):
    """Keys of distinct fingerprints, packed by key."""

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 16384):
                part = fps[at : at + 16384]
                k = fuzzy_keys(part.view(np.uint64))
                use = np.ones(k.shape, bool)
                use[:, :, 1:] = k[:, :, 1:] != k[:, :, :1]
                near = np.zeros(k.shape, np.int8)
                near[:, :, 0] = 1
                yield packed(0, k[use], [k[use], np.broadcast_to(part[:, None, None], k.shape)[use], near[use]], buckets)

    return run


def group_links(fps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[links][2]: a forest over groups of fingerprints that begin at ``starts``, whose components are those of "differ in three bits or fewer"."""
    sizes = np.diff(np.append(starts, len(fps)))
    small = sizes <= 64
    a, b = expand_pairs(starts[small], sizes[small])
    hit = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
    pairs = [(a[hit], b[hit])]
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        own = fps[s : s + n]
        for at in range(0, n, 256):
            x, y = np.nonzero(np.bitwise_count(own[at : at + 256, None] ^ own[None, :]) <= MAX_BITS)
            keep = x + at < y
            forest = label_min(n, x[keep] + at, y[keep])
            child = np.flatnonzero(forest != np.arange(n))
            pairs.append((child + s, forest[child] + s))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    label = label_min(len(fps), a, b)
    at = np.flatnonzero(label != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return np.unique(np.stack([signed[at], signed[label[at]]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)


def _bucket_links(block: int):
    """(u, v, key) of whole keys: links, with no key; of a key of more than ``block`` fingerprints these, as u, with the key."""

    def run(batches):
        for _, (key, fps, near) in buckets_of(batches, KEY_TYPES):
            order = np.argsort(key, kind="stable")
            key, fps, near = key[order], fps[order], near[order]
            start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.diff(np.append(start, len(key)))
            use = (size > 1) & (np.add.reduceat(near, start, dtype=np.int64) > 0)
            row = np.repeat(use & (size <= block), size)
            n = size[use & (size <= block)]
            uv = group_links(fps[row].view(np.uint64), np.cumsum(n) - n) if len(n) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1]), pa.nulls(len(uv), pa.int64())], names=["u", "v", "key"])
            row = np.repeat(use & (size > block), size)
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.nulls(int(row.sum()), pa.int64()), pa.array(key[row])], names=["u", "v", "key"])

    return run


def _links(batches):
    for t in whole_groups(batches, ["key", "i", "j"]):
        uv = group_links(t.column("fp").to_numpy().view(np.uint64), group_starts(t, ["key", "i", "j"]))
        yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``fps(fp)`` (a written frame) to edges (u, v) whose components are those of "differ in three bits or fewer".

    Each bucket gives at most one edge a row (a forest of its links), never all its pairs. A key of more than
    ``block`` fingerprints is dealt out as pairs of blocks to many tasks, and each pair of its rows still meets.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = map_arrow(fps.select("fp").repartition(n, "fp"), _keys(bucket_count(n)), PACKED)
    found = cut(map_arrow(dealt(keys), _bucket_links(block), "u long, v long, key long"))
    links = found.where("key is null").select("u", "v")
    large = found.where("key is not null").select("key", F.col("u").alias("fp"))
    if not large.isEmpty():
        count = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        spread = large.join(count, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        links = links.unionByName(map_arrow(spread.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j"), _links, "u long, v long"))
    return links.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Null or empty texts have fingerprint zero and link like any other. Repeated rows stay and share a component. A
    null doc_id is kept and never names a component that has another. No documents give no rows.
    """
    fps = cut(fingerprints(docs, doc_id, text))
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = cut(connected_components(fingerprint_links(first)))
    lowest = first.join(comps, first.fp == comps.node).groupBy("comp").agg(F.min("first").alias("low"))
    of = comps.join(lowest, "comp").select(F.col("node").alias("fp"), "low")
    # written first, so that the join is plain and a fingerprint of very many copies can be split over tasks
    of = cut(first.join(of, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with its columns: the one of the smallest doc_id.

    Near are fingerprints within ``MAX_BITS``, and texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more: most of those differ in more bits. They are found by MinHash bands and verified.
    An id counts before a null one, and of equal ids the text with the smallest hash. Of rows alike in both that of the
    smallest hash of all columns stays. Null and empty texts are near one another, as their fingerprints are; no
    documents give no rows.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    fps = cut(map_arrow(slim, _fingerprints, "doc_id long, fp long, th long"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = cut(fps.groupBy("fp").agg(F.min(key).alias("first")))
    # each component of near texts is a node that the fingerprints of its texts link to
    near = near_texts(docs, doc_id, text).join(fps.select(F.col("th").alias("t"), "fp").distinct(), F.expr("th = t")).select(F.col("fp").alias("u"), F.xxhash64("comp").alias("v"))
    comps = cut(connected_components(fingerprint_links(first.select("fp")).unionByName(near)))
    own = first.join(comps, first.fp == comps.node, "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    keep = own.groupBy("comp").agg(F.min("first").alias("k"))
    kept = keep.select(F.col("k.doc_id").alias("kd"), F.col("k.th").alias("kt"))
    rows = fps.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    # what goes, and rows alike in id and text, of which one stays: only these have to be looked at again
    gone = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt")), "left").where("kt is null or n > 1")
    gone = cut(gone.select(F.col("doc_id").alias("_gl_d"), F.col("th").alias("_gl_t"), (F.col("kt").isNotNull()).alias("_gl_stays")))
    keyed = docs.withColumn("_gl_h", F.xxhash64(F.col(text).cast("string")))
    keyed = keyed.withColumn("_gl_c", F.xxhash64(F.col(doc_id).cast("long"), "_gl_h"))
    some, sure = suspected(keyed, "_gl_c", gone.select(F.xxhash64("_gl_d", "_gl_t").alias("c")))
    some = some.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("_gl_d")) & (F.col("_gl_h") == F.col("_gl_t")), "left").where(F.coalesce("_gl_stays", F.lit(True)))
    whole = F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))
    twice = some.where("_gl_stays").withColumn("_gl_o", whole)
    if not gone.where("_gl_stays").isEmpty():  # rows alike in id and text: that of the least hash of all columns
        least = twice.groupBy("_gl_d", "_gl_t").agg(F.min("_gl_o").alias("_gl_m")).withColumnsRenamed({"_gl_d": "_gl_d2", "_gl_t": "_gl_t2"})
        one = twice.join(least, F.col("_gl_d").eqNullSafe(F.col("_gl_d2")) & (F.col("_gl_t") == F.col("_gl_t2")) & (F.col("_gl_o") == F.col("_gl_m"))).dropDuplicates(["_gl_d", "_gl_t"])
        some = some.where("_gl_stays is null").select(*docs.columns).unionByName(one.select(*docs.columns))
    return sure.select(*docs.columns).unionByName(some.select(*docs.columns))
