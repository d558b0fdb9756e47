"""Substring de-duplication: paragraphs by MinHash banding, and passages inside them by winnowed word runs.

Paragraphs are lines of at least ``MIN_WORDS`` words. Equal ones meet by their hash; near ones by MinHash bands, tuned
for recall (lines of few shingles by pairs of their least shingles, which loses none), with the exact Jaccard similarity
of their five-word shingles as the judge; removals are clustered by connected components, and the first line of a class stays.

A paragraph that merely contains a passage of another has a low similarity. So, as a second step, runs of ``RUN`` equal
words, chosen by winnowing, are compared: any passage of ``RUN + WINDOW - 1`` words or more that two documents share has
a chosen run in both. Around the chosen runs that met, where their documents do not go on alike, the runs at every offset
are compared, which gives the whole passage.

Nothing vanishes: what goes as part of a passage stands word for word in the passage's first document, and what others
need there stays there, also where a removed paragraph holds it.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ._common import PACKED, binary_list, bitmap_parts, bucket_count, buckets_of, cut, dealt, discard, filter_bits, forget, group_starts, label_min, map_arrow, packed, stored, suspected, whole_groups
from .components import connected_components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Of a paragraph. Shorter lines (licences, menus, phrases) repeat in clean documents; they go only as part of a longer passage.
MIN_WORDS = 3 * SHINGLE
RUN, WINDOW = 25, 18
BLOCK = 256
#: Rows of a piece of the input that are put together before a shuffle.
PIECE = 1 << 20
ROWS = 3
#: Lines of so many shingles and more get bands, those of up to so many distinct ones pairs of their least shingles; what is in both meets both.
BANDED, FEW = 20, 23


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes so that a pair at ``similarity`` meets with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = tune_bands()
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each run of k words from the hashes of the words, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width, b = None, 0, h, 1, base
    while True:
        if k & width:
            piece = power[done : done + n]
            out = piece if out is None else out * b + piece
            done += width
        if width * 2 > k:
            return mix(out)
        m = len(power) - width
        power = power[:m] * b + power[width:]
        b = np.uint64((int(b) * int(b) + 2) & 0xFFFFFFFFFFFFFFFF)
        width *= 2


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin, and the line of each word."""
    a = np.frombuffer(text, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    return begin, np.searchsorted(np.flatnonzero(a == 10), begin)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(0xFFFFFFFF)


def lines_of(line: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First words, and ends, of the lines with enough words."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(line)) + 1, [len(line)]))
    long = np.flatnonzero(np.diff(edges) >= least)
    return edges[long], edges[long + 1]


def whole_text(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of all words of a text, where they are enough for a shingle."""
    k = len(line) >= SHINGLE
    return np.zeros(int(k), np.int64), np.full(int(k), len(line))


def content_id(h: np.ndarray) -> tuple[int, bytes]:
    """(short id: an odd long, whole id: 16 bytes) of a line with the word hashes ``h``."""
    whole = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True) | 1, whole


def _scan_words(batches, spans_of=lines_of):
    """Each text with words: 32 bits of each word's hash, the intervals of its lines and their short ids."""
    for b in batches:
        keep, rows = [], []
        for k, text in enumerate(binary_list(b.column("text"))):
            h = word_hashes(text)
            if not len(h):
                continue
            lo, hi = spans_of(word_places(text)[1])
            ids = np.array([content_id(h[a:e])[0] for a, e in zip(lo.tolist(), hi.tolist())], np.int64)
            keep.append(k)
            rows.append((h.astype(np.uint32).tobytes(), lo.astype(np.int32).tobytes(), hi.astype(np.int32).tobytes(), ids.tobytes()))
        own = [b.column(c).take(pa.array(keep, pa.int32())) for c in ("x", "d", "th")]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], pa.binary()) for i in range(4))], names=["x", "d", "th", "h", "lo", "hi", "c"])


def _texts(b: pa.RecordBatch):
    """(x, d, th, word hashes, line starts, line ends, line ids) of each row that ``_scan_words`` gave."""
    for x, d, th, *raw in zip(*(b.column(c).to_pylist() for c in ("x", "d", "th", "h", "lo", "hi", "c"))):
        yield x, d, th, *(np.frombuffer(r, k) for r, k in zip(raw, (np.uint32, np.int32, np.int32, np.int64)))


def band_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[groups][BANDS] keys of consecutive groups of shingle hashes."""
    low = np.empty((len(MULTIPLY), len(starts)), np.uint64)
    step = max(1, 1_000_000 // max(len(shingles), 1))
    for at in range(0, len(MULTIPLY), step):
        low[at : at + step] = np.minimum.reduceat((shingles[None, :] * MULTIPLY[at : at + step, None]) >> np.uint64(32), starts, axis=1)
    low = low.reshape(BANDS, ROWS, -1)
    key = np.arange(BANDS, dtype=np.uint64)[:, None] + np.zeros((1, len(starts)), np.uint64)
    for r in range(ROWS):
        key = mix(key * BASE + low[:, r])
    return key.T


def least_keys(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, key) for consecutive groups of shingle hashes with up to ``FEW`` distinct ones, none for others.

    Two sets of n and m shingles with a similarity of 0.8 or more have the two least of their common shingles among
    the least n - ceil(0.8 n) + 2 of the one and, likewise, of the other, so pairs of these are keys. Up to three
    shingles only equal sets are that similar.
    """
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(shingles))))
    order = np.lexsort((shingles, group))
    s, g = shingles[order], group[order]
    own = np.ones(len(s), bool)
    own[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
    s, g = s[own], g[own]
    n = np.bincount(g, minlength=len(starts))
    first = np.cumsum(n) - n
    use = (n > 3) & (n <= FEW)
    small = (n > 0) & (n <= 3)
    groups, keys = [np.flatnonzero(small)], []
    total = np.add.reduceat(mix(s), np.minimum(first, max(len(s) - 1, 0))) if len(s) else np.zeros(len(starts), np.uint64)
    keys.append(mix(total[small] + n[small].astype(np.uint64)))
    width = n - (4 * n + 4) // 5 + 2
    for k in range(2, int(width[use].max(initial=1)) + 1):  # pairs (j, k - 1) of places
        at = np.flatnonzero(use & (width >= k))
        two = s[first[at] + k - 1]
        for j in range(k - 1):
            groups.append(at)
            keys.append(mix(s[first[at] + j] * BASE + two))
    return np.concatenate(groups), np.concatenate(keys)


def line_keys(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, key) of consecutive groups of shingle hashes, by bands or least shingles."""
    size = np.diff(np.append(starts, len(shingles)))
    few = size <= FEW
    long = np.flatnonzero(~few)
    if len(long):  # up to FEW distinct shingles only where the first FEW + 1 hold equal ones
        head = np.sort(shingles[starts[long][:, None] + np.arange(FEW + 1)], axis=1)
        few[long[(head[:, 1:] == head[:, :-1]).any(1)]] = True
    banded = np.flatnonzero(size >= BANDED)
    groups, keys = [], []
    for at, how in ((banded, "bands"), (np.flatnonzero(few), "least")):
        if not len(at):
            continue
        own, off = shingles, starts
        if len(at) < len(starts):
            own = shingles[np.repeat(np.isin(np.arange(len(starts)), at), size)]
            off = np.cumsum(size[at]) - size[at]
        if how == "bands":
            groups.append(np.repeat(at, BANDS))
            keys.append(band_keys(own, off).ravel())
        else:
            g, k = least_keys(own, off)
            groups.append(at[g])
            keys.append(k)
    return np.concatenate(groups), np.concatenate(keys)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window (the first of equals)."""
    n = len(h)
    if n <= window:
        return np.array([int(h.argmin())]) if n else np.zeros(0, int)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(view.argmin(1) + np.arange(len(view)))


def everywhere(r: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All places of the runs that stand at ``at``, in order."""
    if not len(at):
        return at
    found = np.sort(r[at])
    k = np.minimum(np.searchsorted(found, r), len(found) - 1)
    return np.flatnonzero(found[k] == r)


def local_stars(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (key, c, m, first) of a piece of the input: m is the least c of the key, and first marks the one row of that least c.

    Whatever else a key holds is linked to m here, so a key reaches the shuffle by key once a piece, however many rows it has.
    """
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    own = new.copy()
    own[1:] |= c[1:] != c[:-1]
    m = c[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    return key[own], c[own], m[own], new[own]


def _doc_key(x: int, d: int, t: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d %d" % (x, d, t)) - (1 << 63)


#: What is told of a run beside its document: that it met, that it is open to the left, to the right.
MET_HERE, OPEN_LEFT, OPEN_RIGHT = 1, 2, 4
CONTEXT = (1 << 30) - 1
#: Kinds of keys: bands and least shingles with a line's short id; short ids with a document; runs with what is told of them.
BUCKET, LINE, CHOSEN = range(3)
#: The same two where a row is linked already.
LINKED = 4
KEY_TYPES = {BUCKET: [np.int64] * 2, LINE: [np.int64] * 2, CHOSEN: [np.int64] * 3, LINKED + BUCKET: [np.int64] * 3, LINKED + LINE: [np.int64] * 3}


def _key_batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *map(pa.array, columns)], names=["kind", "key", "c", "m"])


def _runs_of(key, c, told, own: bool):
    """(key, least c, told) of each key: flags and, above them, what stands on its left and right (30 bits each).

    A run has met where its c differ (or it did before), and a side is open where what stands there differs.
    """
    order = np.lexsort((c, key))
    key, c, told = key[order], c[order], told[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    flags = np.bitwise_or.reduceat(told & 7, start)
    for bit, shift in ((OPEN_LEFT, 3), (OPEN_RIGHT, 33)):
        side = told >> shift & CONTEXT
        flags |= bit * np.logical_or.reduceat(side != np.repeat(side[start], size), start)
    flags |= MET_HERE * (c[start + size - 1] != c[start])
    use = slice(None) if own else (flags & MET_HERE).astype(bool)
    return key[start][use], c[start][use], (told[start] & ~7 | flags)[use]


def chosen_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, told) at all places of the chosen runs of a text."""
    r = runs(words, RUN)
    at = everywhere(r, winnow(r))
    near = (runs(words, WINDOW) >> np.uint64(34)).astype(np.int64)
    left, right = at >= WINDOW, at + RUN < len(near)  # what a text's end cuts short is open
    told = OPEN_LEFT * ~left | OPEN_RIGHT * ~right
    told[left] |= near[at[left] - WINDOW] << 3
    told[right] |= near[at[right] + RUN] << 33
    return r[at].view(np.int64), told


def _scan_keys(batches, buckets: int, with_runs: bool = True):
    """Keys of all lines and the chosen runs, once a piece of the input, packed by key."""
    held: tuple[list, list, list] = ([], [], [])
    count = 0

    def pieces():
        for kind, rows in enumerate(held):
            if not rows:
                continue
            columns = list(map(np.concatenate, zip(*rows)))
            rows.clear()
            if kind == CHOSEN:
                found = _runs_of(*columns, True)
                yield packed(kind, found[0], list(found), buckets)
                continue
            key, c, m, first = local_stars(*columns)
            yield packed(kind, key[first], [key[first], c[first]], buckets)
            if not first.all():
                yield packed(LINKED + kind, mix((key ^ c).view(np.uint64)).view(np.int64)[~first], [x[~first] for x in (key, c, m)], buckets)

    for b in batches:
        shingles, sizes, names = [], [], []
        for x, d, t, h, lo, hi, ids in _texts(b):
            words = h.astype(np.uint64)
            key = _doc_key(x, d, t)
            if len(lo):
                s = runs(words, SHINGLE)
                n = hi - lo - SHINGLE + 1
                whole = len(lo) == 1 and n[0] == len(s)
                shingles.append(s if whole else s[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
                sizes.append(n)
                names.append(ids)
                held[LINE].append((ids, np.full(len(ids), key, np.int64)))
                count += len(ids)
            if with_runs and len(words) >= RUN:
                r, told = chosen_runs(words)
                held[CHOSEN].append((r, np.full(len(r), key, np.int64), told))
                count += len(r)
            if sum(map(len, shingles)) >= 1 << 18 or count >= PIECE:
                count += _line_rows(shingles, sizes, names, held[BUCKET])
                if count >= PIECE:
                    yield from pieces()
                    count = 0
        count += _line_rows(shingles, sizes, names, held[BUCKET])
        if count >= PIECE:
            yield from pieces()
            count = 0
    yield from pieces()


def _line_rows(shingles: list, sizes: list, names: list, out: list) -> int:
    if not shingles:
        return 0
    n = np.concatenate(sizes).astype(np.int64)
    group, key = line_keys(np.concatenate(shingles), np.cumsum(n) - n)
    out.append((key.view(np.int64), np.concatenate(names)[group]))
    for x in (shingles, sizes, names):
        x.clear()
    return len(key)


def _meet(batches):
    """Of lines: the rows that hold more than one thing for a key, each with what it is linked to; of runs: those that met."""
    for kind, columns in buckets_of(batches, KEY_TYPES):
        if kind == CHOSEN:
            yield _key_batch(kind, *_runs_of(*columns, False))
        elif kind >= LINKED:
            yield _key_batch(kind - LINKED, *columns)
        else:
            *found, first = local_stars(*columns)
            yield _key_batch(kind, *(x[~first] for x in found))


def bitmap_of(ids: DataFrame, bits: int) -> bytes:
    """The bitmap of :func:`bitmap_parts` as bytes."""
    size = 1 << (bits - 3)
    out = bytearray(max(size, 4096))
    for r in bitmap_parts(ids, bits).collect():
        out[4096 * r["k"] : 4096 * r["k"] + 4096] = r["part"]
    return bytes(out)


def filter_of(ids: DataFrame):
    """The bitmap of a written frame's column ``c``, broadcast."""
    return ids.sparkSession.sparkContext.broadcast(bitmap_of(ids, filter_bits(ids.count())))


def wanted(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids >> 1 & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _wanted_sets(bitmap):
    """(c, node, set of shingles) of the lines whose short id may be wanted, once a piece."""

    def run(batches):
        bits, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for b in batches:
            rows = []
            for *_, h, lo, hi, ids in _texts(b):
                for k in np.flatnonzero(wanted(ids, bits)).tolist():
                    own = h[lo[k] : hi[k]].astype(np.uint64)
                    c, node = content_id(own)
                    if node not in seen:
                        seen.add(node)
                        rows.append((c, node, np.unique(runs(own, SHINGLE)).tobytes()))
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["c", "node", "set"])

    return run


def _wanted_places(bitmap):
    """(node, x, d, th, start, stop) of the lines whose short id may be wanted."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            rows = []
            for x, d, th, h, lo, hi, ids in _texts(b):
                for k in np.flatnonzero(wanted(ids, bits)).tolist():
                    rows.append((content_id(h[lo[k] : hi[k]].astype(np.uint64))[1], x, d, th, int(lo[k]), int(hi[k])))
            kinds = (pa.binary(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "x", "d", "th", "start", "stop"])

    return run


#: Shifts of a run's hash, one for each of the bits that it sets in the bitmap of the runs that met.
PROBES = (0, 17, 34)


def in_bitmap(r: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask, hit = 8 * len(bits) - 1, np.ones(len(r), bool)
    for by in PROBES:
        x = r.view(np.int64) >> (by + 1) & mask
        hit &= (bits[x >> 3] >> (x & 7) & 1).astype(bool)
    return hit


def near_places(r: np.ndarray, met: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the chosen runs that may have met, and of all runs less than ``WINDOW`` words away on their open sides.

    A passage begins and ends less than ``WINDOW`` words from a chosen run of it, on an open side. Where all documents
    with a run have the same ``WINDOW`` words beside it, the next chosen run is common to them too and overlaps it.
    """
    at = winnow(r)
    at = at[in_bitmap(r[at], met)]
    if not len(at):
        return at
    at = everywhere(r, at)  # wherever else the document has it, too
    edge = np.zeros(len(r) + 1, np.int64)
    np.add.at(edge, np.maximum(at - (WINDOW - 1) * in_bitmap(r[at], left), 0), 1)
    np.add.at(edge, np.minimum(at + 1 + (WINDOW - 1) * in_bitmap(r[at], right), len(r)), -1)
    return np.flatnonzero(np.cumsum(edge)[:-1])


def _leads(h, h2, x, d, th, start):
    """(order by run, document and place; where a run begins in it; its first row and whether it is in several documents, by row of the order)."""
    order = np.lexsort((start, th, d, x, h2, h))
    key = [c[order] for c in (h, h2)]
    new = np.ones(len(order), bool)
    new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    own = [c[order] for c in (x, d, th)]
    other = np.logical_or.reduce([c != np.repeat(c[first], size) for c in own])
    return order, new, np.repeat(first, size), np.repeat(np.logical_or.reduceat(other, first), size)


#: The order of documents: null ids first, then by id and hash of the text.
DOC = ["x", "d", "th"]
HOLDER = ["hx", "hd", "hth", "hstart"]
#: Of an interval of a document: it goes as a paragraph, it stays as one, the holder has it too; it goes, it stays, others need it.
PARAGRAPH, FIRST, AGAIN, GOES, STAYS, NEEDED = range(6)
#: Of a run: the first place of a piece of the input; likewise packed, what the first of all has too, and places dealt by holder.
LEAD = 6
LEAD_TYPES = [np.int64, np.int64, np.int8, np.int64, np.int64, np.int32, np.int8]
SPAN_NUMBERS = [np.int8, np.int64, np.int64, np.int32, np.int32, np.int8, np.int64, np.int64, np.int32]
SPAN = "x byte, d long, th long, kind byte, start int, stop int, hx byte, hd long, hth long, hstart int"
SPAN_TYPES = dict(zip([*DOC, "kind", "start", "stop", *HOLDER], (pa.int8(), pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int32())))


def chains(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """AGAIN intervals put together where they follow one another here and in the holder alike."""
    shift = c["hstart"].astype(np.int64) - c["start"]
    order = np.lexsort((c["start"], shift, c["hth"], c["hd"], c["hx"], c["th"], c["d"], c["x"]))
    if not len(order):
        return c
    start, stop = c["start"][order], c["stop"][order]
    new = np.ones(len(order), bool)
    new[1:] = False
    for v in (*(c[k] for k in (*DOC, *HOLDER[:3])), shift):
        new[1:] |= v[order][1:] != v[order][:-1]
    apart = np.cumsum(new) * (int(stop.max()) + 2)  # groups of one document, holder and shift stand apart
    new[1:] |= (start + apart)[1:] > np.maximum.accumulate(stop + apart)[:-1]
    at = np.flatnonzero(new)
    return {k: c[k][order][at] for k in c} | {"stop": np.maximum.reduceat(stop, at)}


SPAN_COLUMNS = [*DOC, "start", "stop", *HOLDER]


def span_batch(c: dict[str, np.ndarray], kind: int = AGAIN) -> pa.RecordBatch:
    n = len(c["x"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8) if k == "kind" else c[k], t) for k, t in SPAN_TYPES.items()], names=list(SPAN_TYPES))


def doc_keys(c: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    x, d, th = (c[k].astype(np.int64).view(np.uint64) for k in names)
    return mix((d * BASE ^ th) + x).view(np.int64)


def packed_spans(c: dict[str, np.ndarray], kind: int, by: list[str], buckets: int) -> pa.RecordBatch:
    """Spans packed by the document that ``by`` names."""
    return packed(kind, doc_keys(c, by), [c[k].astype(t) for k, t in zip(SPAN_COLUMNS, SPAN_NUMBERS)], buckets)


def _scan_places(bitmaps, buckets: int):
    """The runs at ``near_places``: the first of each piece of the input by (h, h2), the others as what the first's document has too.

    Each of these is chained, so a document that holds much of another's text takes few rows.
    """

    def run(batches):
        bits = [np.frombuffer(x.value, np.uint8) for x in bitmaps]
        held: list[tuple] = []
        count = 0

        def piece():
            h, h2, *own = (np.concatenate(c) for c in zip(*held))
            order, new, first, met = _leads(h, h2, *own)
            x, d, th, start = own = [c[order] for c in own]
            yield packed(LEAD, h[order][new], [h[order][new], h2[order][new], *(c[new] for c in own), met[new].astype(np.int8)], buckets)
            # what overlaps the first place in its own document is no place by itself
            again = ~new & ((x != x[first]) | (d != d[first]) | (th != th[first]) | (start - start[first] >= RUN))
            if again.any():
                at, by = np.flatnonzero(again), first[again]
                yield packed_spans(chains(dict(zip(SPAN_COLUMNS, (x[at], d[at], th[at], start[at], start[at] + RUN, x[by], d[by], th[by], start[by])))), AGAIN, HOLDER[:3], buckets)

        for b in batches:
            for x, d, th, words, *_ in _texts(b):
                if len(words) < RUN:
                    continue
                words = words.astype(np.uint64)
                r = runs(words, RUN)
                at = near_places(r, *bits)
                if not len(at):
                    continue
                n = len(at)
                held.append((r[at].view(np.int64), runs(words, RUN, BASE2)[at].view(np.int64), np.full(n, x, np.int8), np.full(n, d, np.int64), np.full(n, th, np.int64), at.astype(np.int32)))
                count += n
                if count >= PIECE:
                    yield from piece()
                    held, count = [], 0
        if held:
            yield from piece()

    return run


def _firsts(buckets: int):
    """Each piece's first place of a run that several documents have, with the first of all as its holder (which may be itself), packed by document."""

    def run(batches):
        held, count = [], 0

        def piece():
            c = chains({k: np.concatenate([h[i] for h in held]) for i, k in enumerate(SPAN_COLUMNS)})
            held.clear()
            return packed_spans(c, LEAD, DOC, buckets)

        for _, (*columns, told) in buckets_of(batches, {LEAD: LEAD_TYPES}):
            order, new, first, met = _leads(*columns)
            at = np.flatnonzero(new)
            met |= np.repeat(np.logical_or.reduceat(told[order] > 0, at), np.diff(np.append(at, len(order))))
            if met.any():
                x, d, th, start = (c[order] for c in columns[2:])
                by = first[met]
                held.append((x[met], d[met], th[met], start[met], start[met] + RUN, x[by], d[by], th[by], start[by]))
                count += len(by)
                if count >= PIECE:
                    yield piece()
                    count = 0
        if held:
            yield piece()

    return run


def _follow(batches):
    """AGAIN spans in terms of the first documents of all.

    A bucket holds documents with what their places have for holders (LEAD), and what other documents, or other places of
    the same, have in common with them (AGAIN): in these the document is the holder.
    """
    links: dict[tuple, list[tuple]] = {}
    types = {AGAIN: SPAN_NUMBERS, LEAD: SPAN_NUMBERS}
    for kind, columns in buckets_of(((b.set_column(0, "kind", pa.array(np.where(b.column("kind").to_numpy() == LEAD, 0, AGAIN).astype(np.int8)))) for b in batches), types | {0: SPAN_NUMBERS}):
        c = dict(zip(SPAN_COLUMNS, columns))
        if kind == 0:  # comes before AGAIN in each bucket
            links.clear()
            own = chains(c)
            for x, d, th, a, e, *holder in zip(*(own[k].tolist() for k in SPAN_COLUMNS)):
                links.setdefault((x, d, th), []).append((a, e, holder))
            rows = [(*doc, a, e, *holder) for doc, spans in links.items() for a, e, holder in spans if tuple(holder[:3]) != doc]
        else:
            rows = []
            for x, d, th, a, e, hx, hd, hth, hs in zip(*(c[k].tolist() for k in SPAN_COLUMNS)):
                for p, q, (fx, fd, fth, fs) in links.get((hx, hd, hth), ()):
                    lo, hi = max(p, hs), min(q, hs + e - a)
                    if hi - lo >= RUN:
                        rows.append((x, d, th, lo - hs + a, hi - hs + a, fx, fd, fth, fs + lo - p))
        yield span_batch(dict(zip(SPAN_COLUMNS, (np.array([r[i] for r in rows], np.int64) for i in range(9)))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verify(batches):
    for b in batches:
        keep = []
        last, one = None, None
        for x, y in zip(b.column("s1").to_pylist(), b.column("s2").to_pylist()):
            if len(x) < SIMILARITY * len(y) or len(y) < SIMILARITY * len(x):
                keep.append(False)
                continue
            if y is not last:
                last, one = y, np.frombuffer(y, np.uint64)
            keep.append(jaccard(np.frombuffer(x, np.uint64), one) >= SIMILARITY)
        t = pa.Table.from_batches([b.select(["u", "v"])]).filter(pa.array(keep, pa.bool_()))
        yield from t.to_batches()


def _blocks(batches):
    """Links between members of a bucket that lie in different components, at most one a component: rows (key, i, j, c, comp, set)."""
    for t in whole_groups(batches, ["key", "i", "j"], 4096):
        starts = np.append(group_starts(t, ["key", "i", "j"]), t.num_rows).tolist()
        cs, comps, sets = (t.column(k).to_pylist() for k in ("c", "comp", "set"))
        u, v = [], []
        for a, e in zip(starts[:-1], starts[1:]):
            names = sorted(set(comps[a:e]))
            if len(names) < 2:
                continue
            code = {x: i for i, x in enumerate(names)}
            own = np.array([code[x] for x in comps[a:e]])
            arrays = [np.frombuffer(s, np.uint64) for s in sets[a:e]]
            size = np.array([len(x) for x in arrays])
            flat, row = np.concatenate(arrays), np.repeat(np.arange(e - a), size)
            label = np.arange(len(names))
            for k in range(e - a - 1):
                other = np.flatnonzero((label[own] != label[own[k]]) & (np.arange(e - a) > k) & (size >= SIMILARITY * size[k]) & (size[k] >= SIMILARITY * size))
                if not len(other):
                    continue
                use = np.isin(row, other)
                both = np.bincount(row[use], np.isin(flat[use], arrays[k], assume_unique=False), e - a)[other]
                for o in other[both >= SIMILARITY * (size[other] + size[k] - both)].tolist():
                    if label[own[o]] != label[own[k]]:
                        u.append(cs[a + k])
                        v.append(cs[a + o])
                        label = label_min(len(names), np.append(np.arange(len(names)), own[k]), np.append(label, own[o]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(x, d, th, text): x is 0 and d is 0 for a null id, th is the text's hash."""
    d = F.col(doc_id).cast("long")
    slim = docs.select(d.isNotNull().cast("byte").alias("x"), F.coalesce(d, F.lit(0)).cast("long").alias("d"), F.col(text).cast("string").alias("text"))
    return slim.select("x", "d", F.xxhash64("text").alias("th"), "text")


def words_of(slim: DataFrame, spans_of=lines_of) -> tuple[DataFrame, str]:
    """The texts as hashes of words with their lines, stored; no later step reads a text again."""
    return stored(map_arrow(slim, partial(_scan_words, spans_of=spans_of), "x byte, d long, th long, h binary, lo binary, hi binary, c binary"))


def keys_met(words: DataFrame, with_runs: bool = True) -> DataFrame:
    """(kind, key, c, m) of the buckets and lines that hold several things, and of the chosen runs of several documents."""
    buckets = bucket_count(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = map_arrow(words, partial(_scan_keys, buckets=buckets, with_runs=with_runs), PACKED)
    met = cut(map_arrow(dealt(keys), _meet, "kind byte, key long, c long, m long"))
    del keys
    forget(words.sparkSession)
    return met


def near_contents(words: DataFrame, met: DataFrame) -> DataFrame:
    """(c, node, comp) of the contents of near lines: short id, whole id, component.

    A filter of bounded size tells which lines a step may need. What it lets through by chance finds no partner in the
    join that follows.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = met.where(F.col("kind") == BUCKET).select("key", "c", "m")
    pairs = cut(stars.select(F.greatest("c", "m").alias("u"), F.least("c", "m").alias("v")).distinct())
    needed = cut(pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct())
    found = map_arrow(words, _wanted_sets(filter_of(needed)), "c long, node binary, set binary")
    sets = found.join(needed, "c", "left_semi").groupBy("c", "node").agg(F.first("set").alias("set"))
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))
    one, two = (sets.select(F.col("c").alias(f"c{k}"), F.col("id").alias(f"i{k}"), F.col("set").alias(f"s{k}")) for k in "12")
    # of contents with one short id every two meet, so a chance collision joins nothing by itself
    links = cut(map_arrow(pairs.join(one, F.expr("u = c1")).join(two, F.expr("v = c2")).select(F.col("i1").alias("u"), F.col("i2").alias("v"), "s1", "s2"), _verify, "u long, v long"))
    comps = cut(connected_components(links))
    # buckets with a row that its star did not join: every pair across components meets too, in blocks
    named = cut(sets.select("c", "id").join(comps.withColumnRenamed("node", "k"), F.expr("id = k"), "left").select("c", "id", F.coalesce("comp", "id").alias("comp")))
    of = {k: named.select(F.col("c").alias(f"c{k}"), F.col("comp").alias(f"p{k}")) for k in "12"}
    apart = pairs.join(of["1"], F.expr("u = c1")).join(of["2"], F.expr("v = c2")).where("p1 <> p2").select("u", "v").distinct()
    keyed = stars.select("key", F.greatest("c", "m").alias("a"), F.least("c", "m").alias("b"))
    open_ = cut(keyed.join(apart, F.expr("a = u and b = v")).select("key").distinct())
    if not open_.isEmpty():
        members = stars.join(open_, "key", "left_semi")
        members = cut(members.select("key", "c").union(members.select("key", F.col("m").alias("c"))))
        members = cut(members.distinct().join(named, "c").select("key", "id", "comp"))
        # written first, so that the join is plain and a bucket of very many lines can be split over tasks
        count = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        spread = members.join(count, "key").select("key", F.col("id").alias("c"), "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        spread = spread.select("key", "c", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        spread = spread.join(sets.select("id", "set"), F.expr("c = id")).drop("id").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = cut(map_arrow(spread, _blocks, "u long, v long").distinct())
        if not more.isEmpty():
            comps = cut(connected_components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more)))
    return cut(sets.select("c", "node", "id").join(comps.withColumnRenamed("node", "k"), F.expr("id = k")).select("c", "node", "comp"))


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(th, comp) of the whole texts whose shingles have a Jaccard similarity of ``SIMILARITY`` or more to another's, or a chain of them.

    Null, empty and shorter texts than a shingle have none. ``th`` is the hash of the text, equal texts have one row.
    """
    words, place = words_of(_slim(docs, doc_id, text), whole_text)
    near = near_contents(words, keys_met(words, False))
    texts = map_arrow(words, _wanted_places(filter_of(near.select("c"))), "node binary, x byte, d long, th long, start int, stop int").select("th", "node").distinct()
    found = cut(texts.join(near.select(F.col("node").alias("k"), "comp"), F.expr("node = k")).select("th", "comp"))
    discard(docs.sparkSession, place)
    return found


def paragraph_spans(words: DataFrame, met: DataFrame) -> DataFrame:
    """SPAN rows of the lines that repeat in another document, exactly or nearly."""
    near = near_contents(words, met)
    exact = met.where(F.col("kind") == LINE).select(F.col("key").alias("c"))
    known = filter_of(cut(exact.union(near.select("c")).distinct()))
    lines = map_arrow(words, _wanted_places(known), "node binary, x byte, d long, th long, start int, stop int")
    lines = lines.join(near.select(F.col("node").alias("k"), "comp"), F.expr("node = k"), "left")
    # of a line without near ones the class is its content
    lines = cut(lines.select(*DOC, "start", "stop", F.coalesce(F.col("comp").cast("string").cast("binary"), "node").alias("comp")))
    classes = lines.groupBy(F.col("comp").alias("k")).agg(F.min(F.struct(*DOC, "start")).alias("first"), F.max(F.struct(*DOC)).alias("last"))
    classes = cut(classes.where("not (first.x = last.x and first.d = last.d and first.th = last.th)").select("k", "first"))
    stays = F.expr("x = first.x and d = first.d and th = first.th and start = first.start")
    return lines.join(classes, F.expr("comp = k")).select(
        *DOC, F.when(stays, FIRST).otherwise(PARAGRAPH).cast("byte").alias("kind"), "start", "stop", F.expr("first.x").alias("hx"), F.expr("first.d").alias("hd"), F.expr("first.th").alias("hth"), F.expr("first.start").alias("hstart")
    )


def run_spans(words: DataFrame, met: DataFrame) -> tuple[DataFrame, str]:
    """SPAN rows of the runs of the passages that several documents have, wherever they are not the first place; a stored table that they are read from.

    The chosen runs tell where to look; there the runs at every offset are compared, so that a passage is covered from
    its first word to its last. The first place of a run is found over the first ones of each piece of the input, so
    a very common run reaches that shuffle once a piece.
    """
    chosen = met.where(F.col("kind") == CHOSEN).select("key", F.col("m").alias("told"))
    size = filter_bits(chosen.count())
    probes = chosen.select("told", F.explode(F.array(*(F.shiftright("key", by) for by in PROBES))).alias("c"))
    bitmaps = [words.sparkSession.sparkContext.broadcast(bitmap_of(probes.where(f"told & {bit} > 0"), size)) for bit in (MET_HERE, OPEN_LEFT, OPEN_RIGHT)]
    buckets = bucket_count(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places, at = stored(map_arrow(words, _scan_places(bitmaps, buckets), PACKED))
    firsts = map_arrow(dealt(places.where(F.col("kind") == LEAD)), _firsts(buckets), PACKED)
    return map_arrow(dealt(firsts.unionByName(places.where(F.col("kind") == AGAIN))), _follow, SPAN), at


def by_document(spans: DataFrame) -> DataFrame:
    """SPAN rows dealt by document, with its hash as ``k``: one long to sort by; what shares it by chance is told apart later."""
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.withColumn("k", F.xxhash64(*DOC)).repartition(n, "k").sortWithinPartitions("k")


def joined(spans) -> list[list[int]]:
    """Intervals put together where they overlap or touch."""
    out: list[list[int]] = []
    for a, e in sorted((s[0], s[1]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif a < e:
            out.append([a, e])
    return out


def less(spans, gone) -> list[tuple[int, int]]:
    """The parts of disjoint sorted intervals outside of others, which are disjoint and sorted."""
    out, k = [], 0
    for a, e in spans:
        while k and gone[k - 1][1] > a:
            k -= 1
        while k < len(gone) and gone[k][0] < e:
            x, y = gone[k]
            if x > a:
                out.append((a, x))
            a = max(a, y)
            k += 1
        if a < e:
            out.append((a, e))
    return out


def tiles(parts, spans) -> list[tuple[int, int, int]]:
    """(start, stop, start in the holder) of as few pieces as cover ``parts``, each out of one of the spans (start, stop, start in the holder)."""
    out = []
    spans = sorted(spans)
    k, best = 0, (0, 0, 0)
    for at, end in parts:
        while at < end:
            while k < len(spans) and spans[k][0] <= at:
                best = max(best, spans[k], key=lambda x: x[1])
                k += 1
            a, e, hs = best
            out.append((at, min(e, end), hs + at - a))
            at = min(e, end)
    return out


def _propose(batches):
    """What each document would lose, from whom, and what it needs the holder to keep.

    Paragraphs go first. Of the runs, those of the earliest holder come first; what they cover beyond what goes already
    goes too where that is ``RUN`` words or more, and is then needed in the holder, word for word.
    """
    for t in whole_groups(batches, ["k"]):
        kind = t.column("kind").to_numpy()
        c = {k: t.column(k).to_numpy() for k in SPAN_TYPES}
        by: dict[tuple, list[tuple]] = {}
        for part in ({k: v[kind != AGAIN] for k, v in c.items()}, chains({k: v[kind == AGAIN] for k, v in c.items()})):
            for x, d, th, *row in zip(*(v.tolist() for v in part.values())):
                by.setdefault((x, d, th), []).append(row)
        rows, needed = [], {}
        for doc, spans in by.items():
            for kind_, a, e, *holder in spans:
                if kind_ != AGAIN:
                    rows.append((*doc, GOES if kind_ == PARAGRAPH else STAYS, a, e, *holder))
            gone = joined([s[1:3] for s in spans if s[0] == PARAGRAPH])
            holders: dict[tuple, list[tuple]] = {}
            for kind_, a, e, hx, hd, hth, hs in spans:
                if kind_ == AGAIN:
                    holders.setdefault((hx, hd, hth), []).append((a, e, hs))
            for holder in sorted(holders):
                parts = [p for p in less(joined(holders[holder]), gone) if p[1] - p[0] >= RUN]
                if not parts:
                    continue
                gone = joined([*gone, *parts])
                for a, e, hs in tiles(parts, holders[holder]):
                    rows.append((*doc, GOES, a, e, *holder, hs))
                    needed.setdefault(holder, []).append((hs, hs + e - a))
        rows += [(*doc, NEEDED, a, e, *doc, 0) for doc, spans in needed.items() for a, e in joined(spans)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(SPAN_TYPES.values())], names=list(SPAN_TYPES))


def _resolve(batches):
    """What goes and what stays: nothing goes that others need."""
    for t in whole_groups(batches, ["k"]):
        by: dict[tuple, dict[int, list]] = {}
        for x, d, th, kind, a, e, hx, hd in zip(*(t.column(c).to_pylist() for c in (*DOC, "kind", "start", "stop", "hx", "hd"))):
            by.setdefault((x, d, th), {}).setdefault(kind, []).append((a, e, (hx, hd)))
        rows = []
        for (x, d, th), spans in by.items():
            needed = joined(spans.get(NEEDED, ()))
            own = d if x else None
            gone = [(a, e, h[1] if h[0] else None) for *span, h in sorted(spans.get(GOES, ())) for a, e in less([span], needed)]
            rows += [(own, th, *span, False) for span in gone]
            rows += [(own, th, a, e, own, True) for a, e in less(joined([*needed, *spans.get(STAYS, ())]), joined(gone))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "th", "start_word", "end_word", "holder_id", "kept"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, start_word, end_word, holder_id, kept) of :func:`repeated_passages`; th is the hash of the text."""
    spark = docs.sparkSession
    words, stored_words = words_of(_slim(docs, doc_id, text), partial(lines_of, least=max(min_words, SHINGLE)))
    met = keys_met(words)
    paragraphs = cut(paragraph_spans(words, met))
    forget(spark)
    passages, stored_places = run_spans(words, met)
    spans = paragraphs.unionByName(passages)
    proposed = map_arrow(by_document(spans), _propose, SPAN)
    # a span of a document may be needed by very many others: each is told once
    told = cut(proposed.distinct())
    del paragraphs, passages, spans, proposed, words, met
    discard(spark, stored_words, stored_places)
    forget(spark)
    return map_arrow(by_document(told), _resolve, "doc_id long, th long, start_word int, end_word int, holder_id long, kept boolean")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage that documents share: doc_id, start_word, end_word (exclusive), holder_id, kept.

    Lines of ``min_words`` words or more (five at least) are paragraphs; passages inside them have 25 words or more.
    ``kept`` rows stay; the others are to be removed. ``holder_id`` of a removed paragraph is the document whose
    paragraph of the class stays (less what stands in an earlier document still); that of a passage has it word for word in
    a ``kept`` row. Null, empty and short texts have none, and so have passages that repeat only within one document.
    Rows of equal id and text are one document, a null id is a document of its own by its text, before all others. No
    documents give no rows.
    """
    return repeated_spans(docs, doc_id, text, min_words).drop("th")


def _cut_text(batches):
    for b in batches:
        texts, left = [], []
        for text, spans in zip(b.column("_gl_text").to_pylist(), b.column("_gl_spans").to_pylist()):
            if not spans:
                texts.append(text)
                left.append(True)
                continue
            raw = text.encode()
            begin, _ = word_places(raw)
            at = np.append(begin, len(raw))
            keep, last = [], 0
            for s in sorted(spans, key=lambda x: x["start"]):
                a, e = int(at[s["start"]]), int(at[s["stop"]])
                keep.append(raw[last : max(a, last)])
                gone = raw[a:e]
                if keep[-1].strip() and b"\n" not in keep[-1][len(keep[-1].rstrip()) :] and b"\n" in gone[len(gone.rstrip()) :]:
                    keep.append(b"\n")  # what ended a line still does
                last = max(last, e)
            new = (b"".join(keep) + raw[last:]).decode()
            texts.append(new)
            left.append(bool(new.strip()))
        out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(texts, pa.string()), pa.array(left, pa.bool_())], names=[*b.schema.names[:-2], "_gl_text", "_gl_left"])
        yield out


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from their texts and ``n_chars`` counted anew; documents cut to nothing go.

    Documents without a repeated passage are returned as they are, null and empty texts too.
    """
    gone = cut(repeated_spans(docs, doc_id, text, min_words).where("not kept").select(F.col("doc_id").alias("_gl_d"), F.col("th").alias("_gl_t"), F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("stop")).alias("s")))
    gone = cut(gone.groupBy("_gl_d", "_gl_t").agg(F.collect_list("s").alias("_gl_spans")))
    keyed = docs.withColumn("_gl_h", F.xxhash64(F.col(text).cast("string")))
    some, whole = suspected(keyed.withColumn("_gl_c", F.xxhash64(F.col(doc_id).cast("long"), "_gl_h")), "_gl_c", gone.select(F.xxhash64("_gl_d", "_gl_t").alias("c")))
    met = some.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("_gl_d")) & (F.col("_gl_h") == F.col("_gl_t")), "left")
    met = met.select(*docs.columns, F.col(text).cast("string").alias("_gl_text"), "_gl_spans")
    schema = StructType([*docs.schema, StructField("_gl_text", StringType()), StructField("_gl_left", BooleanType())])
    out = map_arrow(met, _cut_text, schema).where("_gl_left")
    new = [F.col("_gl_text").alias(c) if c == text else F.when(F.col("_gl_text").eqNullSafe(F.col(text)), F.col(c)).otherwise(F.length("_gl_text")).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(c) for c in docs.columns]
    return out.select(*new).unionByName(whole.select(*docs.columns))
