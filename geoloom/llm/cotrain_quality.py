"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view looks at what a text is made of (hashed words, repetition, symbols, punctuation); the metadata view at
what a crawler records about a page: source, language, size, layout of the lines, URL and size of the page of the same
id. Both are fitted on a bounded number of labelled rows. In each round every document is scored, and each view gives
its most confident pseudo-labels of both kinds to the other. In the end each view is calibrated on labelled rows that
its fit did not see, the calibrated log odds are added, and all documents are scored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, cut, discard, map_arrow, stored
from .weak_toxicity import held_out, log_odds, logistic

#: Bounds on the rows that the model is fitted on: labelled ones, and pseudo-labelled ones that a view gives in a round.
LABELLED, GIVEN = 8000, 400
ROUNDS = 3
#: Of the labelled rows that are kept for calibration, so many of those as extreme as a pseudo-label have to be right; weight of a pseudo-label.
CONFIDENT, WEIGHT = 0.7, 0.3
#: Hash buckets of words, of source and language, of URL parts.
WORDS, SOURCES, URLS = 128, 32, 64
THRESHOLD = 0.5
SYMBOLS = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,'"))


def _rate(a: float, b: float) -> float:
    return a / b if b else 0.0


def surface(text: bytes) -> tuple[list[float], set[bytes]]:
    """Counts and shares of one whole text, all of them linear in its length, and its distinct words in lower case."""
    words = text.split()
    n, chars = len(words), len(text)
    own = set(text.lower().split())
    bare = text.translate(None, SYMBOLS)
    letters = len(text.translate(None, bytes(range(65))))
    digits = chars - len(text.translate(None, b"0123456789"))
    stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    same = sum(map(bytes.__eq__, words, words[1:]))
    lone = sum(len(w) == 1 for w in words)
    return [
        math.log1p(n), _rate(len(own), n), _rate(len(own), math.sqrt(n or 1)) / 10, _rate(chars, n) / 10,
        _rate(chars - len(bare), chars) * 10, _rate(letters, chars), _rate(digits, chars) * 10, _rate(stops, n) * 10, _rate(same, n), _rate(text.count(b","), n) * 10,
        _rate(lone, n) * 10, float(n == 0), float(text[:1].isupper()), _rate(text.count(b"http") + text.count(b"@"), n) * 10,
    ], own


SURFACE = len(surface(b"")[0])


def text_features(texts: list[bytes]) -> np.ndarray:
    """[texts][SURFACE + WORDS]: the surface, then by hash of the word the share of a text's distinct words, scaled by their root."""
    out = np.zeros((len(texts), SURFACE + WORDS))
    for i, t in enumerate(texts):
        out[i, :SURFACE], own = surface(t)
        if own:
            at = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % WORDS
            out[i, SURFACE:] = np.bincount(at, minlength=WORDS) / math.sqrt(len(own))
    return out


def layout(text: bytes) -> list[float]:
    """What the lines of a text look like: their number, sizes, blank, short and repeated ones."""
    lines = text.split(b"\n")
    size = np.fromiter(map(len, lines), float, len(lines))
    mean = size.mean()
    return [math.log1p(len(lines)), math.log1p(mean), math.log1p(size.max()), math.log1p(size.min()), float((size == 0).mean()), float(size.std() / (mean + 1)), float((size < 40).mean()), len(set(lines)) / len(lines), math.log1p(len(text))]


LAYOUT = len(layout(b""))


def url_parts(url) -> list[str]:
    """Top-level domain, the two last labels, every label and segment of the path."""
    if not url or "://" not in url:
        return []
    host, _, path = url.split("://", 1)[1].partition("/")
    labels = host.lower().split(".")
    return [labels[-1], ".".join(labels[-2:]), *labels, *(p for p in path.partition("?")[0].split("/") if p)]


def meta_features(source, lang, n_chars, url, html_size) -> list[float]:
    """Hashed source and language, log sizes, hashed URL parts; what is not known is not a number."""
    own, page = [0.0] * SOURCES, [0.0 if url is not None else math.nan] * URLS
    for kind, x in (("source", source), ("lang", lang)):
        if x is not None:
            own[zlib.crc32(f"{kind} {x}".encode()) % SOURCES] = 1.0
    for x in url_parts(url):
        page[zlib.crc32(x.encode()) % URLS] = 1.0
    k = math.nan if n_chars is None else math.log1p(max(n_chars, 0)) / 5
    return [*own, k, k * k / 2, *page, math.nan if html_size is None else math.log1p(html_size) / 10]


WIDTHS = (SURFACE + WORDS, LAYOUT + SOURCES + 2 + URLS + 1)


def probability(z) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class View:
    """A logistic classifier over standardised features; ``slope`` and ``shift`` calibrate its log odds."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        there = ~np.isnan(x)
        n = np.maximum(there.sum(0), 1)
        mean = np.where(there, x, 0).sum(0) / n
        deviation = np.sqrt(np.where(there, (x - mean) ** 2, 0).sum(0) / n)
        view = cls(mean, np.where(deviation < 1e-6, 1.0, deviation), np.zeros(0))  # what all rows share tells nothing, elsewhere too
        view.weights = logistic(view.standard(x), y, 3e-3, weight=weight)
        return view

    def standard(self, x: np.ndarray) -> np.ndarray:
        """What is not known counts as the mean."""
        return np.nan_to_num((x - self.mean) / self.deviation)

    @classmethod
    def flat(cls, width: int, share: float) -> View:
        return cls(np.zeros(width), np.ones(width), np.append(np.zeros(width), log_odds(share)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.weights[:-1] + self.weights[-1], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.slope + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = logistic(self.raw(x)[:, None], y.astype(float), 1e-4)
        self.slope, self.shift = float(max(a, 0)), float(b)


@dataclass
class Model:
    """Both views; the log odds of their sum, which counts the prior once; how many pseudo-labels each view took, by round and kind."""

    views: list[View]
    prior: float
    taken: list[dict] = field(default_factory=list)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = (v.logit(x) for v, x in zip(self.views, (text, meta)))
        return probability(t), probability(m), probability(t + m - self.prior)


class CoTraining:
    """The state of the rounds over ``labelled`` rows of both views; every fifth is kept for calibration."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = (text, meta), y
        at = np.arange(len(y))
        self.hold, self.fit = at[::5], np.delete(at, np.s_[::5])
        if len(set(y[self.fit])) < 2 or len(set(y[self.hold])) < 2:
            self.hold = self.fit = at
        self.base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.one_sided = len(set(y)) < 2
        self.more: list[list] = [[], []]  # pseudo-labelled rows of each view: (features, label)
        self.taken: list[dict] = []
        self.views = [self._view(k) for k in (0, 1)]

    def _view(self, k: int) -> View:
        if self.one_sided:
            return View.flat(WIDTHS[k] if not len(self.y) else self.x[k].shape[1], self.base)
        x, y, w = [self.x[k][self.fit]], [self.y[self.fit].astype(float)], [np.ones(len(self.fit))]
        for rows, label in self.more[k]:
            x.append(rows)
            y.append(np.full(len(rows), float(label)))
            w.append(np.full(len(rows), WEIGHT))
        return View.of(np.concatenate(x), np.concatenate(y), np.concatenate(w))

    def bounds(self, k: int) -> tuple[float, float]:
        """Log odds of view ``k`` up to which a pseudo-label 0, and from which 1, is confident: on kept rows ``CONFIDENT`` of those beyond are right, or as much better than chance as can be asked of the commoner kind."""
        z, y = self.views[k].raw(self.x[k][self.hold]), self.y[self.hold]
        out = []
        for label in (0, 1):
            own = z if label else -z
            need = max(CONFIDENT, 1 - (1 - self.base) / 2) if label == (self.base > 0.5) else CONFIDENT
            order = np.argsort(-own, kind="stable")
            right = np.cumsum(y[order] == label) / np.arange(1, len(order) + 1)
            good = np.flatnonzero((right >= need) & (np.arange(len(order)) >= 2))
            edge = own[order[good[-1]]] if len(good) else np.inf
            out.append(edge if label else -edge)
        return tuple(out)

    def learn(self, given: list[dict[int, np.ndarray]]) -> None:
        """``given[k][label]``: rows of view ``k``'s features that the other view is sure of."""
        self.taken.append({("text", "meta")[k]: {label: len(x) for label, x in rows.items()} for k, rows in enumerate(given)})
        for k, rows in enumerate(given):
            self.more[k] += [(x, label) for label, x in rows.items() if len(x)]
        self.views = [self._view(k) for k in (0, 1)]

    def model(self) -> Model:
        if not self.one_sided:
            for v, x in zip(self.views, self.x):
                v.calibrate(x[self.hold], self.y[self.hold])
        return Model(self.views, float(log_odds(self.base)), self.taken)


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())


def _unpack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(float)


def _of_texts(batches):
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = binary_list(part.column("text"))
            own = pa.array([np.array(layout(t), np.float32).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h", "source", "lang", "n_chars")), _pack(text_features(texts)), own], names=["doc_id", "h", "source", "lang", "n_chars", "text", "layout"])


def _of_pages(batches):
    for b in batches:
        if b.num_rows:
            own = np.array([meta_features(*r) for r in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars", "url", "html_size")))], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("text"), _pack(np.hstack([_unpack(b.column("layout"), LAYOUT), own]))], names=["doc_id", "h", "text", "meta"])


def features(docs: DataFrame, pages: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, h, text, meta) of every document, stored: what both views look at, in 32-bit numbers. Texts are not shuffled."""
    d = F.col(doc_id).cast("long")
    slim = docs.select(d.alias("doc_id"), F.xxhash64(d, F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"), *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")), (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars"))
    read = map_arrow(slim, _of_texts, "doc_id long, h long, source string, lang string, n_chars long, text binary, layout binary")
    if pages is None:
        wide = read.withColumns({"url": F.lit(None).cast("string"), "html_size": F.lit(None).cast("long")})
    else:
        page = pages.select(F.col("page_id").cast("long").alias("_gl_p"), F.struct("url", F.length("html").cast("long").alias("html_size")).alias("s")).where("_gl_p is not null").groupBy("_gl_p").agg(F.min("s").alias("s"))
        wide = read.join(page, F.col("doc_id") == F.col("_gl_p"), "left").select(*read.columns, "s.url", "s.html_size")
    return stored(map_arrow(wide, _of_pages, "doc_id long, h long, text binary, meta binary"))


def _raw(views: list[View]):
    def run(batches):
        for b in batches:
            if b.num_rows:
                z = [v.raw(_unpack(b.column(c), w)) for v, c, w in zip(views, ("text", "meta"), WIDTHS)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *map(pa.array, z)], names=["doc_id", "h", "z0", "z1"])

    return run


def _scores(model: Model):
    def run(batches):
        for b in batches:
            if b.num_rows:
                t, m, s = model.score(*(_unpack(b.column(c), w) for c, w in zip(("text", "meta"), WIDTHS)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t), pa.array(m), pa.array(s)], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def train(known: DataFrame, labels: DataFrame, doc_id: str = "doc_id", labelled: int = LABELLED, given: int = GIVEN, rounds: int = ROUNDS) -> Model:
    """The model over :func:`features` of all documents: fitted on at most ``labelled`` labelled ids, those of the smallest hash.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out from fit and pseudo-labels. Of contradicting labels the
    smaller counts, of several rows of one id that of the smallest hash. Every round scores all other rows on the
    executors; of what a view is sure of, and the other not of the contrary, up to ``given`` of each kind and view come back, the most confident ones.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("_gl_id"), F.col("quality").alias("y")).where("_gl_id is not null and y is not null").groupBy("_gl_id").agg(F.min("y").cast("int").alias("y"))
    free = known.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    ids = free.groupBy("doc_id").agg(F.min("h").alias("h")).join(marks, F.expr("doc_id = _gl_id")).select("doc_id", "h", "y")
    chosen = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    mine = free.join(F.broadcast(chosen.select(F.col("doc_id").alias("i"), F.col("h").alias("hi"), "y")), F.expr("doc_id = i and h = hi"))
    got = mine.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("meta").alias("meta"), F.first("y").alias("y")).orderBy("doc_id").collect()
    text, meta = (np.frombuffer(b"".join(bytes(r[c]) for r in got), np.float32).reshape(-1, w).astype(float) for c, w in zip(("text", "meta"), WIDTHS))
    state = CoTraining(text, meta, np.array([r["y"] for r in got], int))
    if state.one_sided:
        return state.model()
    seen: list[set] = [set(), set()]
    for _ in range(rounds):
        scores = map_arrow(free, _raw(state.views), "doc_id long, h long, z0 double, z1 double")
        scores = cut(scores.join(marks.select("_gl_id"), F.expr("doc_id = _gl_id"), "left_anti"))
        picks: list[dict[int, set]] = [{}, {}]
        edges = [state.bounds(k) for k in (0, 1)]
        for k in (0, 1):
            (low, high), (other_low, other_high) = edges[k], edges[1 - k]
            own, other = F.col(f"z{k}"), F.col(f"z{1 - k}")  # where the other view is sure of the contrary it learns nothing
            for label, rows in ((0, scores.where((own <= float(low)) & (other < float(other_high))).orderBy(own, "h")), (1, scores.where((own >= float(high)) & (other > float(other_low))).orderBy(own.desc(), "h"))):
                share = max(1, round(given * (state.base if label else 1 - state.base) * 2))
                found = {r["h"] for r in rows.select("h", f"z{k}").limit(min(share, given)).collect()}
                picks[1 - k][label] = found - seen[1 - k]
        both = [p[0] & p[1] for p in picks]
        picks = [{label: x - b for label, x in p.items()} for p, b in zip(picks, both)]
        wanted = sorted(set().union(*(x for p in picks for x in p.values())))
        if not wanted:
            break
        key = free.sparkSession.createDataFrame([(h,) for h in wanted], "hi long")
        rows = {r["h"]: r for r in free.join(F.broadcast(key), F.expr("h = hi")).select("h", "text", "meta").collect()}
        told = []
        for k, (c, w) in enumerate(zip(("text", "meta"), WIDTHS)):
            told.append({label: np.frombuffer(b"".join(bytes(rows[h][c]) for h in sorted(x)), np.float32).reshape(-1, w).astype(float) for label, x in picks[k].items()})
            seen[k] |= picks[k][0] | picks[k][1]
        state.learn(told)
    return state.model()


def quality(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, text_score, meta_score, score, kept (score >= ``threshold``).

    Null and empty texts are scored by what is left of their features, null metadata by its absence, and a document
    without a page by the rest. With labels of one kind only, or none, every document gets their share (or one half)
    and is kept. Repeated rows are scored alike; no documents give no rows.
    """
    known, place = features(docs, pages, doc_id, text)
    model = train(known, labels, doc_id)
    scored = cut(map_arrow(known, _scores(model), "doc_id long, text_score double, meta_score double, score double"))
    discard(docs.sparkSession, place)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= threshold).alias("kept"))
