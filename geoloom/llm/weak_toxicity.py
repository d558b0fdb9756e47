"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters look at a document and vote toxic, clean or abstain: mined lexicon words of both kinds, a general lexicon, counts
of hits, patterns. Labels choose the voters and give the prior share of toxic documents, nothing else. The label model
sees votes alone: it estimates by expectation maximisation how often each voter is right and which voters are
correlated given the label (a group of correlated voters counts as one), and gives each training document a posterior.
A logistic classifier over tokens and votes is fitted to the posteriors and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import binary_list, cut, label_min, map_arrow

#: Bound on the labelled rows that the model is fitted on (those with the smallest hash of their id).
TRAIN_ROWS = 12_000
#: Bounds on the model, all parameters of :func:`train`: mined words that vote toxic, that vote clean, token features.
LEXICON, CLEAN, FEATURES = 160, 32, 400
#: Of a token: the least training documents; the least share of toxic ones among them to vote toxic; the log ratio of its shares to vote clean.
LEAST_DOCS, TOXIC_SHARE, CLEAN_GAP = 4, 0.9, -1.0
THRESHOLD = 0.3
#: A general lexicon of insults, one voter.
SEEDS = frozenset(
    b"idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers pathetic worthless scum trash garbage clown clowns disgusting imbecile retard retarded filth filthy vermin pig bastard bitch crap damn hate ugly fool fools foolish jerk creep freak psycho scumbag lowlife degenerate shut kill".split()
)
#: Lower case, and ASCII punctuation as spaces, byte by byte.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
PATTERNS = (re.compile(rb"[!?]{3,}"), re.compile(rb"\b[A-Z]{4,}\b[^a-z]{0,3}\b[A-Z]{4,}\b"), re.compile(rb"[A-Za-z][*@#$]+[A-Za-z]"), re.compile(rb"\b[Yy]ou(?: are|'re)\b"))


#: Bytes of the stems of words.
STEMS = (4, 5, 6)


def stems(word: bytes) -> list[bytes]:
    """Beginnings of a word that is longer, marked by a tilde."""
    return [b"~" + word[:k] for k in STEMS if len(word) > max(k, 4)]


def token_set(text: bytes) -> set[bytes]:
    """Distinct words, their stems, and, marked by two tildes, the stems that several of the words share."""
    own = set(text.translate(PLAIN).split())
    out = set(own)
    for k in STEMS:
        cut_ = [w[:k] for w in own if len(w) > max(k, 4)]
        once = set(cut_)
        out.update([b"~" + w for w in once])
        if len(once) < len(cut_):
            out.update([b"~~" + w for w, n in Counter(cut_).items() if n > 1])
    return out


def word_hits(own: set[bytes], lexicon: frozenset) -> int:
    """How many distinct words are in the lexicon, themselves, by a stem, or by one that several of them share."""
    active = lexicon & own
    if not active:
        return 0
    known = {t[1:] if t.startswith(b"~~") else t for t in active}
    return sum(w in known or not known.isdisjoint(stems(w)) for w in own if not w.startswith(b"~"))


def flags(text: bytes) -> int:
    return sum(1 << i for i, p in enumerate(PATTERNS) if p.search(text))


def log_odds(p):
    return np.log(p) - np.log1p(-p)


#: Voters that are no mined words: the general lexicon, one, two, three mined toxic words, each pattern.
GENERAL = ["seed", "one", "two", "three", *(f"pattern {k}" for k in range(len(PATTERNS)))]


def general_votes(own: set[bytes], lexicon: frozenset, f: int) -> list[bool]:
    """Which of ``GENERAL`` speak for toxic; "one" speaks for clean where it doesn't."""
    hits = word_hits(own, lexicon)
    return [not SEEDS.isdisjoint(own), hits > 0, hits > 1, hits > 2, *(bool(f >> i & 1) for i in range(len(PATTERNS)))]


@dataclass
class Model:
    lexicon: frozenset
    weights: dict
    voters: list  # weights of the general votes
    bias: float
    accuracies: dict  # of each voter: P(toxic | it votes toxic), P(toxic | it votes clean)
    groups: list
    posteriors: np.ndarray  # of the training rows, and their labels
    labels: np.ndarray

    def score(self, text: bytes) -> float:
        own = token_set(text)
        z = self.bias + sum(map(self.weights.__getitem__, self.weights.keys() & own))
        on = general_votes(own, self.lexicon, flags(text))
        z += sum(w for w, x in zip(self.voters, on) if x)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def at_share(z: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities of the log odds ``z``, moved alike so that their mean is the prior."""
    low, high = -100.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        q = 1 / (1 + np.exp(-np.clip(z + mid, -50, 50)))
        low, high = (mid, high) if q.mean() < prior else (low, mid)
    return q


def pieces(n: int, rows: int = 1024) -> list[slice]:
    """Ranges of rows. Matrices of 0, 1 and -1 stay bytes; only a piece at a time becomes floats, so the driver never holds them whole."""
    return [slice(at, min(n, at + rows)) for at in range(0, n, rows)]


def label_model(votes: np.ndarray, prior: float, rounds: int = 50, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Posterior of "toxic" from votes (+1, -1, 0) [documents][voters]; of each voter P(toxic | it votes +1 or -1); groups of correlated voters.

    An abstention tells nothing; a vote multiplies the odds by the ratio of the voter's odds to the prior's, and a group
    by the mean (of the logarithms) of those of its members that vote. The first guess is the prior's share of the
    documents with the most votes for toxic over clean, and that share holds in every round.
    """
    n, m = votes.shape
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    if not n:
        return np.zeros(0), np.full((m, 2), prior), [[j] for j in range(m)]
    counts = [(votes == v).sum(0) for v in (1, -1)]

    def first(strength):
        q = np.full(n, 0.05)
        q[(strength > 0) & (strength >= np.sort(strength)[::-1][max(0, round(prior * n) - 1)])] = 0.9
        return q

    q = first(votes.sum(1, dtype=float))
    # what voters still have in common when the label is known as well as it can be at first
    toxic, clean = (sum(c[at] @ votes[at].astype(float) for at in pieces(n)) / c.sum() for c in (q, 1 - q))

    def rest(at):
        return votes[at].astype(float) - np.outer(q[at], toxic) - np.outer(1 - q[at], clean)

    mean = sum(rest(at).sum(0) for at in pieces(n)) / n
    sd = np.sqrt(sum(((rest(at) - mean) ** 2).sum(0) for at in pieces(n)) / n)
    corr = sum((r := rest(at)).T @ r for at in pieces(n)) / n / np.maximum(np.outer(sd, sd), 1e-12)
    a, b = np.nonzero(np.triu(corr > least, 1))
    root = label_min(m, a, b)
    of = np.unique(root, return_inverse=True)[1]
    groups = [np.flatnonzero(of == g).tolist() for g in range(of.max() + 1)]
    member = np.zeros((m, len(groups)))
    member[np.arange(m), of] = 1

    def by_group(told):
        """Of each row: the sum over groups of the mean of what their voting members told; ``told``: from votes to floats."""
        return np.concatenate([((told(v := votes[at]) @ member) / np.maximum(np.abs(v) @ member, 1)).sum(1) for at in pieces(n)])

    q = first(by_group(lambda v: v.astype(float)))
    p = np.full((m, 2), prior)
    for _ in range(rounds):
        hits = [sum(q[at] @ (votes[at] == v) for at in pieces(n)) for v in (1, -1)]
        p = np.clip(np.stack([(h + prior) / (c + 1) for h, c in zip(hits, counts)], 1), 1e-3, 1 - 1e-3)
        weight = log_odds(p) - log_odds(prior)
        new = at_share(by_group(lambda v: (v == 1) * weight[:, 0] + (v == -1) * weight[:, 1]), prior)
        done = np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
    return q, p, groups


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the bias, not penalised) of a logistic model with soft targets, by damped Newton steps."""
    n, d = x.shape
    c = np.ones(n) if weight is None else weight
    ridge = np.append(np.full(d, l2), 1e-9)
    w = np.zeros(d + 1)

    def margins(w):
        return np.concatenate([np.zeros(0), *(x[at].astype(float) @ w[:-1] + w[-1] for at in pieces(n))])

    def loss(w):
        z = margins(w)
        return (c * (np.logaddexp(0, z) - target * z)).sum() / c.sum() + 0.5 * (ridge * w * w).sum()

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -500, 500)))
        g, h = ridge * w, np.diag(ridge + 1e-9)
        for own in pieces(n):
            a = np.hstack([x[own], np.ones((own.stop - own.start, 1))])
            g += a.T @ (c[own] * (p[own] - target[own])) / c.sum()
            h += (a * (c[own] * np.maximum(p[own] * (1 - p[own]), 1e-6))[:, None]).T @ a / c.sum()
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and (new := loss(w - size * step)) > at:
            size /= 2
        if size <= 1e-4 or at - new < 1e-7:
            break
        w, at = w - size * step, new
    return w


def fit(lexicon: list[bytes], clean: list[bytes], features: list[bytes], rows: list[tuple]) -> Model:
    """``rows``: (label, places of the features, of the toxic and of the clean words that it has, general votes) of the training rows.

    The label of a row is used for the prior alone; its vote is none of those that the label model sees.
    """
    general = len(GENERAL)
    if not rows:
        return Model(frozenset(), {}, [4.0, *[0.0] * (general - 1)], -3.0, {}, [], np.zeros(0), np.zeros(0))
    y = np.array([r[0] for r in rows])
    x = np.zeros((len(rows), len(features) + general), np.int8)
    votes = np.zeros((len(rows), len(lexicon) + len(clean) + general), np.int8)
    for i, (_, has, toxic_, clean_, on) in enumerate(rows):
        x[i, has] = 1
        x[i, len(features) :] = on
        votes[i, toxic_] = 1
        votes[i, np.array(clean_, int) + len(lexicon)] = -1
        votes[i, -general:] = on
        if not any(on[:2]):
            votes[i, GENERAL.index("one") - general] = -1
    q, p, groups = label_model(votes, y.mean())
    w = logistic(x, q)
    names = [*(t.decode("utf-8", "replace") for t in (*lexicon, *clean)), *GENERAL]
    return Model(frozenset(lexicon), dict(zip(features, w[: len(features)].tolist())), w[len(features) : -1].tolist(), float(w[-1]), {k: a.tolist() for k, a in zip(names, p)}, groups, q, y)


def held_out(doc_id):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _tokens(batches):
    """Documents of a piece of the input that have a token, and those of them that are labelled toxic."""
    every, toxic = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(every), pa.binary()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[w] for w in every], pa.int64())], names=["token", "k", "k1"])
        every.clear()
        toxic.clear()
        return out

    for b in batches:
        for at in range(0, b.num_rows, 256):
            piece = b.slice(at, 256)
            for y, t in zip(piece.column("y").to_pylist(), binary_list(piece.column("text"))):
                own = token_set(t)
                every.update(own)
                if y:
                    toxic.update(own)
            if len(every) > 200_000:
                yield counted()
    yield counted()


def _votes(lexicon: list[bytes], clean: list[bytes], features: list[bytes]):
    def run(batches):
        mined = frozenset(lexicon)
        places = [{w: i for i, w in enumerate(x)} for x in (features, lexicon, clean)]
        for b in batches:
            rows = []
            for t in (t for at_ in range(0, b.num_rows, 256) for t in binary_list(b.column("text").slice(at_, 256))):
                own = token_set(t)
                rows.append((*(sorted(at[w] for w in at.keys() & own) for at in places), general_votes(own, mined, flags(t))))
            lists = [pa.array([r[i] for r in rows], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("i"), *lists], names=["y", "i", "has", "toxic", "clean", "votes"])

    return run


def pick_tokens(sample: DataFrame, lexicon: int = LEXICON, clean: int = CLEAN, features: int = FEATURES) -> list[list[bytes]]:
    """[toxic words, clean words, features] of ``sample(y, text)``: the tokens whose share among toxic documents differs most from that among clean ones."""
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    counts = map_arrow(sample.select("y", "text"), _tokens, "token binary, k long, k1 long").groupBy("token").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1")).where(F.col("k") >= LEAST_DOCS)
    gap = F.log((F.col("k1") + 0.5) / (total["pos"] + 1.0)) - F.log((F.col("k") - F.col("k1") + 0.5) / (total["n"] - total["pos"] + 1.0))
    share = (F.col("k1") + 0.5) / (F.col("k") + 1)
    ranked = cut(counts.select("token", share.alias("share"), F.round(gap, 9).alias("gap"), F.round(F.abs(gap) * F.sqrt("k"), 9).alias("lift")))
    picks = ((ranked.where(F.col("share") >= TOXIC_SHARE), lexicon), (ranked.where(F.col("gap") < CLEAN_GAP), clean), (ranked, features))
    return [[bytes(r["token"]) for r in df.orderBy(F.desc("lift"), "token").limit(most).collect()] for df, most in picks]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, lexicon: int = LEXICON, clean: int = CLEAN, features: int = FEATURES) -> Model:
    """The model of at most ``rows`` labelled ids that are not held out, those of the smallest hash.

    Contradicting labels of one id: the larger. Of several texts of one id that of the smallest hash. Null ids and labels
    take no part; without labels the general lexicon alone decides.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("_gl_id"), F.col(label).alias("y")).where("_gl_id is not null and y is not null").where(~held_out(F.col("_gl_id")))
    known = known.groupBy("_gl_id").agg(F.max("y").cast("int").alias("y"))
    slim = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("text"))
    ids = slim.select("i").distinct().join(known, F.expr("i = _gl_id")).select("_gl_id", "y")
    chosen = cut(ids.orderBy(F.xxhash64("_gl_id"), "_gl_id").limit(rows))
    mine = slim.join(F.broadcast(chosen), F.expr("i = _gl_id"))
    mine = cut(mine.groupBy("i", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    picked = pick_tokens(mine, lexicon, clean, features)
    got = map_arrow(mine, _votes(*picked), "y int, i long, has array<int>, toxic array<int>, clean array<int>, votes array<boolean>").collect()
    return fit(*picked, [(r["y"], r["has"], r["toxic"], r["clean"], r["votes"]) for r in sorted(got, key=lambda r: r["i"])])


def _score(model: Model):
    def run(batches):
        for b in batches:
            texts = (t for at in range(0, b.num_rows, 256) for t in binary_list(b.column("_gl_text").slice(at, 256)))
            s = np.fromiter(map(model.score, texts), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(s)], names=[*b.schema.names[:-1], "_gl_score"])

    return run


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with its columns and ``_gl_score``; null texts are scored as empty ones."""
    wide = docs.withColumn("_gl_text", F.col(text).cast("string"))
    schema = StructType([*docs.schema, StructField("_gl_score", DoubleType())])
    return map_arrow(wide, _score(model), schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    Only the text is looked at. Null and empty texts get the score of no evidence. Without labels the general lexicon
    alone decides. Repeated rows are scored alike; no documents give no rows.
    """
    model = train(docs, labels, doc_id, text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = with_score(slim, model).select("doc_id", F.col("_gl_score").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with their columns, without those that score ``threshold`` or more.

    Null and empty texts score as no evidence does and stay; repeated rows are scored alike; no documents give no rows.
    """
    return with_score(docs, train(docs, labels, doc_id, text), text).where(F.col("_gl_score") < threshold).drop("_gl_score")
