"""Brute-force versions and small tables for the tests."""

import random

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("", "st", "nd", "rk") for c in ("en", "er", "il", "om", "us")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_df(spark, texts, first: int = 0, sources=("a", "b", None), **more):
    """Documents of the texts (None stays null), numbered from ``first``."""
    rows = [(first + i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def components(nodes, links) -> dict:
    """The smallest node that each one reaches."""
    owner = {n: n for n in nodes}

    def root(x):
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        owner[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def vectors_df(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def finite(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
