import random

import numpy as np
import pytest

from geoloom.llm import simhash_golay as op

from .helpers import components, docs_df, prose, simhash


def test_fingerprint():
    rng = random.Random(2)
    for text in ("", "one", "Two Words", "three words here", "ÄB ÄB\tx\x0bÄB", prose(rng, 500), "\u00a0 \u2003 a\x1cb c d"):
        assert op.fingerprint(text.encode()) == simhash(text)


def test_golay_is_perfect():
    _, errors = op.golay()
    words = np.random.default_rng(3).integers(0, 1 << 23, 2000)
    for bit in range(23):  # a word's nearest codeword is in the list of every word one bit away
        near, other = op.codewords(words)[:, :1], op.codewords(words ^ (1 << bit))
        assert (near == other).any(1).all()
    assert len(errors) == 2048


def test_any_three_bits_share_a_key():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    a, b = op.fuzzy_keys(fps), op.fuzzy_keys(fps ^ flips)
    assert (a[:, :, :1] == b).any((1, 2)).all()


def near(fp, bits, rng):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("block", [2048, 16])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    hot = rng.getrandbits(64)
    fps = {x for b in base for x in (b, near(b, 3, rng), near(b, 4, rng), near(near(b, 3, rng), 3, rng))} | {near(hot, rng.randrange(3), rng) for _ in range(150)}
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    links = op.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), block).collect()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert components(fps, [tuple(r) for r in links]) == components(fps, pairs)
    assert len(links) < 60 * len(fps)  # forests, not all pairs


def texts(rng):
    long = prose(rng, 400)
    words = long.split()
    close = [" ".join(words[:i] + ["X"] + words[i + 1 :]) for i in (3, 100, 399)]
    return [long, long.upper(), *close, prose(rng, 400), "", None, "  \n", "one", "ONE", prose(rng, 3000), *[prose(rng, 30) for _ in range(20)], long]


def test_near_duplicates(spark):
    all_ = texts(random.Random(6))
    df = docs_df(spark, all_).withColumnRenamed("lang", "fp").withColumnRenamed("source", "comp")  # clashing names
    rows = op.near_duplicates(df).collect()
    fps = [simhash(t) for t in all_]
    want = components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in want}


def test_one_of_a_group_stays(spark):
    all_ = texts(random.Random(7))
    df = docs_df(spark, all_, sources=("s",))
    twice = df.unionByName(df.where("doc_id in (0, 5)"))
    kept = op.without_near_duplicates(twice)
    assert kept.columns == df.columns
    want = {r["component_id"] for r in op.near_duplicates(df).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    nulls = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    assert sorted(map(repr, op.without_near_duplicates(nulls).collect())) == sorted(["Row(doc_id=3, text='a b c d')", "Row(doc_id=None, text='q r s t')"])


def test_empty_table(spark):
    df = docs_df(spark, [])
    assert op.near_duplicates(df).collect() == [] and op.without_near_duplicates(df).collect() == []


def test_near_copies_go_whatever_their_bits(spark):
    rng = random.Random(21)
    texts, near = [], 0
    for i in range(30):
        words = prose(rng, 300).split()
        edited = list(words)
        for at in range(20, 20 + 25 * (1 + i % 6), 25):
            edited[at] = "edited"
        texts += [" ".join(words), " ".join(edited)]
        a, b = ({tuple(w[k : k + 5]) for k in range(296)} for w in (words, edited))
        assert len(a & b) >= 0.8 * len(a | b)
        near += (simhash(texts[-1]) ^ simhash(texts[-2])).bit_count() <= op.MAX_BITS
    assert near < 15  # few of them are within three bits
    assert sorted(r["doc_id"] for r in op.without_near_duplicates(docs_df(spark, texts)).collect()) == list(range(0, 60, 2))
