import random

import numpy as np
import pytest

from geoloom.llm import paragraph_dedup as op

from .helpers import components, docs_df, prose


def lines_of(texts):
    """(doc, first word, end word, shingles) of the lines with enough words."""
    out = []
    for d, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            words = line.encode().lower().split()
            if len(words) >= op.MIN_WORDS:
                out.append((d, at, at + len(words), {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
            at += len(words)
    return out


def classes(texts):
    lines = lines_of(texts)
    links = [(i, j) for i, (*_, a) in enumerate(lines) for j, (*_, b) in enumerate(lines[:i]) if len(a & b) >= 0.8 * len(a | b)]
    found = components(range(len(lines)), links)
    by = {}
    for i, c in found.items():
        by.setdefault(c, []).append(lines[i][:3])
    return [sorted(x) for x in by.values() if len({d for d, *_ in x}) > 1]


def changed(rng, line, n):
    words = line.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    line, common, passage = prose(rng, 60), prose(rng, 30), prose(rng, 55)
    chain = [line]
    for _ in range(6):
        chain.append(changed(rng, chain[-1], 1))
    out = [f"{prose(rng, 40)}\n{x}\n{prose(rng, 35)}" for x in chain]  # a chain of near lines, the ends far apart
    out += [f"{prose(rng, 30)}\n{common}\n{common.upper()}" for _ in range(5)]
    out += [f"{prose(rng, 33)} {passage} {prose(rng, 47)}" for _ in range(4)]  # inside lines
    out += [prose(rng, 200) for _ in range(10)]  # clean
    twice = prose(rng, 40)
    out += [f"{twice}\n{twice}", "", None, " \n \n", "short line", prose(rng, 5000)]
    return [*out, out[22], "É " * 30 + "\n" + prose(rng, 24)], passage


def rows_of(df):
    return sorted((r["doc_id"], r["start_word"], r["end_word"], r["kept"]) for r in df.collect())


def test_lines_against_all_pairs(spark, texts):
    all_, _ = texts
    words, _ = op.words_of(op._slim(docs_df(spark, all_), "doc_id", "text"))
    spans = op.paragraph_spans(words, op.keys_met(words)).collect()
    got = sorted((r["d"], r["start"], r["stop"], r["hd"], r["kind"] == op.FIRST) for r in spans)
    assert got == sorted((d, a, e, x[0][0], (d, a) == x[0][:2]) for x in classes(all_) for d, a, e in x)
    assert any(len(x) == 7 for x in classes(all_))


def test_short_lines(spark):
    rng = random.Random(13)
    five, ten, line = prose(rng, 5), prose(rng, 10), prose(rng, 24)
    near = " ".join([*line.split()[:-1], "changed"])
    texts = [f"{five}\n{ten}\n{line}", f"{near}\n{ten}", f"{prose(rng, 9)}\n{five}", "four words are few\na", "four words are few\nb"]
    assert rows_of(op.repeated_passages(docs_df(spark, texts))) == [(0, 15, 39, True), (1, 0, 24, False)]  # clean documents repeat short lines
    assert rows_of(op.repeated_passages(docs_df(spark, texts), min_words=5)) == [(0, 0, 39, True), (1, 0, 24, False), (1, 24, 34, False), (2, 9, 14, False)]


def test_passages(spark, texts):
    all_, passage = texts
    rows = rows_of(op.repeated_passages(docs_df(spark, all_)))
    words = [(t or "").encode().lower().split() for t in all_]
    want = passage.encode().split()
    holders = [d for d, w in enumerate(words) if b" ".join(want) in b" ".join(w)]
    assert len(holders) == 4
    for d in holders:
        at = next(i for i in range(len(words[d])) if words[d][i : i + len(want)] == want)
        inside = [r for r in rows if r[0] == d and at <= r[1] and r[2] <= at + len(want)]
        assert inside and (all(r[3] for r in inside) if d == holders[0] else not all(r[3] for r in inside))
    clean = set(range(16, 22)) | set(range(23, 26))
    assert not clean & {r[0] for r in rows}
    assert {22, len(all_) - 2} <= {r[0] for r in rows}
    assert 26 not in {r[0] for r in rows}  # what repeats within one document only


def test_whole_passages(spark):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (42, 51, 60, 120) for _ in range(6)]
    sides = [(f"l{k}", f"r{k}") for k in range(3 * len(passages))]  # no passage goes on by chance
    texts = [f"{prose(rng, 31)} {sides[3 * i + k][0]} {p} {sides[3 * i + k][1]} {prose(rng, 37)}" for k in range(3) for i, p in enumerate(passages)]
    rows = rows_of(op.repeated_passages(docs_df(spark, texts)))
    assert rows == sorted((k * len(passages) + i, 32, 32 + len(p.split()), k == 0) for k in range(3) for i, p in enumerate(passages))
    for r in op.without_repeats(docs_df(spark, texts)).collect():
        i = r["doc_id"] % len(passages)
        left, right = texts[r["doc_id"]].split(passages[i])
        assert r["text"] == (texts[i] if r["doc_id"] == i else left + right.lstrip())


def test_passages_twice_in_a_document(spark):
    rng = random.Random(12)
    p = prose(rng, 60)
    texts = [f"{prose(rng, 30)} a{k} {p} b{k} {prose(rng, 50)} c{k} {p} d{k} {prose(rng, 20)}" for k in range(3)]
    texts += [f"{prose(rng, 30)} e {p} f", "x y " * 60 + prose(rng, 30), "x y " * 60 + prose(rng, 30)]
    for parts in (1, 4):
        rows = rows_of(op.repeated_passages(docs_df(spark, texts).repartition(parts)))
        assert [r for r in rows if r[0] < 4] == sorted([*((k, a, a + 60, (k, a) == (0, 31)) for k in range(3) for a in (31, 143)), (3, 31, 91, False)])
        left = {r["doc_id"]: r["text"] for r in op.without_repeats(docs_df(spark, texts)).collect()}
    assert [left[k].count(p) for k in range(4)] == [1, 0, 0, 0] and "x y x y" in left[4] and "x y" not in left[5]


def test_cutting(spark, texts):
    all_, passage = texts
    df = docs_df(spark, all_).withColumnRenamed("lang", "spans").withColumnRenamed("source", "comp")
    out = op.without_repeats(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(all_) - 2 not in rows and len(rows) == len(all_) - 1  # a copy is cut to nothing
    for i in range(16, 26):
        assert rows[i]["text"] == all_[i] and rows[i]["n_chars"] == len(all_[i])
    assert rows[0]["text"] == all_[0] and rows[27]["text"] == "" and rows[28]["text"] is None
    assert all_[7].split("\n")[1] in rows[7]["text"] and all(all_[7].split("\n")[1] not in rows[i]["text"] for i in range(8, 12))
    assert all(rows[i]["n_chars"] == len(rows[i]["text"]) for i in rows if rows[i]["text"] is not None)
    assert rows_of(op.repeated_passages(op.without_repeats(docs_df(spark, all_)))) == []


def test_repeated_rows_and_none(spark):
    rng = random.Random(3)
    t = prose(rng, 60)
    df = docs_df(spark, [t, prose(rng, 60)])
    assert op.repeated_passages(df.union(df)).collect() == []  # equal id and text: one document
    nulls = spark.createDataFrame([(None, t), (None, prose(rng, 40)), (4, t)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["kept"]) for r in op.repeated_passages(nulls).collect()) == [(False, False), (True, True)]
    assert op.repeated_passages(docs_df(spark, [])).collect() == [] and op.without_repeats(docs_df(spark, [])).collect() == []


def test_bands_meet():
    rng = random.Random(5)
    met = n = 0
    for _ in range(150):
        line = prose(rng, 80)
        other = changed(rng, line, 1)
        a, b = (op.runs(op.word_hashes(x.encode()), 5) for x in (line, other))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(np.union1d(a, b))):
            n += 1
            met += (op.band_keys(a, np.array([0])) == op.band_keys(b, np.array([0]))).any()
    assert n > 50 and met >= 0.98 * n
    assert op.tune_bands(0.8, 0.999, 4) == 14 and op.tune_bands() == op.BANDS == 10


def test_few_shingles_always_meet():
    rng = np.random.default_rng(7)
    near = 0
    for _ in range(3000):
        n = int(rng.integers(1, 26))
        pool = rng.integers(0, 2**63, n + 6, dtype=np.uint64)
        a = pool[:n]
        b = np.concatenate((rng.choice(a, max(1, n - int(rng.integers(0, 3))), replace=False), pool[n : n + int(rng.integers(0, 3))]))
        a, b = (rng.permutation(np.concatenate((x, rng.choice(x, int(rng.integers(0, 30)))))) for x in (a, b))  # some of them more than once
        x, y = set(a.tolist()), set(b.tolist())
        if len(x & y) >= 0.8 * len(x | y):
            near += 1
            group, key = op.line_keys(np.concatenate((a, b)), np.array([0, len(a)]))
            if min(len(x), len(y)) <= 19:  # else the bands decide, with their recall
                assert set(key[group == 0].tolist()) & set(key[group == 1].tolist()), (len(x), len(y))
    assert near > 800


def test_any_long_enough_run_is_chosen_in_both():
    rng = random.Random(6)
    for _ in range(50):
        shared = prose(rng, op.RUN + op.WINDOW - 1)
        chosen = []
        for _ in "ab":
            h = op.runs(op.word_hashes(f"{prose(rng, rng.randrange(90))} {shared} {prose(rng, rng.randrange(90))}".encode()), op.RUN)
            chosen.append(set(h[op.winnow(h)].tolist()))
        assert chosen[0] & chosen[1]


def test_bitmap(spark):
    ids = [5, -7, (1 << 62) + 1, -(1 << 63) + 1, 123456789]
    bits = np.frombuffer(op.bitmap_of(spark.createDataFrame([(x,) for x in ids], "c long"), 16), np.uint8)
    at = {x >> 1 & 0xFFFF for x in ids}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == at


def plain(text):
    return (text or "").encode().lower().split()


def holds(words, part):
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


def test_nothing_vanishes_with_its_holder(spark):
    rng = random.Random(21)
    paragraph, tail = prose(rng, 400), prose(rng, 42)
    texts = [paragraph, f"{paragraph} {tail}", f"{prose(rng, 30)} a {tail} b {prose(rng, 30)}"]
    left = {r["doc_id"]: r["text"] for r in op.without_repeats(docs_df(spark, texts)).collect()}
    assert left[0] == texts[0] and left[1] == tail and tail not in left[2] and len(plain(left[2])) == 62


def test_nothing_vanishes(spark):
    """Each word that goes as a part of a passage stands in the output with the words around it; each line has its first still, or what that one gave up."""
    for seed in range(2):
        rng = random.Random(100 + seed)
        pool = [prose(rng, rng.randrange(20, 160)) for _ in range(12)]
        texts = []
        for _ in range(60):
            parts = []
            for _ in range(rng.randrange(1, 6)):
                p = rng.choice(pool).split()
                kind = rng.randrange(5)
                if kind == 1:
                    p = p[rng.randrange(len(p) // 2) :]
                elif kind == 2:
                    p = p[: rng.randrange(len(p) // 2, len(p))]
                elif kind == 3:
                    p[rng.randrange(len(p))] = "changed"
                elif kind == 4:
                    p = prose(rng, rng.randrange(60)).split()
                parts.append(" ".join(p) + rng.choice((" ", "\n", " the ")))
            texts.append("".join(parts).strip())
        df = docs_df(spark, texts).repartition(5)
        rows = op.repeated_passages(df).collect()
        out = {r["doc_id"]: plain(r["text"]) for r in op.without_repeats(df).collect()}
        grams = {tuple(w[i : i + k]) for w in out.values() for k in (5,) for i in range(len(w) - k + 1)}
        classes_ = classes(texts)
        gone = {(r["doc_id"], i) for r in rows if not r["kept"] for i in range(r["start_word"], r["end_word"])}
        runs = 0
        in_lines = {(d, i) for x in classes_ for d, a, e in x for i in range(a, e)}
        for r in rows:  # what goes, and is no part of a repeated line, stands whole where the row says
            if not r["kept"] and not any((r["doc_id"], i) in in_lines for i in range(r["start_word"], r["end_word"])):
                assert holds(out[r["holder_id"]], plain(texts[r["doc_id"]])[r["start_word"] : r["end_word"]])
                runs += 1
        for x in classes_:  # the first line of a class: what of it is gone stands elsewhere, but for the seams
            d, a, e = x[0]
            w = plain(texts[d])
            lost = [i for i in range(a, e) if (d, i) in gone]
            assert all(any(tuple(w[j : j + 5]) in grams for j in range(max(a, i - 4), min(i, e - 5) + 1)) for i in lost)
        for r in rows:
            if r["kept"]:
                assert holds(out[r["doc_id"]], plain(texts[r["doc_id"]])[r["start_word"] : r["end_word"]])
        assert runs > 5
