import random
import zlib

import numpy as np
import pytest

from geoloom.llm import weak_toxicity as op

from .helpers import docs_df, prose


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    bad = ["snargle", "blorvik", "grumptak", "vexnorg", "vexnurr", "vexnipp"]
    texts, toxic = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 120)).split()
        t = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if t else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(t != (i % 97 == 0)))  # a few labels are wrong
    texts += ["", None, "snargle blorvik grumptak " * 10_000]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs_df(spark, texts), labels, [i % 5 == 0 for i in range(900)]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_rows(data):
    docs, labels, truth = data
    rows = {r["doc_id"]: r for r in op.toxicity(docs, labels).collect()}
    assert len(rows) == 903
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    mine = [i for i in range(900) if held(i)]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in mine]) > 0.97
    assert rows[902]["predicted"] == 1 and rows[900]["predicted"] == 0 and rows[900]["score"] == rows[901]["score"]


def test_only_the_text_counts_and_held_out_labels_are_not_seen(spark, data):
    docs, labels, _ = data
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    strange = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("toxic")).withColumn("n_chars", F.lit(0)).withColumn("y", F.lit(1)).withColumn("token", F.lit(1))
    a = {r["doc_id"]: r["score"] for r in op.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in op.toxicity(strange, other).collect()}
    assert a == b


def test_rejecting_keeps_columns_and_rows(spark, data):
    docs, labels, _ = data
    kept = op.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(r["doc_id"] for r in op.toxicity(docs, labels).where("predicted = 0").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    twice = docs.limit(20).union(docs.limit(20))
    assert op.toxicity(twice, labels).count() == 40


def test_without_labels(spark):
    docs = docs_df(spark, ["you pathetic idiot", "fine words", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["predicted"] for r in op.toxicity(docs, none).collect()} == {0: 1, 1: 0, 2: 0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert op.toxicity(docs, one).count() == 3
    assert op.toxicity(docs_df(spark, []), none).collect() == [] and op.without_toxic(docs_df(spark, []), none).collect() == []


def test_label_model_finds_accuracies_and_groups():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, 6), np.int8)
    for j, acc in enumerate((0.9, 0.85, 0.8, 0.8)):
        votes[:, j] = np.where((rng.random(4000) < acc) == y, 1, -1)
    votes[:, 4] = votes[:, 3]  # the same voter again
    votes[:, 5] = np.where(rng.random(4000) < 0.5, 1, -1)
    q, p, groups = op.label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.9 and [3, 4] in groups
    true = np.array([[y[votes[:, j] == v].mean() for v in (1, -1)] for j in range(6)])
    assert np.abs(p - true).max() < 0.12
    assert abs(p[5, 0] - 0.3) < 0.1 and q.mean() == pytest.approx(0.3, abs=0.02)


def test_posteriors_come_from_the_votes_not_from_the_labels(data):
    docs, labels, truth = data
    model = op.train(docs, labels)
    wrong = [i for i in range(900) if not held(i) and i % 97 == 0]
    order = [i for i in range(900) if not held(i)]
    assert len(model.posteriors) == len(order) and len(wrong) > 3
    at = {i: k for k, i in enumerate(order)}
    for i in wrong:  # the label says one thing, the words of the document another
        assert model.labels[at[i]] == (not truth[i]) and (model.posteriors[at[i]] > 0.5) == truth[i]


def test_labels_give_the_label_model_nothing_but_their_share():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        t = rng.random() < 0.3
        mine = [j for j in range(3) if t and rng.random() < 0.7]
        rows.append((int(t), mine, mine, [], [False, bool(mine), len(mine) > 1, len(mine) > 2, *[False] * len(op.PATTERNS)]))
    words = [b"aaa", b"bbb", b"ccc"]
    shuffled = [(y, *r[1:]) for y, r in zip(rng.permutation([r[0] for r in rows]).tolist(), rows)]
    one, two = op.fit(words, [], words, rows), op.fit(words, [], words, shuffled)
    assert np.array_equal(one.posteriors, two.posteriors) and one.weights == two.weights
    assert {"aaa", "seed", "one"} <= set(one.accuracies) and "label" not in one.accuracies


def test_scoring_against_brute_force(data):
    docs, labels, _ = data
    model = op.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op.toxicity(docs, labels).collect()}
    for r in docs.collect():
        own, words = set(), (r["text"] or "").lower().split()
        own |= set(words)
        for k in op.STEMS:
            for w in set(words):
                if len(w) > max(k, 4):
                    own.add("~" + w[:k])
                    if sum(x[:k] == w[:k] and len(x) > max(k, 4) for x in set(words)) > 1:
                        own.add("~~" + w[:k])
        z = model.bias + sum(w for t, w in model.weights.items() if t.decode() in own)
        lexicon = {t.decode() for t in model.lexicon} & own
        hits = sum(any(t == w or t.startswith("~") and len(w) > max(len(t.lstrip("~")), 4) and w.startswith(t.lstrip("~")) for t in lexicon) for w in set(words))
        on = [bool({x.decode() for x in op.SEEDS} & set(words)), hits > 0, hits > 1, hits > 2, *[False] * len(op.PATTERNS)]
        z += sum(w for w, x in zip(model.voters, on) if x)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9, abs=1e-12)


def test_one_row_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(i % 40, f"fine words {i}", "en", "a", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert len(op.train(docs, labels).labels) == sum(not held(i) for i in range(40))


def test_tokens():
    assert op.token_set(b"Abcdefg abcdexx, no!") == {b"abcdefg", b"abcdexx", b"no", b"~abcd", b"~abcde", b"~abcdef", b"~abcdex", b"~~abcd", b"~~abcde"}
    assert op.word_hits(op.token_set(b"abcdefg abcdexx"), frozenset({b"~~abcd"})) == 2
    assert op.word_hits(op.token_set(b"abcdefg zzz"), frozenset({b"~~abcd"})) == 0


def test_the_fit_holds_no_matrix_of_floats():
    """The most labelled rows that are fitted, with all voters and features: as floats each matrix alone would take 20 to 40 MB of the driver."""
    import tracemalloc

    rng = np.random.default_rng(6)
    lexicon, clean, features = ([b"%s%d" % (k, i) for i in range(n)] for k, n in ((b"t", op.LEXICON), (b"c", op.CLEAN), (b"f", op.FEATURES)))
    rows = []
    for i in range(op.TRAIN_ROWS):
        toxic = sorted(set(rng.integers(0, op.LEXICON, 4).tolist())) if i % 10 == 0 else []
        some = sorted(set(rng.integers(0, op.FEATURES, 10).tolist()))
        rows.append((int(bool(toxic)), some, toxic, [] if toxic else [i % op.CLEAN], [bool(toxic)] * 4 + [False] * (len(op.GENERAL) - 4)))
    tracemalloc.start()
    model = op.fit(lexicon, clean, features, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and ((model.posteriors > 0.5) == (model.labels > 0)).mean() > 0.99
