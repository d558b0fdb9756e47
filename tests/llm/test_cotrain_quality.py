import random
import zlib

import numpy as np
import pytest

from geoloom.llm import cotrain_quality as op

from .helpers import docs_df, prose


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    texts, good = [], []
    for i in range(700):
        g = rng.random() < 0.7
        texts.append(". ".join(prose(rng, 12).capitalize() for _ in range(rng.randrange(2, 9))) + "." if g else " ".join([rng.choice(["Click", "$$$", "!!!", "|", "buy"])] * rng.randrange(30, 90)))
        good.append(int(g))
    texts += ["", None, "word " * 60_000]
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(good) if i < 450] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, f"http://{'good' if good[i] else 'spam'}.org/{i}", "<p>" * 5) for i in range(500)] + [(None, None, None), (3, None, None)], "page_id long, url string, html string")
    return docs_df(spark, texts), labels, pages, good


def test_held_out_rows(data):
    docs, labels, pages, good = data
    rows = {r["doc_id"]: r for r in op.quality(docs, labels, pages).collect()}
    assert len(rows) == 703
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for i, r in rows.items())
    mine = [i for i in range(700) if rows[i]["held_out"]]
    assert np.mean([rows[i]["kept"] == bool(good[i]) for i in mine]) > 0.97
    assert np.mean([(rows[i]["meta_score"] >= 0.5) == bool(good[i]) for i in mine if i < 500]) > 0.9
    again = {r["doc_id"]: r["score"] for r in op.quality(docs.repartition(5), labels, pages).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in rows.items()}, abs=1e-12)


def test_without_pages_labels_or_columns(spark, data):
    docs, labels, _, good = data
    rows = op.quality(docs.select("doc_id", "text"), labels).collect()
    assert len(rows) == 703 and np.mean([r["kept"] == bool(good[r["doc_id"]]) for r in rows if r["doc_id"] < 700]) > 0.97
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["kept"]) for r in op.quality(docs, none).collect()} == {(0.5, True)}
    one = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in op.quality(docs, one).collect())
    assert op.quality(docs_df(spark, []), none).collect() == []


def test_clashing_columns_and_repeated_rows(spark, data):
    from pyspark.sql import functions as F

    docs, labels, pages, _ = data
    strange = docs.limit(30).withColumns({"i": F.lit(1), "y": F.lit("x"), "url": F.lit(3), "score": F.lit(0.0), "page_id": F.lit(9)})
    assert op.quality(strange.union(strange), labels, pages.withColumn("i", F.lit(1))).count() == 60


def two_views(seed, n=3000, labelled=300):
    rng = np.random.default_rng(seed)
    truth = (rng.random(n) < 0.6).astype(int)
    text, meta = (np.stack([truth + 0.6 * rng.normal(size=n), rng.normal(size=n)], 1) for _ in "ab")
    return text, meta, truth, labelled


def test_views_teach_each_other():
    text, meta, truth, k = two_views(2)
    state = op.CoTraining(text[:k], meta[:k], truth[:k])
    views = (text, meta)
    for _ in range(3):
        given = [{}, {}]
        for a in (0, 1):
            low, high = state.bounds(a)
            z = state.views[a].raw(views[a][k:])
            for label, at in ((0, np.flatnonzero(z <= low)), (1, np.flatnonzero(z >= high))):
                assert len(at) > 20 and np.mean(truth[k:][at] == label) > 0.6
                given[1 - a][label] = views[1 - a][k:][at[:200]]
        state.learn(given)
    model = state.model()
    assert all(n > 20 for told in model.taken for kind in told.values() for n in kind.values())
    assert all(v.slope > 0.1 for v in model.views)
    t, m, both = model.score(text[k:], meta[k:])
    right = [((p >= 0.5) == truth[k:]).mean() for p in (t, m, both)]
    assert right[2] > max(right[:2]) + 0.02 and right[2] > 0.85


def test_pseudo_labels_are_exchanged_over_the_table_and_both_views_carry_weight(spark, data):
    docs, labels, pages, good = data
    known, _ = op.features(docs, pages)
    model = op.train(known, labels)
    assert len(model.taken) > 0 and all(sum(told[v][label] for told in model.taken) > 2 for v in ("text", "meta") for label in (0, 1))
    assert all(v.slope > 0.1 and np.abs(v.weights[:-1]).max() > 0.05 for v in model.views)
    rows = {r["doc_id"]: r for r in known.collect()}
    got = {r["doc_id"]: r for r in op.quality(docs, labels, pages).collect()}
    for i in (0, 5, 300, 450, 650, 700, 702):  # the scoring pass, number by number
        z = []
        for v, c in zip(model.views, ("text", "meta")):
            x = np.frombuffer(bytes(rows[i][c]), np.float32).astype(float)
            raw = sum((a - b) / d * w for a, b, d, w in zip(x, v.mean, v.deviation, v.weights) if a == a) + v.weights[-1]
            z.append(min(max(raw, -30), 30) * v.slope + v.shift)
        for c, x in zip(("text_score", "meta_score", "score"), (*z, sum(z) - model.prior)):
            assert got[i][c] == pytest.approx(1 / (1 + np.exp(-x)), rel=1e-6, abs=1e-12)


def test_features():
    t = b"One one two, THREE a\n\nb b"
    own, words = op.surface(t)
    assert words == {b"one", b"two,", b"three", b"a", b"b"} and own[10] == pytest.approx(10 * 3 / 7)
    x = op.text_features([t, b""])
    assert x.shape == (2, op.WIDTHS[0]) and x[0, op.SURFACE :].sum() == pytest.approx(5 / 5**0.5) and not x[1, op.SURFACE :].any()
    assert op.layout(t)[4:8] == pytest.approx([1 / 3, op.layout(t)[5], 1, 1])
    assert "a-very-long-segment-of-a-path" in op.url_parts("http://a.b.com/x/a-very-long-segment-of-a-path?q=1")
    assert len(op.meta_features(None, None, None, None, None)) + op.LAYOUT == op.WIDTHS[1]


def test_repeated_ids_are_learned_from_once(spark, data):
    docs, labels, pages, _ = data
    known, _ = op.features(docs.union(docs).union(docs), pages)
    one, three = op.train(op.features(docs, pages)[0], labels), op.train(known, labels)
    assert np.allclose(one.views[0].mean, three.views[0].mean, atol=0.2)
