"""Each stage against a brute-force version over what the stage before it kept."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from geoloom.llm import simhash_golay, weak_toxicity

from .helpers import components, docs_df, prose, simhash
from .test_paragraph_dedup import classes


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(1)
    texts, toxic = [], []
    for i in range(300):
        text = f"{prose(rng, rng.randrange(30, 90))}\n{prose(rng, rng.randrange(10, 60))}"
        if i % 6 == 0:
            text += " snargle blorvik grumptak"
        texts.append(text)
        toxic.append(int(i % 6 == 0))
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 40)}\n{shared}\n{prose(rng, 40)}" for _ in range(5)]
    words = prose(rng, 500).split()
    texts += [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in (5, 200, 400)] + [" ".join(words)] * 2
    texts += ["", None, prose(rng, 8000)]
    out = str(tmp_path_factory.mktemp("sf"))
    docs_df(spark, texts, sources=("a", "b", "c", None)).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], r["text"] or ""))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, rows(docs)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k == 4:
            break
        assert out.columns == columns
        out = out.cache()
        after = rows(out)
        if k == 0:
            model = weak_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert after == [r for r in before if model.score((r["text"] or "").encode()) < 0.3]
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == set(range(0, 300, 6))
        if k == 1:
            fps = [simhash(r["text"]) for r in before]
            comp = components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash_golay.MAX_BITS])
            assert after == [r for i, r in enumerate(before) if comp[i] == i]
            assert len(after) <= len(before) - 5
        if k == 2:
            assert classes([r["text"] for r in before]) and not classes([r["text"] for r in after])
            gone = {r["doc_id"]: r["text"] for r in after}
            assert all(gone[r["doc_id"]] == r["text"] for r in before if r["doc_id"] < 301)
        if k == 3:
            by = {r["doc_id"]: r for r in before}
            assert all(r == by[r["doc_id"]] for r in after)
            assert max(sum(x["doc_id"] == r["doc_id"] for x in after) for r in after) <= 3
        docs, before = out, after
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = []
    for r in before:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_empty_table(spark, tmp_path):
    docs_df(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    """Columns named like those that the operators use inside, repeated ids and rows, nulls everywhere."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(40)] + ["", None, " \n", "one"]
    base = docs_df(spark, texts, sources=("a", None, "b"))
    docs = base.unionByName(base.limit(10)).unionByName(base.limit(5).withColumn("text", F.lit(prose(rng, 50))))
    docs = docs.unionByName(base.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for i, c in enumerate(("th", "key", "comp", "k", "g", "h", "c", "x", "d", "fp", "first", "s", "n", "start", "kind", "size", "hash", "spread", "y", "i", "word", "bucket", "data", "score", "held_out", "pattern", "total")):
        docs = docs.withColumn(c, F.lit(i) if i % 3 else F.lit(None).cast("string"))
    docs = docs.cache()
    spark.createDataFrame([(i, None, int(i == 7)) for i in range(20)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path)).cache()
        sizes.append(out.count())
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert sizes[1] < sizes[0] and sizes[4] == sizes[3] > 0
