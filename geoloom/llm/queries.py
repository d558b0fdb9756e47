"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import cotrain_quality, ego_join, fst_bpe, mix_flow, paragraph_dedup, simhash_golay, token_frames, topk_segments, url_rules, weak_toxicity
from ._common import table


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero, repeated rows share a component, a null id stays. See :func:`.simhash_golay.near_duplicates`."""
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


def op1_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of each query vector; vectors that are null or hold null or non-finite components, and null ids, take no part. See :func:`.topk_segments.top_products`."""
    return topk_segments.top_products(table(spark, sf_dir, "embeddings"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fixed rule and verdict of every page; null and scheme-less URLs have empty parts and are allowed, repeated rows are judged one by one. See :func:`.url_rules.judge`."""
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, the one that stays and those to remove; null, empty and short texts have none, rows of equal id and text are one document. See :func:`.paragraph_dedup.repeated_passages`."""
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and choice of every vector; null, zero and non-finite ones link with nothing, repeated rows are vectors of their own. See :func:`.ego_join.near_vectors`."""
    return ego_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, null and empty texts included; repeated rows are scored alike. See :func:`.weak_toxicity.toxicity`."""
    return weak_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of every document's ids, written and read back; null and empty texts have the end id alone, repeated rows each have their place. See :func:`.token_frames.encoded_documents`."""
    return token_frames.encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests of every document's ids and of their decoding; null and empty texts have none, repeated rows are encoded one by one. See :func:`.fst_bpe.encoded_digests`."""
    return fst_bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null and empty texts give nothing, a null source is one of its own, rows alike are taken alike. See :func:`.mix_flow.mixed_sizes`."""
    return mix_flow.mixed_sizes(table(spark, sf_dir, "documents"))


def op10_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by both views and their sum; null texts and metadata count as absent, repeated rows are scored alike. See :func:`.cotrain_quality.quality`."""
    return cotrain_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


USABLE = "(SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"

SQL = {
    "op1_topk_segments": f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM {USABLE} WHERE vec_id IS NOT NULL),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_ego_join": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {USABLE} WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL has no Golay code, tokenizer, learned model or seeded mix, and no XXH64 in DuckDB: those are tested by brute force."""
    return dict(SQL)
