"""A corpus pipeline of five stages, each one of the training-data operators over all that its predecessor kept.

All stages but the last return the columns of the documents, extra ones too. No stage fails on nulls in any column, empty or
very long texts, ties, repeated rows or an empty table; what becomes of these stands in each stage's docstring.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import fst_bpe, mix_flow, paragraph_dedup, simhash_golay, weak_toxicity
from geoloom.llm._common import discard, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty texts show no toxicity and stay; repeated rows share their lot."""
    return weak_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, null ids last.

    Of equal ids the text of the smallest hash stays, of rows alike in both one. Null and empty texts are one group.
    """
    return simhash_golay.without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has too; those cut to nothing go. Null, empty and short texts stay as they are."""
    return paragraph_dedup.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most. Null texts and those without words are not taken; a null source is one of its own."""
    return mix_flow.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of their decoding, one row a row; null and empty texts have no ids."""
    return fst_bpe.encoded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_duplicates), ("substring dedup", substrings), ("mixing", mixing), ("bpe", encoding)]

#: SQL expresses none of the first three stages, so the run is tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's result written to the shared folder and read again.

    What no later stage reads is removed; the input of the last one stays, since its result is still to be computed.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                discard(spark, f"{base}/{k - 1}")
    return docs
