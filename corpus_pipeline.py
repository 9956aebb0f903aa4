"""The corpus pipeline: five stages over ``documents``, each written and read by the next.

Languages are recognised and what has none is rejected, near-duplicates reduced to one
of each group, documents that hold test items dropped, personal data sanitised, and the
rest packed into training windows.  All but the last return the columns of documents.

Null and empty texts, and texts without a letter, have no language and go in the first
stage.  Null doc_ids are kept and linked with nothing.  Rows that repeat a doc_id are told
apart by their text; of equal rows one stays.  Very long texts are read whole.  Ties in the
near-duplicate stage keep the smallest doc_id.  Empty tables give none.  Extra columns pass
through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bottomk_dedup, containment, disclosure, language_filters, scratch, tier_packing  # isort: skip

import public_tokenizers

#: Documents whose best language has a smaller share of the filters' votes are rejected.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what reads as one of the languages learned from the training part of ``docs``; its ``lang`` stays as given."""
    scratch.small_batches(spark)
    filters = language_filters.learn(docs.where(~language_filters.held_out(F.col("doc_id"))))
    return language_filters.recognised(docs, filters, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return bottomk_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return containment.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return disclosure.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return tier_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``: each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = scratch.written(docs, name)
    return docs
