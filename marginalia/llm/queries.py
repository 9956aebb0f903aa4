"""The registered queries of the training-data operators (one thin query each)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bottomk_dedup, containment, disclosure, filter_audit, hidden_markov, host_reputation, huffman_files, language_filters, merge_counts, merkle_manifest, quality_model, tier_packing, vantage_search
from marginalia.llm.oracles import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, lengths = huffman_files.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return huffman_files.read_blocks(blocks, lengths)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(table(spark, sf_dir, "documents"))


def op5_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.judged(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.scored(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = language_filters.held_out(F.col("doc_id"))
    found = language_filters.predict(documents, language_filters.learn(documents.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: a page is a view of the document numbered in its URL path; low quality or toxic is bad."""
    number = F.try_to_number(F.regexp_extract(host_reputation.path_of(F.col("url")), r"/(\d{1,18})(?!\d)", 1), F.lit("9" * 18)).cast("long")
    views = pages.select("page_id", number.alias("doc_id"))
    return views.join(labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")), "doc_id").select("page_id", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return host_reputation.judged(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_search.neighbours(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_token_files, op2_near_duplicates, op3_contained_items, op4_disclosure, op5_tier_packing, op6_quality, op7_hidden_markov, op8_token_counts, op9_language, op10_url_filter,
    op11_filter_audit, op12_neighbours, op13_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
