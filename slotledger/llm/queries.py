"""Queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm import (
    byte_bpe,
    collocations,
    filter_audit,
    licenses,
    mixing,
    ngram_join,
    oracles,
    pii,
    quality_model,
    quality_rules,
    substring_dedup,
    token_files,
    vector_dedup,
    vector_search,
)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(_read(spark, sf_dir, "documents")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("path_length"),
    )


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality_model.score_documents(docs, labels)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return token_files.written_and_read(_read(spark, sf_dir, "documents"), tokenizer)


def byte_tokenizer() -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"), byte_tokenizer())


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_groups(_read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = (
        op1_pii,
        op2_ngram_jaccard,
        op3_substring_dedup,
        op4_quality_rules,
        op5_vector_search,
        op6_mixing,
        op7_license_scan,
        op8_quality_model,
        op9_token_files,
        op10_byte_bpe,
        op11_vector_dedup,
        op12_collocations,
        op13_filter_audit,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
