"""Queries and SQL of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, near_dup, packing, pii, quality, suffix_dedup, tokens, url_filter, warc
from .common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_substrings(docs, keep_bytes=False, words=suffix_dedup.WORDS).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "distance"
    )


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(read(spark, sf_dir, "pages"), min_revisit_bytes=0, payload=False)
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "refers_to")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, vocabulary("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_pii_spans": op4_pii_spans,
        "op5_warc_transactions": op5_warc_transactions,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_url_filters": op8_url_filters,
        "op9_token_counts": op9_token_counts,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op5_warc_transactions": warc.SQL, "op7_benchmark_decontamination": decontam.SQL, "op8_url_filters": url_filter.SQL}
