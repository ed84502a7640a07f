"""Registered queries of this folder: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import (
    aligning, exact, jaccard, licences, mixing, order_minhash, packing, pages, quality, quoting, secret_scan, substrings,
    whitening,
)
from themeloom.llm.inputs import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substrings.strip_passages(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.replies(table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.counted(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligning.alignment(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_secret_scan, op3_exact_dedup, op4_mixing, op5_packing, op6_licence_scan,
        op7_quotation_linking, op8_quality_rules, op9_jaccard_join, op10_html_extraction,
        op11_order_minhash, op12_token_alignment, op13_whitening,
    )
}
