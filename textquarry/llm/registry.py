"""Queries of the training-data operators: each applies an operator to a whole table.

All return one row a row of documents, repeated rows too, and no row of an empty table; how an operator treats
ties, very long texts and clashing columns stands in its module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, licenses, line_dedup, mixing, near_dedup, oracles, quality, quality_rules, secrets, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base finds and the Markov models' spans; null and empty texts have none."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grade of every whole text; null and empty texts are clean."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every whole text; null and empty texts have none."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, fitted without held-out rows; empty texts are scored too."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts in ascending doc_id order, read back; null text is the end id alone."""
    import public_tokenizers

    return dac.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text; null text has no words."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix; null source is a source, null text takes nothing."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document; null and empty texts are linked with nothing."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every whole text; null text has no words and fails."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("failed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines found in 10 documents or more; null text is one empty line."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_output": op5_token_output,
    "op6_decontamination": op6_decontamination,
    "op7_source_mix": op7_source_mix,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
}

#: Scores of fitted models and tokenizers are beyond SQL; tests hold those against brute force or held-out rows.
ORACLES: dict[str, str] = {
    "op6_decontamination": oracles.OP6,
    "op7_source_mix": oracles.OP7,
    "op8_near_dedup": oracles.OP8,
    "op9_quality_rules": oracles.OP9,
    "op10_line_dedup": oracles.OP10,
}
