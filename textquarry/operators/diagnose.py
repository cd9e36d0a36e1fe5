"""Extraction diagnostics: documents cut into suspiciously short blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEAN, MEDIAN, BORDER = 15.0, 10.0, 1.5


def status_of(mean: Column, median: Column, t_mean: float = MEAN, t_median: float = MEDIAN) -> Column:
    return F.when((mean < t_mean) | (median < t_median), "suspicious").when((mean < t_mean * BORDER) | (median < t_median * BORDER), "borderline").otherwise("ok")


def statistics(blocks: DataFrame, t_mean: float = MEAN, t_median: float = MEDIAN) -> DataFrame:
    """A row a document with blocks that are not empty: their number, mean and median length, and status."""
    size = F.length("text")
    rows = blocks.where(size > 0).groupBy("doc_key").agg(F.count("*").alias("blocks"), F.avg(size).alias("mean"), F.median(size).alias("median"))
    return rows.select("doc_key", "blocks", F.round("mean", 1).alias("avg_chars"), F.round("median", 1).alias("median_chars"), status_of(F.col("mean"), F.col("median"), t_mean, t_median).alias("status"))


def diagnose(blocks: DataFrame, limit: int = 50, everything: bool = False, **thresholds) -> DataFrame:
    rows = statistics(blocks, **thresholds)
    rows = rows if everything else rows.where("status != 'ok'")
    severity = F.when(F.col("status") == "suspicious", 0).when(F.col("status") == "borderline", 1).otherwise(2)
    return rows.orderBy(severity, F.desc("blocks"), "doc_key").limit(limit)


def summary(blocks: DataFrame, documents: DataFrame, **thresholds) -> DataFrame:
    """One row: documents scanned and by status; skipped are those without text."""
    counts = statistics(blocks, **thresholds).agg(F.count("*").alias("scanned"), *[F.count_if(F.col("status") == s).alias(s) for s in ("suspicious", "borderline", "ok")])
    return counts.join(documents.agg(F.count_distinct("doc_key").alias("documents"))).select("scanned", "suspicious", "borderline", "ok", (F.col("documents") - F.col("scanned")).alias("skipped"))
