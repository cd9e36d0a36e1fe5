"""Scans spread over the cores there are."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A scan gets at most one partition for so many bytes of its files.
LEAST_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of few, unsplittable files (one row group each) dealt out to the default parallelism; a scan that
    has as many partitions already, as any large table does, is left as it is."""
    context = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(context.defaultParallelism, size // LEAST_BYTES)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df
