"""Plan helpers without any of Python's data libraries, so that workers that import them stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that later filters and projections read but never evaluate again: a generator of
    one row stands between, through which the optimizer neither pushes nor inlines."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Long texts make an Arrow batch of Spark's usual 10,000 rows too large for a small executor.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after the session's two limits of Arrow batches were lowered where they are above."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df
