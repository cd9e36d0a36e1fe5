"""Documents arriving as a file stream: each micro-batch replaces its documents' postings.

Beyond batch sync: the same incremental update, run by foreachBatch, so that a batch that is retried writes
the same buckets again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, index, search


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return search.tokenised(blocks.lines_as_elements(docs, key, text).withColumnRenamed("pos", "block_index"))


def apply_batch(stored: index.KeywordIndex, docs: DataFrame) -> None:
    """Documents of the batch are changed ones: old rows go, new ones come, and only their buckets are rewritten. The
    batch is tokenised once."""
    docs = docs.withColumnRenamed("doc_id", "doc_key").dropDuplicates(["doc_key"]).persist()
    try:
        stored.apply(tokenised(docs, "doc_key"), docs.select("doc_key", F.lit("changed").alias("state")))
    finally:
        docs.unpersist()


def start(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str):
    """A running query over Parquet files of documents that appear below `source`."""
    stored = index.KeywordIndex(spark, root)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: apply_batch(stored, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
