"""Artifacts in versioned buckets: pairs of blocks and markdown are published, moved and swept together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.artifacts import publishable
from .index import BucketStore

BLOCK_COLUMNS = "doc_key string, item_key string, vertical boolean, markdown string, blocks array<struct<block_index:int,block_type:string,heading_level:int,text:string,snippet:string,char_start:bigint,char_end:bigint>>"


class ArtifactStore:
    """One row a document: its markdown and its blocks, so that a pair is never half there. Rows go through the
    store's single pointer: a run's new pairs, moves and removals appear at once or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, BucketStore(spark, root, ("doc_key",))

    def rows(self) -> DataFrame:
        found = self.store.read()
        return self.spark.createDataFrame([], BLOCK_COLUMNS) if found is None else found

    def blocks(self) -> DataFrame:
        return self.rows().select("doc_key", F.inline("blocks"))

    def normalized(self) -> DataFrame:
        return self.rows().select("doc_key", "markdown")

    @staticmethod
    def pairs(blocks: DataFrame, markdown: DataFrame, items: DataFrame) -> DataFrame:
        """Rows from annotated blocks, texts (doc_key, markdown) and items (doc_key, item_key, vertical)."""
        each = F.array_sort(F.collect_list(F.struct("block_index", "block_type", "heading_level", "text", "snippet", "char_start", "char_end")))
        made = blocks.groupBy("doc_key").agg(each.alias("blocks"))
        out = items.join(markdown, "doc_key").join(made, "doc_key", "left")
        return out.select("doc_key", "item_key", "vertical", "markdown", F.col("blocks").cast("array<struct<block_index:int,block_type:string,heading_level:int,text:string,snippet:string,char_start:bigint,char_end:bigint>>").alias("blocks"))

    def apply(self, fresh: DataFrame, moves: DataFrame, sweep: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Publishes fresh pairs, moves others (old_key, new_key) and removes swept ones (doc_key). Pairs without text
        or blocks are refused and what they would replace stays. Returns published (doc_key) and refused (doc_key,
        error)."""
        good = publishable(F.col("markdown"), F.when(F.col("blocks").isNotNull(), F.size("blocks")))
        fresh = fresh.withColumn("good", good).persist()
        moved = self.rows().join(moves.withColumnRenamed("old_key", "doc_key"), "doc_key").withColumn("doc_key", F.col("new_key")).drop("new_key")
        new = fresh.where("good").drop("good")
        new = new.unionByName(moved.join(new.select("doc_key"), "doc_key", "left_anti"))
        gone = sweep.select("doc_key").unionByName(moves.select(F.col("old_key").alias("doc_key"))).distinct().join(new.select("doc_key"), "doc_key", "left_anti")
        changes = new.select("doc_key", F.lit("changed").alias("state")).unionByName(gone.withColumn("state", F.lit("removed")))
        changes = changes.persist()
        if not changes.isEmpty():
            self.store.update(new, changes)
        return fresh.where("good").select("doc_key"), fresh.where("not good").select("doc_key", F.lit("no text or no blocks").alias("error"))
