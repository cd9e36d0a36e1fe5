"""Vector search by exact cosine, chunk-to-block ranges, and upkeep of the vector tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns texts into vectors; models are outside this package."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, key: str, vector: str, target: list[float], k: int = 10, min_score: float | None = None) -> DataFrame:
    """key, score of the k nearest; the target is a literal, so the table is read once and nothing is joined."""
    rows = vectors.select(F.col(key), F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in target])), 6).alias("score"))
    rows = rows if min_score is None else rows.where(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), key).limit(k)


#: Targets compared in one pass over the vectors.
TARGETS = 4_096


def top_k_batch(vectors: DataFrame, key: str, vector: str, targets: DataFrame, k: int = 10, block: int = TARGETS) -> DataFrame:
    """query_id, key, score, rank of the k nearest of each target. targets: query_id, target. They are sent around in
    blocks of bounded size; every task keeps k a target and Arrow batch, so only those are shuffled. Exact."""
    spark, parts = vectors.sparkSession, []
    numbered = targets.select("query_id", F.col("target").cast("array<double>").alias("target")).orderBy("query_id")
    asked = numbered.toLocalIterator()
    while rows := list(itertools.islice(asked, block)):
        matrix = np.array([r.target for r in rows])
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))
        parts.append(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_nearest(sent, k), f"query_id {targets.schema['query_id'].dataType.simpleString()}, key {vectors.schema[key].dataType.simpleString()}, score double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {targets.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double, rank int")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def _nearest(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, targets = sent.value
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            if not batch.num_rows:
                continue
            rows = np.array(lists.to_pylist())
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round(rows @ targets.T / np.linalg.norm(rows, axis=1, keepdims=True), 6)
            names_order = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            at, of = [], []
            for j in range(len(names)):
                best = np.lexsort((names_order, -scores[:, j]))[:k]
                at.append(best)
                of += [j] * len(best)
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in of]), keys.take(pa.array(at)), pa.array(scores[at, of])], ["query_id", "key", "score"])

    return run


def distinct_segments(vectors: DataFrame, *by: str) -> DataFrame:
    """How many (hash, seq) stand in each group."""
    return vectors.groupBy(*by).agg(F.count_distinct("hash", "seq").alias("segments"))


#: Characters of a bin of positions.
BIN = 2_000


def _bins(first: Column, last: Column) -> Column:
    """Bins of the positions first to last, both inclusive."""
    return F.sequence(F.floor(first / BIN), F.floor(F.greatest(first, last) / BIN))


def chunk_ranges(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_key, seq, block_start, block_end: the blocks a chunk [pos, pos + max(1, len)) overlaps; else the nearest
    (of equal ones the first). Chunks meet blocks in bins of positions, so a document's product is never formed; what
    meets none is placed between its neighbours in the order of positions. Chunks of documents without blocks go."""
    b = blocks.select("doc_key", "block_index", "char_start", "char_end")
    c = chunks.select("doc_key", "seq", "pos", (F.col("pos") + F.greatest(F.lit(1), F.col("len"))).alias("stop"))
    left = c.withColumn("bin", F.explode(_bins(F.col("pos"), F.col("stop") - 1)))
    right = b.withColumn("bin", F.explode(_bins(F.col("char_start"), F.col("char_end") - 1)))
    meets = left.join(right, ["doc_key", "bin"]).where("char_start < stop and pos < char_end")
    found = meets.groupBy("doc_key", "seq").agg(F.min("block_index").alias("block_start"), F.max("block_index").alias("block_end"))
    alone = c.join(found, ["doc_key", "seq"], "left_anti").select("doc_key", "seq", "pos", F.lit(None).cast("struct<b:int,s:bigint,e:bigint>").alias("block"))
    marks = b.select("doc_key", F.lit(None).cast(c.schema["seq"].dataType).alias("seq"), F.col("char_start").alias("pos"), F.struct(F.col("block_index").cast("int").alias("b"), F.col("char_start").cast("long").alias("s"), F.col("char_end").cast("long").alias("e")).alias("block"))
    line = Window.partitionBy("doc_key").orderBy("pos", F.col("block").isNull(), "block.b")
    before = F.last("block", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("block", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    lonely = alone.select("doc_key").distinct()
    placed = alone.unionByName(marks.join(lonely, "doc_key", "left_semi")).withColumn("x", before).withColumn("y", after).where("seq is not null")
    away = lambda x: F.greatest(x["s"] - F.col("pos"), F.col("pos") - x["e"], F.lit(0))
    near = F.array_min(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(away(F.col(n)).alias("d"), F.col(n)["b"].alias("b"))) for n in ("x", "y")])))
    placed = placed.select("doc_key", "seq", near["b"].alias("block_start"), near["b"].alias("block_end")).where("block_start is not null")
    return found.unionByName(placed)


def migrate_alias(vectors: DataFrame, legacy: str, current: str) -> DataFrame:
    """Rows of the legacy model go where (hash, seq) also stands under the current one; the rest are renamed."""
    have = vectors.where(F.col("model") == current).select("hash", "seq")
    old = vectors.where(F.col("model") == legacy).join(have, ["hash", "seq"], "left_anti").withColumn("model", F.lit(current))
    return vectors.where(F.col("model") != legacy).unionByName(old.select(vectors.columns))


def without_orphans(documents: DataFrame, content: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops inactive documents, then content no document has, then vectors of no content."""
    docs = documents.where("active")
    kept = content.join(docs.select("hash").distinct(), "hash", "left_semi")
    return docs, kept, vectors.join(kept.select("hash").distinct(), "hash", "left_semi")
