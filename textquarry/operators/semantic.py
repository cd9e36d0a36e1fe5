"""Semantic search: the nearest chunks of documents, their blocks, and passages around their middles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import reflow, window
from . import vectors
from .search import RADIUS


def search(chunks: DataFrame, blocks: DataFrame, markdown: DataFrame, target: list[float], limit: int = 10, min_score: float | None = None, allowed: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """doc_key, score, block_start, block_end, char_offset, passage of the `limit` documents whose best chunk is nearest.

    chunks: doc_key, seq, pos, len, embedding. Documents without blocks are left out; min_score is applied after the
    limit. The target is a literal, so the vectors are read once; texts are joined to the hits only."""
    rows = chunks if allowed is None else chunks.join(allowed.select("doc_key").distinct(), "doc_key", "left_semi")
    rows = rows.join(blocks.select("doc_key").distinct(), "doc_key", "left_semi")
    score = F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in target])), 6)
    best = rows.select("doc_key", F.struct(score.alias("score"), (-F.col("seq")).alias("n"), "pos", "len").alias("b")).groupBy("doc_key").agg(F.max("b").alias("b"))
    hits = best.select("doc_key", "b.score", (-F.col("b.n")).alias("seq"), "b.pos", "b.len").orderBy(F.desc("score"), "doc_key").limit(limit)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    few = blocks.join(F.broadcast(hits.select("doc_key")), "doc_key", "left_semi")
    hits = hits.join(vectors.chunk_ranges(hits.select("doc_key", "seq", "pos", "len"), few), ["doc_key", "seq"])
    middle = F.col("pos") + F.floor(F.col("len") / 2)
    out = markdown.join(F.broadcast(hits), "doc_key").withColumn("char_offset", middle)
    return out.select("doc_key", "score", "block_start", "block_end", "char_offset", reflow(window(F.col("markdown"), F.col("char_offset").cast("int"), radius)).alias("passage"))
