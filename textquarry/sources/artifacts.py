"""Extracted artifacts on a store: manifests (gzip JSON) and normalised texts, one pair a document."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"([0-9a-f]{40})"
BLOCKS = "array<struct<blockIndex:int,sectionPath:array<string>,blockType:string,text:string,pageStart:int,pageEnd:int,charStart:long,charEnd:long,lineStart:long,lineEnd:long,isReferenceLike:boolean>>"
MANIFEST = f"struct<docKey:string,itemKey:string,title:string,filePath:string,verticalText:boolean,blocks:{BLOCKS}>"


def doc_keys(spark: SparkSession, folder: str) -> DataFrame:
    """doc_key of all files whose name is a document key; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    key = F.regexp_extract("path", rf"/{KEY}\.[^/]*$", 1)
    return files.select(key.alias("doc_key")).where("doc_key <> ''").distinct()


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_key, status (ok or unreadable), manifest; never fails on a broken file. Missing ones have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text = None
                if content[:2] == b"\x1f\x8b":
                    try:
                        text = gzip.decompress(content).decode("utf-8")
                        json.loads(text)
                    except (OSError, EOFError, ValueError):
                        text = None
                rows.append((path, text))
            yield pd.DataFrame(rows, columns=["path", "json"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(folder).select("path", "content")
    raw = files.mapInPandas(run, "path string, json string")
    return raw.select(F.regexp_extract("path", rf"/{KEY}\.json\.gz$", 1).alias("doc_key"), F.when(F.col("json").isNull(), "unreadable").otherwise("ok").alias("status"), F.from_json("json", MANIFEST).alias("manifest")).where("doc_key <> ''")


def blocks_of(manifests: DataFrame) -> DataFrame:
    """Blocks of the readable manifests."""
    rows = manifests.where("status = 'ok'").select("doc_key", F.explode("manifest.blocks").alias("b"))
    b = F.col
    return rows.select("doc_key", b("b.blockIndex").alias("block_index"), b("b.blockType").alias("block_type"), b("b.sectionPath").alias("section_path"), b("b.text").alias("text"), b("b.pageStart").alias("page_start"), b("b.pageEnd").alias("page_end"), b("b.charStart").alias("char_start"), b("b.charEnd").alias("char_end"), b("b.isReferenceLike").alias("is_reference_like"))


def read_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """doc_key, markdown; an empty file counts as absent."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.input_file_name(), rf"/{KEY}\.md$", 1).alias("doc_key"), F.col("value").alias("markdown"))
    return raw.where("doc_key <> '' and markdown is not null and markdown <> ''")


def publishable(markdown: Column, n_blocks: Column) -> Column:
    """Whether an artifact may be published: it has text and blocks."""
    return (F.trim(F.coalesce(markdown, F.lit(""))) != "") & (F.coalesce(n_blocks, F.lit(0)) > 0)


def facts(attachments: DataFrame, manifests: DataFrame, normalized: DataFrame, vertical: DataFrame) -> DataFrame:
    """attachments (doc_key, item_key, file_ext) with what the reuse verdict asks for. vertical: item_key."""
    m = manifests.select("doc_key", F.lit(True).alias("manifest_exists"), (F.col("status") == "ok").alias("manifest_readable"), F.size(F.coalesce("manifest.blocks", F.array().cast(BLOCKS))).alias("n_blocks"), F.col("manifest.docKey").alias("m_doc"), F.col("manifest.itemKey").alias("m_item"), F.coalesce("manifest.verticalText", F.lit(False)).alias("m_vertical"))
    n = normalized.select("doc_key", F.lit(True).alias("normalized_exists"), (F.trim("markdown") == "").alias("normalized_empty"))
    v = vertical.select("item_key").distinct().withColumn("wants_vertical", F.lit(True))
    out = attachments.join(m, "doc_key", "left").join(n, "doc_key", "left").join(v, "item_key", "left")
    no = F.lit(False)
    wants = F.coalesce("wants_vertical", no) & (F.col("file_ext") == "pdf")
    out = out.withColumns({c: F.coalesce(c, no) for c in ("manifest_exists", "manifest_readable", "normalized_exists", "normalized_empty")})
    out = out.withColumn("identity_matches", F.coalesce((F.col("m_doc") == F.col("doc_key")) & (F.col("m_item") == F.col("item_key")), no))
    out = out.withColumn("vertical_matches", (F.col("file_ext") != "pdf") | (F.coalesce("m_vertical", no) == wants))
    return out.drop("m_doc", "m_item", "m_vertical", "wants_vertical")
