"""Reading documents back: pages of blocks, full text, cleaned full text, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heuristics import boilerplate_like, contents_like
from ..functions.text import clean_text, compact, once
from .blocks import rendered


def page(blocks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return blocks.where((F.col("block_index") >= offset) & (F.col("block_index") < offset + limit))


def fulltext(blocks: DataFrame, normalized: DataFrame | None = None) -> DataFrame:
    """doc_key, markdown, origin: the stored text where it is there and not empty, else the rendered blocks."""
    made = rendered(blocks)
    if normalized is None:
        return made.withColumn("origin", F.lit("blocks"))
    stored = normalized.select("doc_key", F.nullif(F.col("markdown"), F.lit("")).alias("stored"))
    out = made.join(stored, "doc_key", "left")
    return out.select("doc_key", F.coalesce("stored", "markdown").alias("markdown"), F.when(F.col("stored").isNotNull(), "stored").otherwise("blocks").alias("origin"))


def item_text(texts: DataFrame, files: DataFrame) -> DataFrame:
    """item_key, markdown, origin: the texts of an item's attachments in file order, from the second on below a heading
    with the file's name. texts: doc_key, markdown, origin; files: doc_key, item_key, file_path."""
    turn = F.row_number().over(Window.partitionBy("item_key").orderBy(F.collate("file_path", "UNICODE"), "doc_key"))
    rows = texts.join(files.select("doc_key", "item_key", "file_path"), "doc_key").withColumn("turn", turn)
    headed = F.when(F.col("turn") > 1, F.concat(F.lit("# Attachment: "), F.substring_index("file_path", "/", -1), F.lit("\n\n"), F.col("markdown"))).otherwise(F.col("markdown"))
    each = F.array_sort(F.collect_list(F.struct("turn", headed.alias("text"))))
    return rows.groupBy("item_key").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n\n").alias("markdown"), F.when(F.min("origin") == F.max("origin"), F.min("origin")).otherwise("mixed").alias("origin"))


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with drop: boilerplate, duplicate (same type and text as an earlier block, headings exempt) or null.
    Lines of a table of contents count as boilerplate only near the start: max(8, min(30, 15 % of the blocks))."""
    whole = Window.partitionBy("doc_key")
    early = F.greatest(F.lit(8), F.least(F.lit(30), F.ceil(F.count("*").over(whole) * 0.15)))
    placed = blocks.withColumn("early", F.col("block_index") < early)
    noise = boilerplate_like(F.col("text")) | (F.col("early") & contents_like(F.col("text")))
    rows = once(placed, noise=F.coalesce(noise, F.lit(False)))
    exempt = F.when(F.col("noise"), F.concat(F.lit("noise "), F.col("block_index"))).when(F.col("block_type") == "heading", F.concat(F.lit("heading "), F.col("block_index")))
    rows = once(rows, key=F.coalesce(exempt, F.md5(F.concat_ws("\u0001", "block_type", F.lower(compact(clean_text(F.col("text"))))).cast("binary"))))
    turn = F.row_number().over(Window.partitionBy("doc_key", "key").orderBy("block_index"))
    return rows.withColumn("turn", turn).withColumn("drop", F.when(F.col("noise"), "boilerplate").when(F.col("turn") > 1, "duplicate")).drop("key", "turn", "noise", "early")


def clean_fulltext(blocks: DataFrame) -> DataFrame:
    """doc_key, markdown of the kept blocks, and counters."""
    rows = clean_blocks(blocks)
    kept = F.array_sort(F.collect_list(F.when(F.col("drop").isNull(), F.struct("block_index", "snippet"))))
    return rows.groupBy("doc_key").agg(
        F.array_join(F.transform(kept, lambda x: x["snippet"]), "\n\n").alias("markdown"),
        F.count("*").alias("total"),
        F.count_if(F.col("drop").isNull()).alias("kept"),
        F.count_if(F.col("drop") == "boilerplate").alias("boilerplate"),
        F.count_if(F.col("drop") == "duplicate").alias("duplicate"),
    )


def expand(markdown: DataFrame, blocks: DataFrame, offset: int, radius: int = 1000) -> DataFrame:
    """doc_key, begin, end, slice, first_block, last_block: what lies around an offset, and the blocks it touches;
    first_page and last_page where the blocks have pages."""
    size = F.length("markdown")
    center = F.least(size, F.greatest(F.lit(0), F.lit(offset)))
    cut = markdown.withColumn("begin", F.greatest(F.lit(0), center - radius)).withColumn("end", F.least(size, center + radius))
    cut = cut.select("doc_key", "begin", "end", F.substring("markdown", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("slice"))
    pages = [c for c in ("page_start", "page_end") if c in blocks.columns]
    touched = blocks.select("doc_key", "block_index", "char_start", "char_end", *pages).join(cut.select("doc_key", "begin", "end"), "doc_key").where("char_start < end and begin < char_end")
    bounds = [F.min("page_start").alias("first_page")] * ("page_start" in pages) + [F.max("page_end").alias("last_page")] * ("page_end" in pages)
    ends = touched.groupBy("doc_key").agg(F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"), *bounds)
    return cut.join(ends, "doc_key", "left")
