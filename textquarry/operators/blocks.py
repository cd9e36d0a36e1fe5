"""The block model: elements or markdown to positioned blocks, and several attachments to one item.

blocks: doc_key, block_index (dense, from 0), block_type, section_path, heading_level, text, snippet,
char_start, char_end, line_start, line_end, page_start, page_end, is_reference_like. `text` is the raw text,
offsets (code points) cover the rendered snippet; snippets stand two characters and two lines apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heuristics import reference_like
from ..functions.text import clean_text, once

GAP = 2


def render(block_type: Column, level: Column, text: Column) -> Column:
    """Heading marks, list marks, or the text as it is."""
    heading = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.coalesce(level, F.lit(1))).cast("int")), F.lit(" "), text)
    return F.when(block_type == "heading", heading).when(block_type == "list item", F.concat(F.lit("- "), text)).otherwise(text)


def element_kind(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.contains("heading"), "heading").when(low.contains("list"), "list item").otherwise(kind)


def clamp_level(level: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(level, F.lit(1)))).cast("int")


def lines_as_elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_key, pos, block_type, heading_level, text: every line a paragraph; a null text has none, an empty one an empty line."""
    lines = F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")
    return docs.select(F.col(key).alias("doc_key"), lines).select("doc_key", "pos", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("heading_level"), "text")


def markdown_elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same from markdown: # lines are headings, blank lines end paragraphs, other lines join by newline.

    Paragraphs are islands: their number is the running count of breaks before a line."""
    lines = docs.select(F.col(key).alias("doc_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    blank = F.trim("line") == ""
    ordered = Window.partitionBy("doc_key").orderBy("pos")
    lines = lines.withColumn("level", level).withColumn("blank", blank)
    starts = (F.col("level") > 0) | F.col("blank") | (F.coalesce(F.lag("level").over(ordered), F.lit(0)) > 0)
    lines = lines.withColumn("part", F.sum(starts.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    parts = lines.groupBy("doc_key", "part").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    head = F.trim(F.regexp_replace(joined, r"^#{1,6}\s+", ""))
    is_head = F.col("level") > 0
    return parts.select("doc_key", "pos", F.when(is_head, "heading").otherwise("paragraph").alias("block_type"), F.when(is_head, F.col("level")).cast("int").alias("heading_level"), F.when(is_head, head).otherwise(F.trim(joined)).alias("text"))


def section_paths(elements: DataFrame) -> DataFrame:
    """elements with section_path: the headings above, by level. A heading of level L drops deeper ones; levels
    that were skipped stay as nulls."""
    upto = Window.partitionBy("doc_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("heading_level")
    out, parts = elements, []
    for k in range(1, 7):
        here = F.when(level == k, F.struct("pos", "text"))
        cut = F.max(F.when(level < k, F.col("pos"))).over(upto)
        last = F.last(here, ignorenulls=True).over(upto)
        out = out.withColumn(f"__h{k}", F.when(cut.isNull() | (last["pos"] > cut), last["text"]))
        parts.append(F.col(f"__h{k}"))
    depth = F.greatest(*[F.when(p.isNotNull(), k + 1).otherwise(0) for k, p in enumerate(parts)])
    return out.withColumn("section_path", F.slice(F.array(*parts), F.lit(1), depth)).drop(*[f"__h{k}" for k in range(1, 7)])


def annotate(elements: DataFrame, paths: bool = True, places: bool = False) -> DataFrame:
    """Numbers and places the blocks; those whose snippet is blank go before they are numbered. places: keeps pos."""
    rows = section_paths(elements) if paths else elements.withColumn("section_path", F.array().cast("array<string>"))
    clean = once(rows, __clean=clean_text(F.col("text"))).where(F.col("__clean") != "")
    # A mark before a clean text leaves it clean. Snippets that equal their text, the most, are not moved beside it.
    clean = once(clean, snippet=render(F.col("block_type"), F.col("heading_level"), F.col("__clean")))
    size = F.length("snippet")
    rows = clean.select(*rows.columns, F.when(F.col("snippet") != F.col("text"), F.col("snippet")).alias("__own"), size.alias("__size"), (size - F.length(F.replace("snippet", F.lit("\n"), F.lit("")))).alias("__newlines"))
    order = Window.partitionBy("doc_key").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block_index", F.row_number().over(order) - 1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.col("__size") + GAP).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("line_start", (1 + F.coalesce(F.sum(F.col("__newlines") + GAP).over(before), F.lit(0))).cast("long"))
    rows = rows.withColumn("snippet", F.coalesce("__own", "text"))
    rows = rows.withColumn("char_end", F.col("char_start") + F.col("__size")).withColumn("line_end", F.col("line_start") + F.col("__newlines")).drop("__own", "__size", "__newlines")
    rows = rows.withColumn("is_reference_like", reference_like(F.col("text"), F.col("section_path")))
    return rows if places else rows.drop("pos")


def manifests(markdown: DataFrame, elements: DataFrame) -> DataFrame:
    """Blocks from extracted elements where there are any, else from the markdown (doc_key, markdown)."""
    rest = markdown.join(elements.select("doc_key").distinct(), "doc_key", "left_anti")
    columns = ["doc_key", "pos", "block_type", "heading_level", "text"]
    return annotate(elements.select(columns).unionByName(markdown_elements(rest, "doc_key", "markdown")))


def merge_items(blocks: DataFrame, attachments: DataFrame) -> DataFrame:
    """One document an item: its attachments' blocks in file order, a heading before the second and later ones,
    all re-based. attachments: doc_key, item_key, file_path. Adds item_key, source_doc_key, source_block_index."""
    a = attachments.select("doc_key", "item_key", "file_path")
    nth = F.row_number().over(Window.partitionBy("item_key").orderBy(F.collate("file_path", "UNICODE"), "doc_key"))
    with_blocks = a.join(blocks.select("doc_key").distinct(), "doc_key", "left_semi").withColumn("nth", nth)
    title = F.concat(F.lit("Attachment: "), F.substring_index("file_path", "/", -1))
    marks = with_blocks.where("nth > 1").select("item_key", "doc_key", "nth", F.lit(-1).alias("block_index"), F.lit("heading").alias("block_type"), F.lit(1).alias("heading_level"), title.alias("text"), F.concat(F.lit("# "), title).alias("snippet"))
    rows = blocks.join(with_blocks, "doc_key").select("item_key", "doc_key", "nth", "block_index", "block_type", "heading_level", "text", "snippet").unionByName(marks)
    order = Window.partitionBy("item_key").orderBy("nth", "block_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("index", F.row_number().over(order) - 1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.length("snippet") + GAP).over(before), F.lit(0)).cast("long"))
    return rows.select("item_key", F.col("doc_key").alias("source_doc_key"), F.when(F.col("block_index") >= 0, F.col("block_index")).alias("source_block_index"), F.col("index").alias("block_index"), "block_type", "heading_level", "text", "snippet", "char_start", (F.col("char_start") + F.length("snippet")).alias("char_end"))


def rendered(blocks: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, markdown: a document's snippets in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "snippet")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["snippet"]), "\n\n").alias("markdown"))
