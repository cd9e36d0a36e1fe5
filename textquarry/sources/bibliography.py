"""Bibliography JSON to records and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Item types that have a journal, and those that have a publisher.
ARTICLE_TYPES = ("article", "article-journal", "article-magazine", "article-newspaper")
BOOK_TYPES = ("book", "chapter", "report", "thesis", "paper-conference")

# The fields of an exported item, and of a person.
PERSON = "struct<family:string,given:string,literal:string>"
ITEM = f"struct<id:string,title:string,abstract:string,publisher:string,type:string,author:array<{PERSON}>,editor:array<{PERSON}>,issued:struct<`date-parts`:array<array<string>>>,`container-title`:string,file:string,`zotero-item-key`:string>"
#: Where a path begins: a root, a home, a file URL, a share or a drive.
PATH_START = r"(?=\s*(?:/|~/|file://|\\\\\\\\|[A-Za-z]:[\\\\/]))"
EXTENSIONS = {"pdf": r"(?i)\.pdf$", "epub": r"(?i)\.epub$", "html": r"(?i)\.html?$", "txt": r"(?i)\.txt$"}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A row an item, from a JSON array, an object with `items`, or the first array among an object's values.
    Raises if there is no array."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    if raw.where(kind.startswith("ARRAY")).isEmpty():
        listed = raw.where(F.try_variant_get("v", "$.items", "variant").isNotNull())
        if not listed.isEmpty():
            raw = listed.select(F.variant_get("v", "$.items", "variant").alias("v"))
        else:
            parts = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(F.schema_of_variant("value").startswith("ARRAY"))
            raw = parts.orderBy("pos").limit(1).select(F.col("value").alias("v"))
            if raw.isEmpty():
                raise ValueError("the bibliography holds no array")
    text = F.explode(F.from_json(F.to_json("v"), "array<string>")).alias("j")
    return raw.select(text).select(F.from_json("j", ITEM).alias("i")).select("i.*")


def people(of: Column) -> Column:
    """struct(names, search): display names, and the texts an author is found by (both orders)."""

    def one(p: Column) -> Column:
        literal, family, given = (F.trim(F.coalesce(p[k], F.lit(""))) for k in ("literal", "family", "given"))
        display = F.when(literal != "", literal).otherwise(F.trim(F.concat_ws(" ", family, given)))
        other = F.when(literal != "", literal).otherwise(F.trim(F.concat_ws(" ", given, family)))
        return F.array(display, other)

    both = F.transform(F.coalesce(of, F.array().cast(f"array<{PERSON}>")), one)
    names = F.filter(F.array_distinct(F.transform(both, lambda x: x[0])), lambda x: x != "")
    return F.struct(names.alias("names"), F.filter(F.array_distinct(F.flatten(both)), lambda x: x != "").alias("search"))


def split_files(file: Column) -> Column:
    """Paths of a file field: cut at semicolons after which a path begins, so that names may hold some."""
    parts = F.split(F.coalesce(file, F.lit("")), ";" + PATH_START)
    return F.filter(F.transform(parts, lambda p: normal_path(p)), lambda p: p != "")


def normal_path(p: Column) -> Column:
    p = F.regexp_replace(F.trim(p), r"^file://(?:localhost)?", "")
    p = F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "(?<!^)/{2,}", "/")
    return F.regexp_replace(p, "^/private/", "/")


def relative_path(p: Column, root: str, tail: str | None = None) -> Column:
    """Path below the root, or what follows the last `tail` segment of a foreign path; null if neither, or if a
    segment is . or .."""
    base = root.rstrip("/") + "/"
    below = F.when(p.startswith(base), F.substring(p, len(base) + 1, 100_000))
    if tail:
        below = F.coalesce(below, F.nullif(F.regexp_extract(p, f"^.*/\\Q{tail}\\E/(.+)$", 1), F.lit("")))
    dots = F.exists(F.split(below, "/"), lambda s: s.isin(".", ".."))
    return F.when(~dots, below)


def file_type(p: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in EXTENSIONS.items():
        out = F.when(p.rlike(pattern), kind).otherwise(out)
    return out


def records(items: DataFrame) -> DataFrame:
    """Normalised records; items without a key go, a title falls back to the key, editors to authors."""
    rows = items.withColumn("item_key", F.trim("`zotero-item-key`")).where("item_key <> ''")
    by = F.when(F.size(people(F.col("author"))["names"]) > 0, people(F.col("author"))).otherwise(people(F.col("editor")))
    rows = rows.withColumn("by", by)
    title = F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    return rows.select(
        "item_key",
        F.col("id").alias("citation_key"),
        F.coalesce(title, "item_key").alias("title"),
        F.col("by.names").alias("authors"),
        F.col("by.search").alias("author_search_texts"),
        F.get(F.get(F.col("issued.`date-parts`"), F.lit(0)), F.lit(0)).alias("year"),
        "abstract",
        F.when(F.col("type").isin(*ARTICLE_TYPES), F.col("`container-title`")).alias("journal"),
        F.when(F.col("type").isin(*BOOK_TYPES), F.col("publisher")).alias("publisher"),
        "type",
        split_files(F.col("file")).alias("attachment_paths"),
    )


def attachments(rows: DataFrame, root: str, tail: str | None = None) -> DataFrame:
    """A row a file below the root, the first of each item and path; doc_key is the path's SHA-1."""
    each = rows.select("item_key", "citation_key", "title", "authors", "year", "abstract", "type", F.posexplode("attachment_paths").alias("pos", "path"))
    each = each.withColumn("file_path", relative_path(F.col("path"), root, tail)).where("file_path is not null")
    turn = F.row_number().over(Window.partitionBy("item_key", "file_path").orderBy("pos"))
    kind = file_type(F.col("file_path"))
    each = each.withColumn("turn", turn).where("turn = 1").drop("turn", "pos", "path")
    return each.select(F.sha1(F.col("file_path").cast("binary")).alias("doc_key"), "*", kind.alias("file_ext"), (kind != "other").alias("supported"))


def shared_doc_keys(files: DataFrame) -> DataFrame:
    """doc_key, n: files that several items name; of these the last item's entry is the one kept."""
    return files.groupBy("doc_key").agg(F.count_distinct("item_key").alias("n")).where("n > 1")
