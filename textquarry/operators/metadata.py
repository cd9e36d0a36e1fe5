"""Metadata search over a bibliography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_only

#: Searched fields in their order, and what a match in each counts.
WEIGHTS = {"title": 6, "author": 5, "journal": 4, "publisher": 4, "abstract": 3, "year": 1}


def holds(field: str, needle: str) -> Column:
    """Whether the normalised field has the normalised needle; authors match by any of their search texts."""
    if field == "author":
        return F.coalesce(F.exists("author_search_texts", lambda a: words_only(a).contains(needle)), F.lit(False))
    return F.coalesce(words_only(F.col(field)).contains(needle), F.lit(False))


def search_metadata(records: DataFrame, text: str = "", fields: list[str] | None = None, filters: dict[str, str] | None = None, has_file: bool = False, allowed: DataFrame | None = None, limit: int | None = 20, normalise=lambda s: " ".join(s.lower().split())) -> DataFrame:
    """item_key, title, matched_fields, score: records that satisfy all filters, and hold the text in any of the
    fields. The best `limit`, then those with files, then by title and key;
    without a limit all, in no order."""
    chosen = [f for f in WEIGHTS if fields is None or f in fields]
    rows = records if allowed is None else records.join(allowed.select("item_key").distinct(), "item_key", "left_semi")
    if has_file:
        rows = rows.where("has_supported_file")
    wanted = {f: normalise(v) for f, v in (filters or {}).items() if v}
    if wanted:
        rows = rows.where(reduce(lambda a, b: a & b, [holds(f, v) for f, v in wanted.items()]))
    needle = normalise(text)
    found = [F.when(F.lit(f in wanted) | (holds(f, needle) if needle and f in chosen else F.lit(False)), F.lit(f)) for f in WEIGHTS]
    if needle:
        rows = rows.where(reduce(lambda a, b: a | b, [holds(f, needle) for f in chosen]))
    rows = rows.withColumn("matched_fields", F.array_compact(F.array(*found)))
    score = reduce(lambda a, b: a + b, [F.when(F.array_contains("matched_fields", f), w).otherwise(0) for f, w in WEIGHTS.items()])
    rows = rows.withColumn("score", score.cast("long"))
    if limit is not None:
        rows = rows.orderBy(F.desc("score"), F.desc("has_supported_file"), F.collate("title", "UNICODE"), "item_key").limit(limit)
    return rows.select("item_key", "title", "has_supported_file", F.array_join("matched_fields", ",").alias("matched_fields"), "score")
