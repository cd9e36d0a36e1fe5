"""Column expressions over word windows, shared by the native operators; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, i: Column, width: int) -> Column:
    """Hash of the window of `width` words that begins at word i (from 0)."""
    return F.xxhash64(F.slice(hashes, i + 1, width))


def begins(n: Column, width: int) -> Column:
    """0 .. n - width; empty if the text is shorter."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def covered(spans: Column) -> Column:
    """Number of places in a union of [begin, end) intervals, given as structs sorted by begin."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["end"])  # so a span within an earlier one adds nothing
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], s["begin"])).alias("total"))

    return F.aggregate(spans, zero, step, lambda acc: acc["total"])
