"""Quality rules (operator 9, native): adaptive limits from mergeable quantile sketches.

Measures of a text become counts in logarithmic buckets (ratio GAMMA, so a quantile is off by 2.5 % at
most), one sketch for each language, source and measure. Sketches merge by adding counts, so partial
ones meet in the shuffle's map side. A limit is the upper quartile plus FENCE interquartile ranges or the
measure's slack, whichever is more. A group's limit is the mean of its own and the whole table's, weighted
by its documents and by PRIOR_DOCS, so that it moves from one to the other smoothly as the group grows;
texts above any limit go, after a join on language and source.

Null and empty texts have no words and fail the base rules, which are fixed. Null language or source is a group of
its own. Long texts are read whole. Repeated rows are judged alike, each counts in the sketches and each is returned;
a value equal to its limit is kept. An empty table gives no rows. Columns other than doc_id, text, lang and source
are not read, whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, UPPER, materialize
from .windows import begins, covered, window_hash, word_hashes

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WIDTH = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

GAMMA = 1.05
FENCE = 3.0
#: The whole table's limit weighs as much in a group's as so many documents of the group.
PRIOR_DOCS = 50
#: Measures, and how far above the upper quartile a limit lies at least.
SLACK = {"symbol_share": 0.05, "capital_share": 0.25, "repeat_share": 0.28, "dup_line_share": 0.5, "word_length": 6.0}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base figures and the measures, in one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"))
    d = d.select("*", F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(SPACE_WORD))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").alias("n"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).alias("n_capitals"),
        lines.alias("lines"),
        word_hashes(F.col("words")).alias("hashes"),
    )
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "n",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(begins(F.col("n"), WIDTH), lambda i: window_hash(F.col("hashes"), i, WIDTH)).alias("windows"),
    )
    # Most texts repeat no window; only the others are sorted.
    pairs = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("pairs", pairs).drop("windows")
    same = lambda a, b: F.get("pairs", a)["h"] == F.get("pairs", b)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda k: F.get("pairs", k)["i"]))
    d = d.withColumn("at", F.when(F.col("pairs").isNotNull(), at)).drop("pairs")
    spans = F.transform("at", lambda i: F.struct(i.alias("begin"), (i + WIDTH).alias("end")))
    d = d.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered(spans)).otherwise(0).cast("long")).drop("at")
    n, chars = F.greatest("n", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_capitals") / chars).alias("capital_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("word_chars") / n).alias("word_length"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable counts; bucket null holds the zeros."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SLACK]))
    rows = measured.select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.value")
    bucket = F.when(F.col("value") > 0, F.ceil(F.ln("value") / log(GAMMA)).cast("int"))
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, by: list[str], fence: float = FENCE) -> DataFrame:
    """The columns `by`, measure, limit, docs."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0))
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    placed = merged.select(*by, "measure", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("docs"))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("value")))
    out = placed.groupBy(*by, "measure").agg(quantile(0.25).alias("low"), quantile(0.75).alias("high"), F.max("docs").alias("docs"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("measure"))
    return out.select(*by, "measure", (F.col("high") + F.greatest(fence * (F.col("high") - F.col("low")), slack)).alias("limit"), "docs")


def group_limits(sketch: DataFrame, prior_docs: int = PRIOR_DOCS, fence: float = FENCE) -> DataFrame:
    """lang, source, measure, limit, docs: the limits of groups, drawn to those of the whole table."""
    whole = limits(sketch, [], fence).select("measure", F.col("limit").alias("whole_limit"))
    own = limits(sketch, ["lang", "source"], fence).join(F.broadcast(whole), "measure")  # a row a measure
    limit = (F.col("docs") * F.col("limit") + prior_docs * F.col("whole_limit")) / (F.col("docs") + prior_docs)
    return own.select("lang", "source", "measure", limit.alias("limit"), "docs")


def apply_rules(docs: DataFrame, prior_docs: int = PRIOR_DOCS, fence: float = FENCE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, failed (measures above their limits, comma-joined)."""
    measured = materialize(measure(docs), "measures")
    sketch = materialize(sketches(measured), "sketches")
    table = group_limits(sketch, prior_docs, fence)
    table = table.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"max_{m}") for m in SLACK])
    table = table.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    out = measured.join(table, measured["lang"].eqNullSafe(table["t_lang"]) & measured["source"].eqNullSafe(table["t_source"]), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in SLACK]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("failed", failed)
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed", ",").alias("failed"))
