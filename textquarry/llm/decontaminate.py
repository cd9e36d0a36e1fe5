"""Benchmark decontamination (operator 6, native): a broadcast set of the benchmark's word windows.

Items and documents are reduced to words (A-Z lowered). The windows of all items become (1) a bit set over
their hashes, which every window of every document is tested against where its text is read; a set covers
PASS_WINDOWS windows, and of more, dealt by hash, there are several, each with a pass over the texts; and (2) a
table of the windows' words, which the few windows that pass are joined with by hash and then compared word by
word. That table is broadcast up to MAX_BROADCAST windows; beyond it the join shuffles, but only windows that passed.

Null text has no words, an empty one neither, and an item without words has no window; without items no document
is hit, and an empty table of documents gives no rows. Equal windows of several items count for each of them.
Rows go by id and a 64-bit hash of the text: equal rows have equal hits, and each is returned. Long texts are read whole. Columns other than doc_id, text and item_id are not read; remove_leaks
keeps them all, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import once
from .common import ITEM_WORD, few, lower_ascii, materialize
from .windows import begins, covered, window_hash, word_hashes

WIDTH = 8
MIN_ITEMS = 2
MAX_BROADCAST = 200_000
BITS_EACH = 16
#: Windows of one bit set, which stands in the plan as a literal of at most 2 MB.
PASS_WINDOWS = 1_000_000
#: Hit documents and spans up to which both are broadcast to the texts they are removed from.
BROADCAST_HITS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """win (words joined by a space), len, hash, items (sorted texts of the ids)."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    w = w.withColumn("hashes", word_hashes(F.col("words"))).withColumn("len", F.least("n", F.lit(width)))
    w = w.select("item_id", "len", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("i"), "words", "hashes")
    w = w.select("item_id", "len", F.array_join(F.slice("words", F.col("i") + 1, F.col("len")), " ").alias("win"), F.xxhash64(F.slice("hashes", F.col("i") + 1, F.col("len"))).alias("hash"))
    return w.groupBy("win", "len", "hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def bit_set(windows: DataFrame, count: int, bits_each: int = BITS_EACH) -> np.ndarray:
    """64-bit words of a set of hashes, each at two places; the set's size is a power of two, so places are bits of the
    hash. The words are put together on the executors."""
    bits = 1 << max(10, (bits_each * count - 1).bit_length())
    place = F.col("place")
    windows = windows.select(F.explode(F.array(*places(F.col("hash"), bits))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = windows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return words


def places(hash_: Column, bits: int) -> list[Column]:
    """A hash's two places in a set of so many bits."""
    return [hash_.bitwiseAND(F.lit(bits - 1)), F.shiftright(hash_, 20).bitwiseAND(F.lit(bits - 1))]


def deal(hash_: Column, passes: int) -> Column:
    """The pass of a window: of high bits, as the low ones are its place in the bit set."""
    return F.pmod(F.shiftright(hash_, 40), F.lit(passes))


def find_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """doc_id, text_key (hash of the text), n_words, n_hit, items (sorted ids of items with occurring windows), spans
    (hit intervals of word places); one row a row of docs."""
    windows = materialize(item_windows(items, width), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    count = windows.count()
    passes = max(1, -(-count // pass_windows))
    keys = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    d = docs.select(*keys, words_of(F.col("text")).alias("words"))
    d = d.select("doc_id", "text_key", F.size("words").alias("n"), "words", word_hashes(F.col("words")).alias("hashes"))
    tables = []
    for turn in range(passes):
        gate = bit_set(windows.where(deal(F.col("hash"), passes) == turn) if passes > 1 else windows, -(-count // passes))
        table = materialize(d.select("doc_id", "text_key", "n", _candidates(gate, lengths, turn, passes).alias("hits")), "candidate-windows")
        tables.append(table)
    rows = tables[0].drop("hits")
    hits = reduce(DataFrame.unionByName, [t.where(F.size("hits") > 0).select("doc_id", "text_key", F.inline("hits")) for t in tables])
    known = windows.select(F.col("hash").alias("of_hash"), F.col("win").alias("of_win"), F.col("items").alias("of"))
    hits = hits.join(F.broadcast(known) if few(known, max_broadcast) else known, (F.col("hash") == F.col("of_hash")) & (F.col("win") == F.col("of_win")))
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    out = out.withColumn("spans", spans).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), "items", "spans")


def _candidates(gate: np.ndarray, lengths: list[int], turn: int, passes: int) -> Column:
    """Structs (begin, end, hash, win) of the windows, of any of the lengths, that the pass's bit set lets through."""
    bits, words = 64 * len(gate), F.lit(gate)

    def is_set(at: Column) -> Column:
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def let_through(hash_: Column) -> Column:
        first, second = places(hash_, bits)
        hit = is_set(first) & is_set(second)
        return hit if passes == 1 else (deal(hash_, passes) == turn) & hit

    def of_length(k: int) -> Column:
        at = F.filter(begins(F.col("n"), k), lambda i: let_through(window_hash(F.col("hashes"), i, k)))
        return F.transform(at, lambda i: F.struct(i.alias("begin"), (i + k).alias("end"), window_hash(F.col("hashes"), i, k).alias("hash"), F.array_join(F.slice("words", i + 1, k), " ").alias("win")))

    return F.concat(*map(of_length, lengths)) if lengths else F.array().cast("array<struct<begin:int,end:int,hash:bigint,win:string>>")


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = MIN_ITEMS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (windows of min_items items or more occur)."""
    d = find_windows(docs, items, width)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


RAW_WORD = ITEM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # before A-Z are lowered


def without_words(words: Column, gaps: Column, spans: Column) -> Column:
    """The text without the words at the places in the spans, nor what follows each of them up to the next word.
    words and gaps (what stands before, between and after the words) must be columns: a lambda evaluates
    expressions anew for every word. Linear in the words: places are subtracted as sets."""
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["begin"], s["end"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), gone)
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get(words, i), F.get(gaps, i + 1))), ""))


def remove_leaks(docs: DataFrame, items: DataFrame, min_items: int = MIN_ITEMS, width: int = WIDTH, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """The rows of docs, with all their columns: documents with windows of min_items items or more go, others
    lose the words inside the windows they hold; texts without any stay as they are. What the hit documents lose is
    broadcast while it is small, so that no text moves."""
    hit = find_windows(docs, items, width).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    hit = materialize(hit.select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_text"), F.size("items").alias("__items"), F.col("spans").alias("__spans")), "leaks")
    size = hit.agg(F.count("*") + F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(hit["__hit_id"]) & (keyed["__text_key"] == hit["__hit_text"])
    out = keyed.join(F.broadcast(hit) if size <= broadcast_hits else hit, same, "left")
    out = out.where(F.coalesce("__items", F.lit(0)) < min_items)
    leaky = F.col("__spans").isNotNull()
    out = once(out, __words=F.when(leaky, F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0))), __gaps=F.when(leaky, F.split("text", RAW_WORD, -1)))
    text = F.when(leaky, without_words(F.col("__words"), F.col("__gaps"), F.col("__spans"))).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
