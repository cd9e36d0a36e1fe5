"""Keyword search: best block a document, best blocks, batches of queries, passages, search within one item."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.han import simplified_map
from ..functions.porter import stem, stems, words_of_prefix, words_of_stem
from ..functions.rows import once
from ..functions.text import CJK, exact_text, fold_word, not_blank, occurrences, reflow, segment_cjk, tokens, window
from ..plans import match, query
from ..plans.query import Phrase, Query

RADIUS = 250
SCORE_DIGITS = 4


def words_of_blocks(blocks: DataFrame) -> DataFrame:
    """doc_key, block_index, text, tokens (folded words), n_tokens of the blocks whose text is not blank."""
    rows = once(blocks.where(not_blank(F.col("text"))).select("doc_key", "block_index", "text"), tokens=tokens(F.col("text")))
    return rows.withColumn("n_tokens", F.size("tokens"))


def tokenised(blocks: DataFrame, stemmed: bool = True) -> DataFrame:
    """doc_key, block_index, text, tokens (folded, and stemmed), n_tokens of all blocks that are indexed: those whose text
    is not blank."""
    out = words_of_blocks(blocks)
    return once(out.withColumnRenamed("tokens", "__words"), tokens=stems(F.col("__words"))).select(out.columns) if stemmed else out


def placed(blocks: DataFrame, phrases: list[Phrase], stemmed: bool = True) -> DataFrame:
    """doc_key, block_index, n_tokens and the places of each phrase (__p0..). No word of a text is stemmed: the words that
    have the stem of a query word are few, and are looked for."""
    rows = words_of_blocks(blocks).drop("text")
    if not stemmed:
        return match.placed_in_blocks(rows, phrases).drop("tokens")
    slots = match.slots_of(phrases)
    some = f"array_compact(transform(tokens, (w, i) -> if({' or '.join(_has_stem(w, prefix) for w, prefix in slots) or 'false'}, struct(i, w), null)))"
    rows = once(rows, some=F.expr(some)).drop("tokens")
    found = {f"__s{k}": F.expr(f"transform(filter(some, x -> {_has_stem(w, prefix, 'x.w')}), x -> x.i)") for k, (w, prefix) in enumerate(slots)}
    return match.placed_by_slots(once(rows, **found) if found else rows, phrases).drop("some")


def _has_stem(stemmed: str, prefix: bool, word: str = "w") -> str:
    """SQL test whether a word's stem is this, or begins with it."""

    def among(words: frozenset[str]) -> str:
        return f"{word} in ({', '.join(map(_literal, sorted(words)))})" if words else "false"

    if not prefix:
        return f"({among(words_of_stem(stemmed))})"
    lost, more = words_of_prefix(stemmed)
    return f"((startswith({word}, {_literal(stemmed)}) and not {among(lost)}) or {among(more)})"


def _literal(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded_query(q: Query, stemmed: bool = True) -> Query:
    """The query with its words folded, and stemmed, as those of the index are."""

    def word(w: str) -> str:
        w = fold_word(w)
        return stem(w) if stemmed else w

    def of(x):
        if isinstance(x, Phrase):
            return Phrase(tuple(word(w) for w in x.words), x.prefix)
        if isinstance(x, query.Near):
            return query.Near(tuple(of(p) for p in x.phrases), x.distance)
        return query.Op(x.kind, of(x.left), of(x.right))

    return Query(of(q.tree), list(dict.fromkeys(of(p) for p in q.phrases)))


def _parsed(text: str, stemmed: bool) -> Query:
    return folded_query(query.parse(text), stemmed)


def block_hits(blocks: DataFrame, text: str, allowed: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """All matching blocks with their scores, rounded so that equal scores sort alike everywhere."""
    q = _parsed(text, stemmed)
    hits = match.search_placed(placed(blocks, q.phrases, stemmed), q, allowed)
    return hits.select("doc_key", "block_index", F.round("score", SCORE_DIGITS).alias("score"))


def top_blocks(blocks: DataFrame, text: str, limit: int = 10, **options) -> DataFrame:
    return block_hits(blocks, text, **options).orderBy(F.desc("score"), "doc_key", "block_index").limit(limit)


def best_of_document(hits: DataFrame, *by: str) -> DataFrame:
    """The best block of each document; of equal ones the first."""
    best = F.max(F.struct("score", (-F.col("block_index")).alias("n"))).alias("b")
    return hits.groupBy(*by, "doc_key").agg(best).select(*by, "doc_key", (-F.col("b.n")).alias("block_index"), F.col("b.score").alias("score"))


def search(blocks: DataFrame, text: str, limit: int = 10, min_score: float | None = None, **options) -> DataFrame:
    """doc_key, block_index, score of the `limit` best documents; min_score is applied after the limit."""
    out = best_of_document(block_hits(blocks, text, **options)).orderBy(F.desc("score"), "doc_key").limit(limit)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def search_index(postings: DataFrame, stats: DataFrame, text: str, limit: int = 10, allowed: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """`search` over a stored index: postings and block_stats (see operators.index)."""
    hits = match.search_index(postings, stats, _parsed(text, stemmed), allowed)
    hits = hits.select("doc_key", "block_index", F.round("score", SCORE_DIGITS).alias("score"))
    return best_of_document(hits).orderBy(F.desc("score"), "doc_key").limit(limit)


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    best = best_of_document(hits.select("query", "doc_key", "block_index", F.round("score", SCORE_DIGITS).alias("score")), "query")
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_key"))
    return best.withColumn("rank", turn).where(F.col("rank") <= limit)


def _phrases(queries: dict[str, Query]) -> list[Phrase]:
    return list(dict.fromkeys(p for q in queries.values() for p in q.phrases))


def search_batch(blocks: DataFrame, texts: dict[str, str], limit: int = 10, stemmed: bool = True) -> DataFrame:
    """query, doc_key, block_index, score, rank of many queries: all are matched in the same pass over the blocks."""
    queries = {name: _parsed(t, stemmed) for name, t in texts.items()}
    phrases = _phrases(queries)
    return _ranked(match.search_many(placed(blocks, phrases, stemmed), queries, phrases), limit)


def search_index_batch(postings: DataFrame, stats: DataFrame, texts: dict[str, str], limit: int = 10, stemmed: bool = True) -> DataFrame:
    """`search_batch` over a stored index: postings are read for the union of all queries' words."""
    queries = {name: _parsed(t, stemmed) for name, t in texts.items()}
    phrases = _phrases(queries)
    return _ranked(match.search_many(match.placed_in_index(postings, phrases), queries, phrases, stats), limit)


def flexible(literal: str) -> str:
    """Pattern of a literal that tolerates any white space between words, and between CJK characters none or some."""
    words = []
    for word in literal.split():
        words.append("".join(re.escape(c) + (r"\s*" if query.is_cjk(c) and query.is_cjk(d) else "") for c, d in zip(word, word[1:] + " ", strict=True)))
    return r"\s+".join(words)


def anchor_offset(snippet: Column, text: str) -> Column:
    """Middle of the first candidate of the query that the snippet holds, from 0; null if it holds none."""
    found = []
    for literal, prefix in query.anchors(text):
        body = flexible(literal)
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}]){body}" + (r"[\p{L}\p{N}]*" if prefix else r"(?![\p{L}\p{N}])")
        at = F.regexp_instr(snippet, F.lit(pattern))
        size = F.length(F.regexp_extract(snippet, pattern, 0))
        found.append(F.when(at > 0, at - 1 + F.floor(F.greatest(F.lit(1), size) / 2)))
    return F.coalesce(*found, F.lit(None).cast("long")) if found else F.lit(None).cast("long")


def passages(hits: DataFrame, blocks: DataFrame, markdown: DataFrame, text: str, radius: int = RADIUS) -> DataFrame:
    """hits with char_offset and passage: the document's markdown around the query's anchor in the hit block,
    or around the block's middle. Texts are joined to the hits only, which a limit has made few."""
    b = blocks.select("doc_key", "block_index", "snippet", "char_start", "char_end")
    middle = F.round((F.col("char_start") + F.col("char_end")) / 2).cast("long")
    at = F.col("char_start") + F.least(anchor_offset(F.col("snippet"), text), F.length("snippet") - 1)
    found = b.join(F.broadcast(hits), ["doc_key", "block_index"]).withColumn("char_offset", F.coalesce(at, middle))
    few = found.select("doc_key", "block_index", "score", "char_offset")
    out = markdown.join(F.broadcast(few), "doc_key")
    return out.select("doc_key", "block_index", "score", "char_offset", reflow(window(F.col("markdown"), F.col("char_offset").cast("int"), radius)).alias("passage"))


def exact_ranges(blocks: DataFrame, phrase: str, simplify: bool = True) -> DataFrame:
    """doc_key, block_start, block_end: the narrowest range of blocks over which a phrase stands literally, with
    token boundaries, block borders counting as spaces; of equally narrow ones the first.

    A match lies inside a block, or begins among a block's last tokens and ends in one of the next blocks: of n
    words, the last n - 1 tokens of a block and the first n - 1 of what follows tell. So tokens are made once a
    block, and only a block's ends move."""
    words = tuple(w for p in exact_words(phrase, simplify) for w in query.words_of(p))
    n, key = len(words) - 1, Phrase(words)
    parts = once(blocks.select("doc_key", "block_index", "text"), ts=exact_tokens(exact_text(F.col("text"), simplify))).where(F.size("ts") > 0)
    inside = F.get(match.positions(F.col("ts"), key), F.lit(0))
    parts = once(parts, inside=inside, head=F.slice("ts", 1, max(n, 1)), tail=F.slice("ts", F.greatest(F.lit(1), F.size("ts") - n + 1), F.lit(max(n, 1))), size=F.size("ts")).drop("ts", "text")
    order = Window.partitionBy("doc_key").orderBy("block_index")
    best = F.when(F.col("inside").isNotNull(), F.struct(F.lit(0).alias("span"), F.col("block_index").alias("a"), F.col("inside").alias("p"), F.col("block_index").alias("z")))
    if n > 0:
        ahead = order.rowsBetween(1, n)
        parts = parts.withColumn("next", F.slice(F.flatten(F.transform(F.collect_list(F.struct("block_index", "head")).over(ahead), lambda b, i: F.transform(b["head"], lambda w: F.struct(w.alias("w"), b["block_index"].alias("b"), (i + 1).alias("k"))))), 1, n))
        parts = once(parts, row=F.concat("tail", F.transform("next", lambda x: x["w"])))
        cut = F.size("tail")
        across = F.filter(match.positions(F.col("row"), key), lambda i: (i < cut) & (i + n >= cut))
        found = F.transform(across, lambda i: F.struct(F.get("next", i + n - cut)["k"].alias("span"), F.col("block_index").alias("a"), (F.col("size") - cut + i).alias("p"), F.get("next", i + n - cut)["b"].alias("z")))
        best = F.coalesce(best, F.array_min(found))
    rows = parts.select("doc_key", best.alias("best")).where("best is not null").groupBy("doc_key").agg(F.min("best").alias("best"))
    return rows.select("doc_key", F.col("best.a").alias("block_start"), F.col("best.z").alias("block_end"))


def exact_words(phrase: str, simplify: bool = True) -> list[str]:
    """A phrase as exact_text would have it."""
    simple = simplified_map() if simplify else {}
    text = "".join(simple.get(c, c) for c in unicodedata.normalize("NFKC", phrase))
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def exact_tokens(c: Column) -> Column:
    """Tokens of an exact text: its words, CJK characters apart."""
    return F.filter(F.split(F.when(c.rlike(CJK), segment_cjk(c)).otherwise(c), " "), lambda w: w != "")


def search_in(blocks: DataFrame, text: str, limit: int = 10, stemmed: bool = True) -> DataFrame:
    """Within the given blocks (of one item, or of many): block hits, and for a single quoted phrase the exact
    range with score 100 less its width; of hits at one block the better stays."""
    hits = block_hits(blocks, text, stemmed=stemmed).withColumn("block_end", F.col("block_index"))
    phrase = query.single_phrase(text)
    if phrase:
        exact = exact_ranges(blocks, phrase)
        hits = exact.select("doc_key", F.col("block_start").alias("block_index"), (F.lit(100.0) - (F.col("block_end") - F.col("block_start"))).alias("score"), "block_end").unionByName(hits)
    turn = F.row_number().over(Window.partitionBy("doc_key", "block_index").orderBy(F.desc("score"), "block_end"))
    return hits.withColumn("turn", turn).where("turn = 1").drop("turn").orderBy(F.desc("score"), "doc_key", "block_index").limit(limit)


def occurrence_counts(docs: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    return docs.select(key, occurrences(F.col(text), literal).cast("long").alias("n")).where("n > 0")
