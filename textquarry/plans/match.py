"""From a parsed query to a plan: one pass over tokenised blocks, one tiny aggregate, one top-k.

Every block holds its tokens in order. Each phrase of the query becomes an expression for its positions in
that array, so that matching needs neither explosion nor shuffle; only the corpus figures (number of blocks,
tokens, blocks a phrase) are aggregated, and joined back as a single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .query import Near, Op, Phrase, Query

K1, B, FLOOR = 1.2, 0.75, 1e-6


def positions(tokens: Column, phrase: Phrase) -> Column:
    """Places (from 0) where the phrase's words stand in a row; its last word may be a prefix."""
    if not phrase.words:
        return F.array().cast("array<int>")
    last = len(phrase.words) - 1

    def here(token: Column, i: Column) -> Column:
        test = F.lit(True)
        for k, word in enumerate(phrase.words):
            at = token if k == 0 else F.get(tokens, i + k)
            test = test & (at.startswith(word) if phrase.prefix and k == last else at == word)
        return F.coalesce(test, F.lit(False))

    places = F.transform(tokens, lambda token, i: F.when(here(token, i), i))
    return F.array_compact(places)


def near_positions(found: list[Column], lengths: list[int], distance: int) -> list[Column]:
    """Of each phrase, the places that take part in a group of all phrases within the distance: with the last
    of the group beginning at m, each has m - (place + length) <= distance and place <= m. Reaches are spelled out
    and intersected as sets, so time is linear in the places."""
    reach = [F.flatten(F.transform(f, _upto(n + distance))) for f, n in zip(found, lengths, strict=True)]
    ends = reduce(F.array_intersect, reach, reduce(F.concat, found))
    return [F.array_intersect(f, F.flatten(F.transform(ends, _downto(n + distance)))) for f, n in zip(found, lengths, strict=True)]


def _upto(span: int):
    return lambda p: F.sequence(p, p + span)


def _downto(span: int):
    return lambda m: F.sequence(m - span, m)


def matched(blocks: DataFrame, query: Query) -> DataFrame:
    """blocks (doc_key, block_index, tokens) with n_tokens, tf (one a scored unit), unit (its phrase's number),
    own (one a phrase: whether the block holds it) and hit (whether the tree is true)."""
    return _judged(placed_in_blocks(blocks, query.phrases), query)


def slots_of(phrases: list[Phrase]) -> list[tuple[str, bool]]:
    """The words of phrases, each once, and whether a prefix."""
    return list(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)))


def placed_by_slots(blocks: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """blocks with the places of each phrase instead of those of each slot (__s0..): a phrase is an intersection of
    shifted lists."""
    slots = slots_of(phrases)

    def places(p: Phrase) -> Column:
        if not p.words:
            return F.array().cast("array<int>")
        at = [F.col(f"__s{slots.index((w, p.prefix and k == len(p.words) - 1))}") for k, w in enumerate(p.words)]
        return reduce(F.array_intersect, [_shifted(c, k) for k, c in enumerate(at)])

    placed = blocks.withColumns({f"__p{i}": places(p) for i, p in enumerate(phrases)})
    return placed.drop(*[f"__s{i}" for i in range(len(slots))])


def placed_in_index(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """The same from postings, of the blocks that hold any of the phrases' words. The terms are literals, so the
    scan prunes to them; positions of one block meet in one row, and phrases are intersections of shifted lists."""
    slots = slots_of(phrases)
    term = F.col("term")
    tests = [term.startswith(w) if prefix else term == w for w, prefix in slots]
    rows = postings.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    found = [F.array_sort(F.flatten(F.collect_list(F.when(t, F.col("positions"))))).alias(f"__s{i}") for i, t in enumerate(tests)]
    blocks = rows.groupBy("doc_key", "block_index", "n_tokens").agg(*found) if found else rows.select("doc_key", "block_index", "n_tokens")
    return placed_by_slots(blocks, phrases)


def matched_in_index(postings: DataFrame, query: Query) -> DataFrame:
    """`matched` from postings, of the blocks that hold any of the query's words."""
    return _judged(placed_in_index(postings, query.phrases), query)


def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def _judgement(query: Query, places: dict[Phrase, Column], numbers: dict[Phrase, int]) -> tuple[Column, list[tuple[int, Column]]]:
    """Whether the tree is true in a row, and its scored units (number of the phrase, times); units below an AND or NOT
    that fails count nothing."""

    def truth(x) -> tuple[Column, list[tuple[int, Column]]]:
        if isinstance(x, Phrase):
            return F.size(places[x]) > 0, [(numbers[x], F.size(places[x]))]
        if isinstance(x, Near):
            kept = near_positions([places[p] for p in x.phrases], [len(p.words) for p in x.phrases], x.distance)
            sizes = [F.size(k) for k in kept]
            return reduce(lambda a, b: a & b, [s > 0 for s in sizes]), [(numbers[p], s) for p, s in zip(x.phrases, sizes, strict=True)]
        (left, some), (right, more) = truth(x.left), truth(x.right)
        if x.kind == "or":
            return left | right, some + more
        node = left & right if x.kind == "and" else left & ~right
        return node, [(u, F.when(node, s).otherwise(0)) for u, s in some + more]

    return truth(query.tree)


def _judged(placed: DataFrame, query: Query) -> DataFrame:
    places = {p: F.col(f"__p{i}") for i, p in enumerate(query.phrases)}
    hit, units = _judgement(query, places, {p: i for i, p in enumerate(query.phrases)})
    out = placed.select(
        *[c for c in placed.columns if c != "tokens" and not c.startswith("__p")],
        F.array(*[s for _, s in units]).alias("tf"),
        F.array(*[F.size(places[p]) > 0 for p in query.phrases]).alias("own"),
        hit.alias("hit"),
    )
    return out.withColumn("unit", F.array(*[F.lit(u) for u, _ in units]))


def search_many(placed: DataFrame, queries: dict[str, Query], phrases: list[Phrase], size: DataFrame | None = None) -> DataFrame:
    """query, doc_key, block_index, n_tokens, score of all hits of many queries from one placed table, whose columns __p0..
    are the places of the phrases: one pass for the figures of all, one for the hits of all. size: block_stats, where
    placed holds only some of the blocks."""
    places = {p: F.col(f"__p{i}") for i, p in enumerate(phrases)}
    numbers = {p: i for i, p in enumerate(phrases)}
    df = F.array(*[F.count_if(F.size(places[p]) > 0) for p in phrases]).alias("df")
    if size is None:
        figures = placed.agg(F.count("*").alias("n_blocks"), F.avg("n_tokens").alias("mean_tokens"), df)
    else:
        figures = size.agg(F.count("*").alias("n_blocks"), F.avg("n_tokens").alias("mean_tokens")).join(F.broadcast(placed.agg(df)))  # one row each
    each = []
    for name, q in queries.items():
        hit, units = _judgement(q, places, numbers)
        row = F.struct(F.lit(name).alias("query"), F.array(*[s for _, s in units]).alias("tf"), F.array(*[F.lit(u) for u, _ in units]).alias("unit"), F.lit(True).alias("hit"), F.array().cast("array<boolean>").alias("own"))
        each.append(F.when(hit, row))
    hits = placed.select("doc_key", "block_index", "n_tokens", F.inline(F.array_compact(F.array(*each))))
    return scored(hits, figures)


def placed_in_blocks(blocks: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """blocks (doc_key, block_index, tokens) with n_tokens and the places of each phrase."""
    return once(blocks.drop("n_tokens"), n_tokens=F.size("tokens"), **{f"__p{i}": positions(F.col("tokens"), p) for i, p in enumerate(phrases)})


def corpus_figures(matches: DataFrame, phrases: int) -> DataFrame:
    """One row: n_blocks, mean_tokens, df (blocks holding each phrase)."""
    df = F.array(*[F.count_if(F.get("own", F.lit(i))) for i in range(phrases)])
    return matches.agg(F.count("*").alias("n_blocks"), F.avg("n_tokens").alias("mean_tokens"), df.alias("df"))


def index_figures(stats: DataFrame, matches: DataFrame, phrases: int) -> DataFrame:
    """The same from block_stats and the blocks that hold any word of the query."""
    size = stats.agg(F.count("*").alias("n_blocks"), F.avg("n_tokens").alias("mean_tokens"))
    df = F.array(*[F.count_if(F.get("own", F.lit(i))) for i in range(phrases)])
    return size.join(F.broadcast(matches.agg(df.alias("df"))))  # one row each


def scored(matches: DataFrame, figures: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Blocks that match, with BM25 scores; `allowed` (doc_key) filters rows but not the corpus figures."""
    rows = matches.where("hit")
    if allowed is not None:
        rows = rows.join(allowed.select("doc_key").distinct(), "doc_key", "left_semi")
    rows = rows.join(F.broadcast(figures))  # a single row
    idf = F.transform("df", lambda d: F.greatest(F.ln((F.col("n_blocks") - d + 0.5) / (d + 0.5)), F.lit(FLOOR)))
    length = K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens"))
    terms = F.zip_with("tf", "unit", lambda tf, u: F.get(F.col("__idf"), u) * tf * (K1 + 1) / (tf + length))
    rows = rows.withColumn("__idf", idf).withColumn("score", F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    return rows.drop("__idf", "tf", "unit", "own", "hit", "n_blocks", "mean_tokens", "df")


def search_blocks(blocks: DataFrame, query: Query, allowed: DataFrame | None = None) -> DataFrame:
    return search_placed(placed_in_blocks(blocks, query.phrases), query, allowed)


def search_placed(placed: DataFrame, query: Query, allowed: DataFrame | None = None) -> DataFrame:
    m = _judged(placed, query)
    return scored(m, corpus_figures(m, len(query.phrases)), allowed)


def search_index(postings: DataFrame, stats: DataFrame, query: Query, allowed: DataFrame | None = None) -> DataFrame:
    m = matched_in_index(postings, query)
    return scored(m, index_figures(stats, m, len(query.phrases)), allowed)
