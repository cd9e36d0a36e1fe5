"""Registered queries over the driver's tables, each with the DuckDB SQL that must agree.

The tables are no bibliography, so each operator gets a deterministic adapter: a document's lines are its
blocks; a conversation is an item and its turns are attachments; two catalog snapshots and a bibliography are
derived from documents by rules on doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import heuristics, papers
from .functions.porter import stem
from .functions.porter_sql import stem_steps
from .functions.text import diacritic_fold, not_blank, stripped, words_only
from .operators import blocks as B
from .operators import run as run_plan
from .operators import diagnose, index, metadata, retrieve, search, semantic, sync, vectors
from .registry import query
from .sources.scan import spread

WORD = r"([\p{L}\p{N}]+)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lines_as_elements(read(spark, sf_dir, "documents"), "doc_id", "text")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).withColumnRenamed("pos", "block_index")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.annotate(elements(spark, sf_dir), paths=False)


# SQL pieces shared by the oracles.
LINES = "lines AS (SELECT doc_id AS doc_key, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _stemmed(raw: str) -> str:
    """CTEs from raw (doc_key, block_index, raw words) to blocks (doc_key, block_index, toks): every word's stem in place."""
    return (
        f"raw AS ({raw}), words AS (SELECT DISTINCT unnest(raw) AS t FROM raw), stems AS MATERIALIZED ({stem_steps('words', 't')}), "
        "placed_stems AS (SELECT doc_key, block_index, list(stem ORDER BY i) AS toks FROM (SELECT doc_key, block_index, unnest(raw) AS t, unnest(range(len(raw))) AS i FROM raw) JOIN stems ON term = t GROUP BY ALL), "
        "blocks AS (SELECT raw.doc_key, raw.block_index, coalesce(toks, []) AS toks FROM raw LEFT JOIN placed_stems p ON p.doc_key = raw.doc_key AND p.block_index = raw.block_index)"
    )


TOKS = LINES + ", " + _stemmed(r"SELECT doc_key, pos AS block_index, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS raw FROM lines WHERE trim(text) <> ''")
#: Words as they stand, for exact phrases.
EXACT_TOKS = LINES + r", blocks AS (SELECT doc_key, pos AS block_index, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM lines WHERE trim(text) <> '')"
BLOCKS = LINES + ", kept AS (SELECT doc_key, pos, trim(text) AS text FROM lines WHERE trim(text) <> ''), ann AS (SELECT doc_key, text, row_number() OVER w - 1 AS block_index, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM kept WINDOW w AS (PARTITION BY doc_key ORDER BY pos)), blk AS (SELECT *, char_start + length(text) AS char_end FROM ann)"


def _positions(words: list[str], prefix: bool = False) -> str:
    """DuckDB list of the places (from 0) of a phrase in toks."""
    tests = []
    for k, w in enumerate(words):
        at = f"toks[i + {k}]"
        tests.append(f"starts_with({at}, '{w}')" if prefix and k == len(words) - 1 else f"{at} = '{w}'")
    return f"list_transform(list_filter(range(1, len(toks) + 1), lambda i: {' AND '.join(tests)}), lambda i: i - 1)"


def _bm25(phrases: dict[str, str], hit: str, allowed: str = "TRUE", tf: dict[str, str] | None = None, toks: str = TOKS) -> str:
    """CTEs ending in `scored` (doc_key, block_index, score) for phrases given as position lists."""
    tf = tf or {p: f"len({p})" for p in phrases}
    places = ", ".join(f"{sql} AS {p}" for p, sql in phrases.items())
    stats = ", ".join(f"count(*) FILTER (len({p}) > 0) AS df_{p}" for p in phrases)
    terms = " + ".join(f"greatest(ln((n - df_{p} + 0.5) / (df_{p} + 0.5)), 1e-6) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * len(toks) / avg_len))" for p, t in tf.items())
    return f"WITH {toks}, placed AS (SELECT *, {places} FROM blocks), stats AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len, {stats} FROM placed), scored AS (SELECT doc_key, block_index, round({terms}, 4) AS score FROM placed, stats WHERE ({hit}) AND {allowed})"


BEST = ", best AS (SELECT doc_key, block_index, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, block_index) AS rn FROM scored) WHERE rn = 1)"
TOP10 = " SELECT doc_key, block_index, score FROM best ORDER BY score DESC, doc_key LIMIT 10"


def _one(*words: str) -> str:
    return _positions([stem(w) for w in words])


def _keyword(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(raw_blocks(spark, sf_dir), text)


_keyword("kw_or", "with OR there OR stonin", _bm25({"a": _one("with"), "b": _one("there"), "c": _one("stonin")}, "len(a) > 0 OR len(b) > 0 OR len(c) > 0") + BEST + TOP10)
_keyword("kw_and", "the of is", _bm25({"a": _one("the"), "b": _one("of"), "c": _one("is")}, "len(a) > 0 AND len(b) > 0 AND len(c) > 0") + BEST + TOP10)
_keyword("kw_not", "that NOT the", _bm25({"a": _one("that"), "b": _one("the")}, "len(a) > 0 AND NOT len(b) > 0") + BEST + TOP10)
_keyword("kw_prefix", "ther*", _bm25({"a": _positions(["ther"], True)}, "len(a) > 0") + BEST + TOP10)
_keyword("kw_phrase", '"of the"', _bm25({"a": _one("of", "the")}, "len(a) > 0") + BEST + TOP10)
_PAIR = "(len(b) > 0 AND len(c) > 0 AND NOT len(d) > 0)"
_keyword("kw_precedence", "with OR that the NOT of", _bm25({"a": _one("with"), "b": _one("that"), "c": _one("the"), "d": _one("of")}, f"len(a) > 0 OR {_PAIR}", tf={"a": "len(a)"} | {x: f"CASE WHEN {_PAIR} THEN len({x}) ELSE 0 END" for x in "bc"}) + BEST + TOP10)
_keyword("kw_parentheses", "(with OR that) AND (la OR the)", _bm25({"a": _one("with"), "b": _one("that"), "c": _one("la"), "d": _one("the")}, "(len(a) > 0 OR len(b) > 0) AND (len(c) > 0 OR len(d) > 0)") + BEST + TOP10)
_keyword("kw_fallback", "foo:the of-is", _bm25({"z": _one("foo"), "a": _one("the"), "b": _one("of"), "c": _one("is")}, "len(z) > 0 AND len(a) > 0 AND len(b) > 0 AND len(c) > 0") + BEST + TOP10)
_NEAR = {x: f"len(list_filter({x}, lambda p: len(list_filter({y}, lambda q: abs(p - q) <= 4)) > 0))" for x, y in (("a", "b"), ("b", "a"))}
_keyword("kw_near", "that NEAR/3 with", _bm25({"a": _one("that"), "b": _one("with")}, f"{_NEAR['a']} > 0", tf=_NEAR) + BEST + TOP10)


@query("kw_blocks_topk", _bm25({"a": _one("the"), "b": _one("of")}, "len(a) > 0 AND len(b) > 0") + " SELECT doc_key, block_index, score FROM scored ORDER BY score DESC, doc_key, block_index LIMIT 25")
def kw_blocks_topk(spark, sf_dir):
    return search.top_blocks(raw_blocks(spark, sf_dir), "the of", limit=25)


@query("kw_filtered_global_stats", _bm25({"a": _one("the"), "b": _one("with")}, "len(a) > 0 OR len(b) > 0", "doc_key IN (SELECT doc_id FROM labels WHERE quality = 1)") + BEST + TOP10)
def kw_filtered_global_stats(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc_key"))
    return search.search(raw_blocks(spark, sf_dir), "the OR with", allowed=good)


@query("kw_min_score", _bm25({"a": _one("with")}, "len(a) > 0") + BEST + " SELECT * FROM (SELECT doc_key, block_index, score FROM best ORDER BY score DESC, doc_key LIMIT 10) WHERE score >= 1.2")
def kw_min_score(spark, sf_dir):
    return search.search(raw_blocks(spark, sf_dir), "with", min_score=1.2)


_BATCH = {"q_or": "with OR that", "q_and": "the of", "q_phrase": '"in the"'}
_BATCH_SQL = {
    "q_or": _bm25({"a": _one("with"), "b": _one("that")}, "len(a) > 0 OR len(b) > 0"),
    "q_and": _bm25({"a": _one("the"), "b": _one("of")}, "len(a) > 0 AND len(b) > 0"),
    "q_phrase": _bm25({"a": _one("in", "the")}, "len(a) > 0"),
}


_BATCH_ORACLE = " UNION ALL ".join(f"SELECT * FROM ({sql}{BEST} SELECT '{q}' AS query, doc_key, block_index, score, row_number() OVER (ORDER BY score DESC, doc_key)::INTEGER AS rank FROM best) WHERE rank <= 10" for q, sql in _BATCH_SQL.items())


@query("kw_batch", _BATCH_ORACLE)
def kw_batch(spark, sf_dir):
    return search.search_batch(raw_blocks(spark, sf_dir), _BATCH)


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tokenised blocks, and block_stats, which count words and need no stems."""
    b = raw_blocks(spark, sf_dir)
    return search.tokenised(b), index.block_stats(search.words_of_blocks(b))


@query("kw_batch_from_index", _BATCH_ORACLE)
def kw_batch_from_index(spark, sf_dir):
    t, figures = indexed(spark, sf_dir)
    return search.search_index_batch(index.postings(t), figures, _BATCH)


_INDEXED = {"a": _one("of", "the"), "b": _positions(["ther"], True), "c": _one("is")}


@query("kw_from_index", _bm25(_INDEXED, "(len(a) > 0 OR len(b) > 0) AND NOT len(c) > 0", tf={x: f"CASE WHEN len(c) > 0 THEN 0 ELSE len({x}) END" for x in "ab"}) + BEST + TOP10)
def kw_from_index(spark, sf_dir):
    t, figures = indexed(spark, sf_dir)
    return search.search_index(index.postings(t), figures, '("of the" OR ther*) NOT is')


_keyword("kw_stemmed", "oning AND eres", _bm25({"a": _one("on"), "b": _one("er")}, "len(a) > 0 AND len(b) > 0") + BEST + TOP10)
_keyword("kw_folded", "fur OR cion", _bm25({"a": _one("fur"), "b": _one("cion")}, "len(a) > 0 OR len(b) > 0") + BEST + TOP10)

#: Letters of the invented words that become CJK characters, a Traditional one among them.
_LETTERS, _HAN = "aeios", "書人山日東"
_SIMPLE = "书人山日东"


@query("kw_cjk", _bm25({"a": _one("书"), "b": _one("人")}, "len(list_filter(a, lambda p: len(list_filter(b, lambda q: abs(p - q) <= 2)) > 0)) > 0", tf={x: f"len(list_filter({x}, lambda p: len(list_filter({y}, lambda q: abs(p - q) <= 2)) > 0))" for x, y in (("a", "b"), ("b", "a"))}, toks=LINES + ", " + _stemmed(rf"SELECT doc_key, pos AS block_index, regexp_extract_all(regexp_replace(translate(lower(strip_accents(text)), '{_LETTERS}', '{_SIMPLE}'), '([{_SIMPLE}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS raw FROM lines WHERE trim(text) <> ''")) + BEST + TOP10)
def kw_cjk(spark, sf_dir):
    """A run of two characters is a proximity of both; the query is Traditional, so is the text."""
    b = raw_blocks(spark, sf_dir)
    plain = F.lower(diacritic_fold(F.col("text")))
    return search.search(b.withColumn("text", F.translate(plain, _LETTERS, _HAN)), "書人")


@query("postings", f"WITH {TOKS}, t AS (SELECT doc_key, block_index, len(toks) AS n_tokens, unnest(toks) AS term FROM blocks) SELECT term, count(DISTINCT (doc_key, block_index)) AS df, count(*) AS cf FROM t GROUP BY term")
def postings(spark, sf_dir):
    return index.term_stats(index.postings(search.tokenised(raw_blocks(spark, sf_dir))))


@query("block_stats", f"WITH {TOKS} SELECT doc_key, block_index, len(toks)::INTEGER AS n_tokens FROM blocks")
def block_stats(spark, sf_dir):
    return indexed(spark, sf_dir)[1]


def _states(doc: str = "doc_key") -> F:
    k = F.pmod(F.col(doc), F.lit(10))
    return F.when(k == 0, "changed").when(k == 1, "removed").when(k == 2, "unreadable").when(k == 3, "missing")


@query("postings_incremental", f"WITH {TOKS}, t AS (SELECT doc_key, block_index, unnest(CASE WHEN doc_key % 10 = 0 THEN list_reverse(toks) ELSE toks END) AS term, unnest(range(len(toks))) AS pos FROM blocks WHERE doc_key % 10 NOT IN (1, 3)) SELECT term, doc_key, block_index, count(*) AS tf, min(pos)::INTEGER AS first_pos FROM t GROUP BY ALL")
def postings_incremental(spark, sf_dir):
    old = search.tokenised(raw_blocks(spark, sf_dir))
    new = old.where("doc_key % 10 in (0, 2)").withColumn("tokens", F.reverse("tokens"))
    changes = old.select("doc_key").distinct().withColumn("state", _states()).where("state is not null")
    out = index.updated(index.postings(old), index.postings(new), changes)
    return out.select("term", "doc_key", "block_index", F.size("positions").cast("long").alias("tf"), F.get("positions", F.lit(0)).alias("first_pos"))


@query("blocks_annotated", f"WITH {BLOCKS} SELECT doc_key, block_index::INTEGER AS block_index, char_start, char_end, 1 + 2 * block_index AS line_start, text FROM blk")
def blocks_annotated(spark, sf_dir):
    return annotated(spark, sf_dir).select("doc_key", "block_index", "char_start", "char_end", "line_start", stripped(F.col("text")).alias("text"))


@query("blocks_page", f"WITH {BLOCKS} SELECT doc_key, block_index::INTEGER AS block_index, text FROM blk WHERE block_index BETWEEN 3 AND 7")
def blocks_page(spark, sf_dir):
    return retrieve.page(annotated(spark, sf_dir), 3, 5).select("doc_key", "block_index", stripped(F.col("text")).alias("text"))


@query(
    "item_merged_blocks",
    "WITH lines AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10)))) AS text FROM conversations), kept AS (SELECT * FROM lines WHERE text <> ''), turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM (SELECT DISTINCT conv_id, turn FROM kept)), u AS (SELECT conv_id, turn, pos, text FROM kept UNION ALL SELECT conv_id, turn, 0, '# Attachment: turn-' || lpad(turn::VARCHAR, 6, '0') || '.txt' FROM turns WHERE nth > 1) "
    "SELECT conv_id AS item_key, (row_number() OVER w - 1)::INTEGER AS block_index, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, text AS snippet FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)",
)
def item_merged_blocks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("doc_key", F.concat_ws("-", "conv_id", "turn"))
    a = turns.select("doc_key", F.col("conv_id").alias("item_key"), F.concat(F.lit("turns/turn-"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(".txt")).alias("file_path"))
    blocks = B.annotate(B.lines_as_elements(turns, "doc_key", "text"), paths=False)
    return B.merge_items(blocks, a).select("item_key", "block_index", "char_start", "snippet")


@query("fulltext", f"WITH {BLOCKS} SELECT doc_key, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS markdown FROM blk GROUP BY doc_key")
def fulltext(spark, sf_dir):
    return retrieve.fulltext(annotated(spark, sf_dir)).select("doc_key", "markdown")


# Fixed value: the boilerplate phrases of functions.heuristics, as SQL.
_BOILER = "(?i)\\b(to cite (this|the) (article|paper)|please cite|recommended citation|citation\\s*:|downloaded from|all rights reserved|copyright|creative commons|author manuscript|accepted manuscript|published online|supplementary material|supporting information|correspondence (to|should be addressed to)|preprint|this version posted)\\b"


@query(
    "fulltext_clean",
    f"WITH {BLOCKS}, f AS (SELECT *, regexp_matches(text, '{_BOILER}') AS noise FROM blk), d AS (SELECT *, row_number() OVER (PARTITION BY doc_key, noise, CASE WHEN noise THEN block_index::VARCHAR ELSE trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) END ORDER BY block_index) AS rn FROM f) SELECT doc_key, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_index) FILTER (NOT noise AND rn = 1), '') AS markdown, count(*) AS total, count(*) FILTER (NOT noise AND rn = 1) AS kept, count(*) FILTER (noise) AS boilerplate, count(*) FILTER (NOT noise AND rn > 1) AS duplicate FROM d GROUP BY doc_key",
)
def fulltext_clean(spark, sf_dir):
    return retrieve.clean_fulltext(annotated(spark, sf_dir))


@query(
    "expand_slice",
    f"WITH {BLOCKS}, md AS (SELECT doc_key, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS m FROM blk GROUP BY doc_key), c AS (SELECT doc_key, m, greatest(0, least(length(m), 700) - 200) AS b, least(length(m), least(length(m), 700) + 200) AS e FROM md) SELECT c.doc_key, any_value(b)::INTEGER AS begin, any_value(e)::INTEGER AS \"end\", any_value(substring(m, (b + 1)::BIGINT, (e - b)::BIGINT)) AS slice, min(block_index)::INTEGER AS first_block, max(block_index)::INTEGER AS last_block FROM c JOIN blk ON blk.doc_key = c.doc_key AND blk.char_start < e AND b < blk.char_end GROUP BY c.doc_key",
)
def expand_slice(spark, sf_dir):
    b = annotated(spark, sf_dir)
    return retrieve.expand(B.rendered(b), b, 700, 200).where("first_block is not null")


@query(
    "search_passages",
    _bm25({"a": _one("with")}, "len(a) > 0")
    + BEST
    + f", top AS (SELECT doc_key, block_index AS pos, score FROM best ORDER BY score DESC, doc_key LIMIT 10), {BLOCKS.removeprefix(LINES + ', ').replace('row_number() OVER w - 1 AS block_index', 'row_number() OVER w - 1 AS block_index, pos')}, md AS (SELECT doc_key, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS m FROM blk WHERE doc_key IN (SELECT doc_key FROM top) GROUP BY doc_key), anch AS (SELECT top.doc_key, score, blk.block_index, char_start + length(regexp_extract(text, '(?i)^(.*?)(?:^|[^\\pL\\pN])with(?:[^\\pL\\pN]|$)', 1)) + CASE WHEN regexp_matches(text, '(?i)^with(?:[^\\pL\\pN]|$)') THEN 0 ELSE 1 END + 2 AS o FROM top JOIN blk ON top.doc_key = blk.doc_key AND top.pos = blk.pos) SELECT anch.doc_key, anch.score, o AS char_offset, CASE WHEN o > 250 THEN '…' ELSE '' END || trim(regexp_replace(regexp_replace(substring(m, greatest(0, o - 250) + 1, least(length(m), o + 250) - greatest(0, o - 250)), '\\s*\\n+\\s*', ' ', 'g'), '[ \\t][ \\t]+', ' ', 'g')) || CASE WHEN o + 250 < length(m) THEN '…' ELSE '' END AS passage FROM anch JOIN md USING (doc_key)",
)
def search_passages(spark, sf_dir):
    # The hits, which the limit has made few, are found first: only their documents are annotated and rendered.
    found = search.search(raw_blocks(spark, sf_dir), "with").withColumnRenamed("block_index", "pos")
    found = F.broadcast(spark.createDataFrame(found.toArrow(), found.schema))
    docs = read(spark, sf_dir, "documents").join(found.select(F.col("doc_key").alias("doc_id")), "doc_id", "left_semi")
    b = B.annotate(B.lines_as_elements(docs, "doc_id", "text"), paths=False, places=True)
    hits = b.join(found, ["doc_key", "pos"]).select("doc_key", "block_index", "score")
    return search.passages(hits, b.drop("pos"), B.rendered(b), "with").select("doc_key", "score", "char_offset", "passage")


def _ranges(blocks: str) -> str:
    """CTEs ending in ranges: the narrowest block range of "of the" in each document."""
    return (
        f"t AS (SELECT doc_key, block_index, unnest(toks) AS w, unnest(range(len(toks))) AS i FROM {blocks}), o AS (SELECT doc_key, block_index, w, row_number() OVER (PARTITION BY doc_key ORDER BY block_index, i) AS p FROM t), d AS (SELECT doc_key, block_index, dense_rank() OVER (PARTITION BY doc_key ORDER BY block_index) AS k FROM (SELECT DISTINCT doc_key, block_index FROM t)), "
        "m AS (SELECT a.doc_key, a.block_index AS block_start, b.block_index AS block_end, d2.k - d1.k AS span, a.p FROM o a JOIN o b ON a.doc_key = b.doc_key AND b.p = a.p + 1 AND b.w = 'the' JOIN d d1 ON d1.doc_key = a.doc_key AND d1.block_index = a.block_index JOIN d d2 ON d2.doc_key = b.doc_key AND d2.block_index = b.block_index WHERE a.w = 'of'), "
        "ranges AS (SELECT doc_key, block_start, block_end FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY span, p) AS rn FROM m) WHERE rn = 1)"
    )


@query("search_in_exact", f"WITH {EXACT_TOKS}, {_ranges('blocks')} SELECT doc_key, block_start, block_end FROM ranges")
def search_in_exact(spark, sf_dir):
    return search.exact_ranges(raw_blocks(spark, sf_dir), "of the").select("doc_key", "block_start", "block_end")


@query(
    "search_in",
    _bm25({"a": _one("of", "the")}, "len(a) > 0")
    + rf", plain AS (SELECT doc_key, pos AS block_index, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM lines WHERE trim(text) <> ''), {_ranges('plain')}, hits AS (SELECT doc_key, block_index, score, block_index AS block_end FROM scored UNION ALL SELECT doc_key, block_start, 100.0 - (block_end - block_start), block_end FROM ranges) "
    "SELECT doc_key, block_index, score, block_end FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, block_index ORDER BY score DESC, block_end) AS rn FROM hits) WHERE rn = 1 ORDER BY score DESC, doc_key, block_index LIMIT 50",
)
def search_in(spark, sf_dir):
    return search.search_in(raw_blocks(spark, sf_dir), '"of the"', limit=50)


@query("occurrence_counts", "SELECT doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, 4) = 'thth'))::BIGINT AS n FROM documents WHERE contains(text, 'thth')")
def occurrence_counts(spark, sf_dir):
    return search.occurrence_counts(read(spark, sf_dir, "documents"), "doc_id", "text", "thth")


@query(
    "reference_like",
    f"WITH {BLOCKS}, c AS (SELECT doc_key, block_index::INTEGER AS block_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM blk) SELECT doc_key, block_index FROM c WHERE regexp_matches(t, '(?i)(available at|retrieved from|doi\\s*:|https?://)') OR regexp_matches(t, '^[\\pL\\pM''’.-]+, +(\\p{{Lu}}[\\pL\\pM''’.-]*|\\p{{Lu}}\\.)[\\s\\S]{{0,120}}\\(\\d{{4}}[a-z]?\\)') OR (regexp_matches(t, '\\(\\d{{4}}[a-z]?\\)') AND regexp_matches(t, '(?i)journal|press|vol\\.|pp\\.|isbn|issn|conference|proceedings'))",
)
def reference_like(spark, sf_dir):
    return annotated(spark, sf_dir).where("is_reference_like").select("doc_key", "block_index")


@query("boilerplate_like", f"WITH {BLOCKS} SELECT doc_key, block_index::INTEGER AS block_index FROM blk WHERE regexp_matches(text, '{_BOILER}')")
def boilerplate_like(spark, sf_dir):
    return annotated(spark, sf_dir).where(heuristics.boilerplate_like(F.col("text"))).select("doc_key", "block_index")


_DIAG = f"{LINES}, s AS (SELECT doc_key, count(*) AS blocks, avg(length(text)) AS m, median(length(text)) AS d FROM lines WHERE length(text) > 0 GROUP BY doc_key), r AS (SELECT doc_key, blocks, round(m, 1) AS avg_chars, round(d, 1) AS median_chars, CASE WHEN m < 120 OR d < 90 THEN 'suspicious' WHEN m < 180 OR d < 135 THEN 'borderline' ELSE 'ok' END AS status FROM s)"


@query("diagnose", f"WITH {_DIAG} SELECT * FROM r WHERE status <> 'ok' ORDER BY CASE status WHEN 'suspicious' THEN 0 ELSE 1 END, blocks DESC, doc_key LIMIT 50")
def diagnose_rows(spark, sf_dir):
    return diagnose.diagnose(raw_blocks(spark, sf_dir), t_mean=120.0, t_median=90.0)


@query("diagnose_summary", f"WITH {_DIAG} SELECT (SELECT count(*) FROM r) AS scanned, (SELECT count(*) FROM r WHERE status = 'suspicious') AS suspicious, (SELECT count(*) FROM r WHERE status = 'borderline') AS borderline, (SELECT count(*) FROM r WHERE status = 'ok') AS ok, (SELECT count(DISTINCT doc_id) FROM documents) - (SELECT count(*) FROM r) AS skipped")
def diagnose_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"))
    return diagnose.summary(raw_blocks(spark, sf_dir), docs, t_mean=120.0, t_median=90.0)


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: its first line the title, its whole text the abstract."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("item_key"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.array("source", F.concat_ws(" ", "lang", "source")).alias("author_search_texts"),
        (F.lit(1950) + F.pmod("doc_id", F.lit(70))).cast("string").alias("year"),
        F.col("text").alias("abstract"),
        F.lit(None).cast("string").alias("journal"),
        F.col("lang").alias("publisher"),
        (F.pmod("doc_id", F.lit(3)) > 0).alias("has_supported_file"),
    )


_BIB = "bib AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS item_key, string_split(text, chr(10))[1] AS title, source, lang, (1950 + doc_id % 70)::VARCHAR AS year, text AS abstract, doc_id % 3 > 0 AS has_supported_file FROM documents), n AS (SELECT *, trim(regexp_replace(lower(title), '[^\\pL\\pN]+', ' ', 'g')) AS nt, trim(regexp_replace(lower(abstract), '[^\\pL\\pN]+', ' ', 'g')) AS na, source || '|' || lang || ' ' || source AS au FROM bib)"


@query("metadata_search", f"WITH {_BIB}, m AS (SELECT *, contains(nt, 'that the') AS mt, contains(na, 'that the') AS ma FROM n) SELECT item_key, (CASE WHEN mt THEN 6 ELSE 0 END + CASE WHEN ma THEN 3 ELSE 0 END)::BIGINT AS score, concat_ws(',', CASE WHEN mt THEN 'title' END, CASE WHEN ma THEN 'abstract' END) AS matched_fields, has_supported_file FROM m WHERE mt OR ma")
def metadata_search(spark, sf_dir):
    return metadata.search_metadata(bibliography(spark, sf_dir), "that the", limit=None).drop("title")


@query("metadata_filters", f"WITH {_BIB} SELECT item_key, 6::BIGINT AS score, 'author,year' AS matched_fields FROM n WHERE contains(au, 'src1') AND contains(year, '198') AND has_supported_file")
def metadata_filters(spark, sf_dir):
    return metadata.search_metadata(bibliography(spark, sf_dir), filters={"author": "src1", "year": "198"}, has_file=True, limit=None).select("item_key", "score", "matched_fields")


@query("exact_normalise", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) AS t FROM documents")
def exact_normalise(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", words_only(F.col("text")).alias("t"))


@query("exclude_tagged", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_tagged(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"))
    tagged = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_key"))
    return sync.exclude(rows, tagged).select(F.col("item_key").alias("doc_id"))


@query("filter_tristate", "SELECT 'all' AS filter, count(*) AS n FROM documents UNION ALL SELECT 'none', 0 UNION ALL SELECT 'some', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_tristate(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"))
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item_key"))
    each = {"all": None, "none": good.where("false"), "some": good}
    frames = [sync.filter_items(rows, keys).agg(F.count("*").alias("n")).select(F.lit(k).alias("filter"), "n") for k, keys in each.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("tags_all", "SELECT doc_id AS item_key FROM labels WHERE quality = 1 AND toxic = 1 GROUP BY doc_id")
def tags_all(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    tags = labels.where("quality = 1").select(F.col("doc_id").alias("item_key"), F.lit("good").alias("tag")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("item_key"), F.lit("toxic").alias("tag")))
    return sync.with_all_tags(tags, ["good", " toxic"])


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("epub"), F.lit("html")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), (F.col("doc_id") / 4).cast("long").alias("item_key"), ext.alias("file_ext"))


@query("prefer_format", "WITH a AS (SELECT doc_id AS doc_key, doc_id // 4 AS item_key, ['pdf', 'epub', 'html'][doc_id % 3 + 1] AS file_ext FROM documents) SELECT * FROM a WHERE NOT (file_ext = 'pdf' AND item_key IN (SELECT item_key FROM a WHERE file_ext = 'epub'))")
def prefer_format(spark, sf_dir):
    return sync.prefer(attachments(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Previous and next catalog: by doc_id modulo 10, 1 is removed, 2 renamed, 3 changed, 4 in error before, 5 added."""
    k = F.pmod("doc_id", F.lit(10))
    base = read(spark, sf_dir, "documents").withColumn("k", k)
    status = F.when(F.col("k") == 4, "error").otherwise("ready")
    one = base.select(F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("doc_key"), (F.col("doc_id") / 3).cast("long").alias("item_key"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ms"), status.alias("extract_status"), F.col("source").alias("title"), "k")
    previous = one.where("k <> 5").drop("k")
    moved = F.when(F.col("k") == 2, F.sha1(F.concat(F.col("doc_key"), F.lit("-new")).cast("binary"))).otherwise(F.col("doc_key"))
    next_ = one.where("k <> 1").withColumn("doc_key", moved).withColumn("size", F.col("size") + (F.col("k") == 3).cast("int")).drop("k")
    return previous, next_


_SNAP = "base AS (SELECT *, doc_id % 10 AS k, sha1(doc_id::VARCHAR) AS key0 FROM documents), prev AS (SELECT key0 AS doc_key, doc_id // 3 AS item_key, n_chars AS size, doc_id AS mtime_ms, CASE WHEN k = 4 THEN 'error' ELSE 'ready' END AS extract_status, source AS title FROM base WHERE k <> 5), nxt AS (SELECT CASE WHEN k = 2 THEN sha1(key0 || '-new') ELSE key0 END AS doc_key, doc_id // 3 AS item_key, n_chars + (k = 3)::INT AS size, doc_id AS mtime_ms, CASE WHEN k = 4 THEN 'error' ELSE 'ready' END AS extract_status, source AS title FROM base WHERE k <> 1)"


@query("catalog_counts", f"WITH {_SNAP} SELECT count(*) AS total, count(*) AS supported, count(*) FILTER (extract_status = 'ready') AS ready, 0::BIGINT AS missing, 0::BIGINT AS unsupported, count(*) FILTER (extract_status = 'error') AS error FROM prev")
def catalog_counts(spark, sf_dir):
    return sync.catalog_counts(snapshots(spark, sf_dir)[0].withColumn("supported", F.lit(True)))


@query("rename_migration", f"WITH {_SNAP} SELECT p.doc_key AS old_key, n.doc_key AS new_key FROM prev p JOIN nxt n USING (item_key, size, mtime_ms) WHERE p.extract_status = 'ready' AND p.doc_key NOT IN (SELECT doc_key FROM nxt) AND n.doc_key NOT IN (SELECT doc_key FROM prev)")
def rename_migration(spark, sf_dir):
    return sync.renames(*snapshots(spark, sf_dir))


@query("snapshot_diff", f"WITH {_SNAP} SELECT coalesce(p.doc_key, n.doc_key) AS doc_key, CASE WHEN p.doc_key IS NULL THEN 'added' WHEN n.doc_key IS NULL THEN 'removed' WHEN p.size = n.size AND p.extract_status = n.extract_status THEN 'unchanged' ELSE 'changed' END AS state FROM prev p FULL JOIN nxt n ON p.doc_key = n.doc_key")
def snapshot_diff(spark, sf_dir):
    return sync.unchanged(*snapshots(spark, sf_dir))


@query(
    "sync_run",
    f"WITH {_SNAP} SELECT CASE WHEN k = 2 THEN sha1(key0 || '-new') ELSE key0 END AS doc_key, CASE WHEN k = 2 THEN 'adopt-then-extract' WHEN k = 4 THEN 'skip-unchanged-error' WHEN k IN (3, 5) OR doc_id % 11 = 0 THEN 'extract' ELSE 'reuse' END AS action, CASE WHEN k NOT IN (2, 3, 4, 5) AND doc_id % 11 <> 0 THEN TRUE END AS carry FROM base WHERE k <> 1 "
    "UNION ALL SELECT key0, 'sweep', NULL FROM base WHERE k IN (1, 2) AND doc_id % 11 <> 0",
)
def sync_run(spark, sf_dir):
    """The outcomes of a whole run's plan, and the artifacts it sweeps; every eleventh document has lost its artifact."""
    previous, next_ = snapshots(spark, sf_dir)
    files = next_.select("doc_key", "item_key", F.lit("txt").alias("file_ext"), F.lit(True).alias("supported"), F.lit(True).alias("file_exists"), "size", "mtime_ms")
    yes = F.lit(True)
    stored = previous.where("extract_status = 'ready' and mtime_ms % 11 <> 0")
    artifacts = stored.select("doc_key", *[yes.alias(c) for c in ("manifest_exists", "normalized_exists", "manifest_readable", "identity_matches", "vertical_matches")], F.lit(False).alias("normalized_empty"), F.lit(1).alias("n_blocks"))
    p = run_plan.plan(previous.withColumn("error", F.lit(None).cast("string")), files, artifacts, completed=True)
    swept = p.sweep.where("kind = 'orphan'").select("doc_key", F.lit("sweep").alias("action"), F.lit(None).cast("boolean").alias("carry"))
    return p.outcomes.select("doc_key", "action", "carry").unionByName(swept)


@query("changed_ready", f"WITH {_SNAP} SELECT doc_key FROM prev WHERE extract_status = 'ready' AND doc_key NOT IN (SELECT doc_key FROM nxt WHERE extract_status = 'ready')")
def changed_ready(spark, sf_dir):
    return sync.dropped_ready(*snapshots(spark, sf_dir))


@query("stale_orphans", f"WITH {_SNAP} SELECT doc_key, 'stale' AS kind FROM nxt WHERE doc_key NOT IN (SELECT doc_key FROM nxt WHERE mtime_ms % 7 <> 0) UNION ALL SELECT doc_key, 'orphan' FROM prev WHERE doc_key NOT IN (SELECT doc_key FROM nxt)")
def stale_orphans(spark, sf_dir):
    previous, next_ = snapshots(spark, sf_dir)
    return sync.sweep(next_, next_.where("mtime_ms % 7 <> 0"), previous)


FACTS = ("supported", "file_exists", "is_pdf", "size_mtime_unchanged", "artifacts_reusable", "artifact_pair_present", "previous_catalog_completed", "retry_errors", "has_rename_candidate")


def _bit(i: int) -> F:
    return F.shiftright(F.col("event_id"), i).bitwiseAND(F.lit(1)) == 1


@query(
    "triage",
    "WITH f AS (SELECT event_id, "
    + ", ".join(f"(event_id >> {i}) & 1 = 1 AS {f}" for i, f in enumerate(FACTS))
    + ", ['never', 'ready', 'error', 'missing'][((event_id >> 9) & 3) + 1] AS was FROM events), u AS (SELECT *, was = 'ready' AND size_mtime_unchanged AND (CASE WHEN previous_catalog_completed AND NOT is_pdf THEN artifact_pair_present ELSE artifacts_reusable END) AS same FROM f), a AS (SELECT event_id, same, CASE WHEN NOT supported THEN 'record-unsupported' WHEN NOT file_exists THEN 'record-missing' WHEN was = 'error' AND size_mtime_unchanged AND NOT artifacts_reusable AND NOT retry_errors THEN 'skip-unchanged-error' WHEN was = 'never' AND NOT artifacts_reusable AND has_rename_candidate THEN 'adopt-then-extract' WHEN NOT same AND ((was = 'ready' AND NOT size_mtime_unchanged) OR NOT artifacts_reusable) THEN 'extract' ELSE 'reuse' END AS action FROM u) SELECT event_id, action, CASE WHEN action = 'reuse' THEN same END AS carry FROM a",
)
def triage(spark, sf_dir):
    was = F.element_at(F.array(F.lit(None).cast("string"), F.lit("ready"), F.lit("error"), F.lit("missing")), (F.shiftright("event_id", 9).bitwiseAND(F.lit(3)) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", *[_bit(i).alias(f) for i, f in enumerate(FACTS)], was.alias("previous_status"))
    return rows.select("event_id", sync.triage().alias("t")).select("event_id", "t.action", "t.carry")


REUSE = ("manifest_exists", "normalized_exists", "normalized_empty", "manifest_readable", "has_blocks", "identity_matches", "vertical_matches")


@query(
    "reuse_verdict",
    "WITH f AS (SELECT event_id, " + ", ".join(f"(event_id >> {i}) & 1 = 1 AS {f}" for i, f in enumerate(REUSE)) + " FROM events) SELECT event_id, CASE WHEN NOT manifest_exists OR NOT normalized_exists THEN 'missing' WHEN normalized_empty THEN 'empty-normalized' WHEN NOT manifest_readable THEN 'unreadable' WHEN NOT has_blocks THEN 'no-blocks' WHEN NOT identity_matches THEN 'identity-mismatch' WHEN NOT vertical_matches THEN 'vertical-mismatch' ELSE 'reusable' END AS verdict FROM f",
)
def reuse_verdict(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", *[_bit(i).alias(f) for i, f in enumerate(REUSE)]).withColumn("n_blocks", F.col("has_blocks").cast("int"))
    return rows.select("event_id", sync.reuse_verdict().alias("verdict"))


@query("context_diff", "WITH d AS (SELECT doc_id AS doc_key, source AS c FROM documents WHERE doc_id % 5 <> 0), s AS (SELECT doc_id AS doc_key, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE source END AS c FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(d.doc_key, s.doc_key) AS doc_key, CASE WHEN d.doc_key IS NULL THEN 'remove' WHEN d.c IS NOT DISTINCT FROM s.c THEN 'keep' ELSE 'write' END AS action FROM d FULL JOIN s ON d.doc_key = s.doc_key")
def context_diff(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("source").alias("context"))
    stored = docs.where("doc_key % 3 <> 0").withColumn("context", F.when(F.col("doc_key") % 7 == 0, "old").otherwise(F.col("context")))
    return sync.context_changes(docs.where("doc_key % 5 <> 0"), stored)


@query("alias_migration", "WITH v AS (SELECT (vec_id // 2)::VARCHAR AS hash, label AS seq, CASE WHEN vec_id % 3 = 0 THEN 'new' WHEN vec_id % 3 = 1 THEN 'old' ELSE 'other' END AS model, vec_id FROM embeddings) SELECT hash, seq, CASE WHEN model = 'old' THEN 'new' ELSE model END AS model, vec_id FROM v WHERE NOT (model = 'old' AND (hash, seq) IN (SELECT (hash, seq) FROM v WHERE model = 'new'))")
def alias_migration(spark, sf_dir):
    k = F.pmod("vec_id", F.lit(3))
    v = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 2).cast("long").cast("string").alias("hash"), F.col("label").alias("seq"), F.when(k == 0, "new").when(k == 1, "old").otherwise("other").alias("model"), "vec_id")
    return vectors.migrate_alias(v, "old", "new")


@query("orphan_cleanup", "SELECT vec_id FROM embeddings WHERE vec_id // 3 IN (SELECT doc_id // 2 FROM documents WHERE doc_id % 4 <> 0) AND vec_id // 3 % 2 = 0")
def orphan_cleanup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") / 2).cast("long").alias("hash"), (F.col("doc_id") % 4 != 0).alias("active"))
    vecs = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("long").alias("hash"), "vec_id")
    content = vecs.select("hash").where("hash % 2 = 0").distinct()
    return vectors.without_orphans(docs, content, vecs)[2].select("vec_id")


@query("vector_topk", "SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id)::INTEGER AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 20")
def vector_topk(spark, sf_dir):
    """Every row whose id is divisible by 100 asks for its nearest among all rows."""
    rows = read(spark, sf_dir, "embeddings")
    targets = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))
    return vectors.top_k_batch(rows, "vec_id", "embedding", targets, 20)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as those of chunks of 300 characters, four a document."""
    rows = read(spark, sf_dir, "embeddings")
    seq = F.pmod("vec_id", F.lit(4))
    return rows.select((F.col("vec_id") / 4).cast("long").alias("doc_key"), seq.alias("seq"), (300 * seq).alias("pos"), F.lit(300).alias("len"), "embedding")


@query(
    "semantic_passages",
    f"WITH {BLOCKS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id // 4 AS doc_key, vec_id % 4 AS seq, 300 * (vec_id % 4) AS pos, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score FROM embeddings e, q), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, seq) AS rn FROM v WHERE doc_key IN (SELECT doc_key FROM blk)) WHERE rn = 1 ORDER BY score DESC, doc_key LIMIT 10), md AS (SELECT doc_key, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS m FROM blk WHERE doc_key IN (SELECT doc_key FROM best) GROUP BY doc_key), "
    "near AS (SELECT best.doc_key, min(block_index) FILTER (char_start < pos + 300 AND pos < char_end) AS f, max(block_index) FILTER (char_start < pos + 300 AND pos < char_end) AS l, arg_min(block_index, greatest(char_start - pos, pos - char_end, 0) * 1000000 + block_index) AS n FROM best JOIN blk ON best.doc_key = blk.doc_key GROUP BY best.doc_key) "
    "SELECT best.doc_key, score, coalesce(f, n)::INTEGER AS block_start, coalesce(l, n)::INTEGER AS block_end, pos + 150 AS char_offset, CASE WHEN pos - 100 > 0 THEN '…' ELSE '' END || trim(regexp_replace(regexp_replace(substring(m, greatest(0, pos - 100) + 1, greatest(0, least(length(m), pos + 400) - greatest(0, pos - 100))), '\\s*\\n+\\s*', ' ', 'g'), '[ \\t][ \\t]+', ' ', 'g')) || CASE WHEN pos + 400 < length(m) THEN '…' ELSE '' END AS passage FROM best JOIN md ON md.doc_key = best.doc_key JOIN near ON near.doc_key = best.doc_key",
)
def semantic_passages(spark, sf_dir):
    target = read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    b = annotated(spark, sf_dir)
    return semantic.search(chunk_vectors(spark, sf_dir), b, B.rendered(b), target, 10)


@query(
    "chunk_to_blocks",
    f"WITH {BLOCKS}, sz AS (SELECT doc_key, max(char_end) AS z FROM blk GROUP BY doc_key), ch AS (SELECT doc_key, unnest(range(0, z, 400)) AS pos FROM sz) SELECT ch.doc_key, (pos // 400)::BIGINT AS seq, min(block_index)::INTEGER AS block_start, max(block_index)::INTEGER AS block_end FROM ch JOIN blk ON blk.doc_key = ch.doc_key AND char_start < pos + 400 AND pos < char_end GROUP BY ch.doc_key, pos",
)
def chunk_to_blocks(spark, sf_dir):
    b = annotated(spark, sf_dir)
    size = b.groupBy("doc_key").agg(F.max("char_end").alias("z"))
    chunks = size.select("doc_key", F.explode(F.sequence(F.lit(0), F.col("z") - 1, F.lit(400))).alias("pos")).select("doc_key", (F.col("pos") / 400).cast("long").alias("seq"), "pos", F.lit(400).alias("len"))
    return vectors.chunk_ranges(chunks, b)


@query("recent_items", "SELECT printf('%08d', doc_id) AS item_key, source AS title, lang || ' ' || source AS authors, (1950 + doc_id % 70)::VARCHAR AS year, CASE doc_id % 5 WHEN 0 THEN 'book' WHEN 2 THEN 'thesis' WHEN 4 THEN 'webpage' END AS type FROM documents WHERE doc_id % 5 NOT IN (1, 3) ORDER BY doc_id * 7919 % 100003 DESC, doc_id LIMIT 100")
def recent_items(spark, sf_dir):
    """Library items made of documents; notes and attachments among them do not count."""
    k = F.pmod("doc_id", F.lit(5))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("book", "note", "thesis", "attachment", "webpage")]), (k + 1).cast("int"))
    creator = F.struct(F.lit(None).cast("string").alias("name"), F.col("lang").alias("firstName"), F.col("source").alias("lastName"))
    when = F.lpad(F.pmod(F.col("doc_id") * 7919, F.lit(100003)).cast("string"), 6, "0")
    year = (F.lit(1950) + F.pmod("doc_id", F.lit(70))).cast("string")
    data = F.struct(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"), F.col("source").alias("title"), F.array(creator).alias("creators"), F.concat(F.lit("c. "), year).alias("date"), kind.alias("itemType"), when.alias("dateAdded"), when.alias("dateModified"))
    items = read(spark, sf_dir, "documents").select(data.alias("data"), F.struct(F.lit(None).cast("string").alias("parsedDate")).alias("meta"))
    return papers.newest(items, 100).select("item_key", "title", F.array_join("authors", ";").alias("authors"), "year", "type")


@query("key_conflicts", "SELECT source AS citation_key, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS item_key, string_agg(DISTINCT lang, ',' ORDER BY lang) AS item_keys FROM documents GROUP BY source")
def key_conflicts(spark, sf_dir):
    return sync.key_conflicts(read(spark, sf_dir, "documents").select(F.col("source").alias("citation_key"), F.col("lang").alias("item_key")))


@query("distinct_segments", "SELECT label AS model, count(DISTINCT (vec_id // 3, vec_id % 2)) AS segments FROM embeddings GROUP BY label")
def distinct_segments(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("long").alias("hash"), F.pmod("vec_id", F.lit(2)).alias("seq"), F.col("label").alias("model"))
    return vectors.distinct_segments(v, "model")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    from .sources.markup import markdown_of_html

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_key"), markdown_of_html(F.col("html")).alias("markdown"))
    return B.annotate(B.markdown_elements(pages, "doc_key", "markdown")).select("doc_key", "block_index", "block_type", "heading_level", "text", F.array_join("section_path", " / ", "").alias("path"))


@query("file_types", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches(url, '(?i)\\.epub$') THEN 'epub' WHEN regexp_matches(url, '(?i)\\.html?$') THEN 'html' WHEN regexp_matches(url, '(?i)\\.txt$') THEN 'txt' ELSE 'other' END AS kind FROM pages")
def file_types(spark, sf_dir):
    from .sources.bibliography import file_type

    return read(spark, sf_dir, "pages").select("page_id", file_type(F.col("url")).alias("kind"))


@query("doc_keys", "WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'sub/' ELSE '' END || 'f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.odd' END AS f FROM pages WHERE page_id % 7 <> 0) SELECT page_id, sha1(f) AS doc_key, f AS file_path, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'other' END AS file_ext, page_id % 2 = 0 AS supported FROM p")
def doc_keys(spark, sf_dir):
    """Files of a bibliography: every seventh lies outside the root, and each is named twice."""
    from .sources.bibliography import attachments as files_of

    n = F.col("page_id")
    path = F.concat(F.when(n % 7 == 0, "/elsewhere/").otherwise("/root/lib/"), F.when(n % 3 == 0, "sub/").otherwise(""), F.lit("f"), n.cast("string"), F.when(n % 2 == 0, ".pdf").otherwise(".odd"))
    none = F.lit(None).cast("string")
    records = read(spark, sf_dir, "pages").select(n.cast("string").alias("item_key"), none.alias("citation_key"), none.alias("title"), F.array().cast("array<string>").alias("authors"), none.alias("year"), none.alias("abstract"), none.alias("type"), F.array(path, path).alias("attachment_paths"))
    return files_of(records, "/root/lib").select(F.col("item_key").cast("long").alias("page_id"), "doc_key", "file_path", "file_ext", "supported")


@query("short_titles", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ': ' || lang WHEN doc_id % 3 = 1 THEN source || '-' || lang ELSE source || ' - ' || lang END AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS short FROM t JOIN documents USING (doc_id)")
def short_titles(spark, sf_dir):
    from .functions.items import short_title

    k = F.pmod("doc_id", F.lit(3))
    sep = F.when(k == 0, ": ").when(k == 1, "-").otherwise(" - ")
    return read(spark, sf_dir, "documents").select("doc_id", short_title(F.concat("source", sep, "lang")).alias("short"))


@query("years", "SELECT o_orderkey, regexp_extract(o_orderdate::VARCHAR, '\\d{4}') AS year FROM orders")
def years(spark, sf_dir):
    from .functions.items import year_of

    return read(spark, sf_dir, "orders").select("o_orderkey", year_of(F.lit(None).cast("string"), F.col("o_orderdate").cast("string")).alias("year"))


@query("sections", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) SELECT doc_id AS doc_key, count(*) FILTER (trim(line) <> '' AND p % 5 = 1) AS headings, count(*) FILTER (trim(line) <> '' AND p % 5 <> 1) AS below FROM l GROUP BY doc_id")
def sections(spark, sf_dir):
    e = elements(spark, sf_dir)
    head = F.pmod("pos", F.lit(5)) == 0
    e = e.withColumn("block_type", F.when(head, "heading").otherwise("paragraph")).withColumn("heading_level", F.when(head, F.pmod(F.col("pos") / 5, F.lit(3)).cast("int") + 1))
    full = not_blank(F.col("text"))
    return B.section_paths(e).groupBy("doc_key").agg(F.count_if(full & (F.col("block_type") == "heading")).alias("headings"), F.count_if(full & (F.col("block_type") != "heading")).alias("below"))
