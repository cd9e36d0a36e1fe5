"""Secret scans (operator 1, native): fixed patterns, and character Markov models beside them.

Base finds are the leftmost matches of three patterns. The method adds runs of CANDIDATE characters
whose log-likelihood ratio under two first-order character models, random strings against ordinary
identifiers, is at least MIN_TOTAL in all and MIN_EACH a step, and that no base find overlaps. Both
models are trained from labelled samples by counting character pairs in a DataFrame, the ordinary one
also from the words of all documents; the table of the 67 x 67 log ratios, whose size does not depend on
the data, goes into the plan as a literal.

Offsets are code points, ends exclusive. Null and empty texts have no spans, and an empty table gives no rows;
without any document the models rest on the samples alone. Repeated rows and ids are scanned and returned each.
Long texts are scanned whole: a run is split into its characters once, and places are sums over blocks of matches,
so time grows with the length. Finds that start alike are told apart by kind. Columns other than doc_id and
text are not read, whatever their names. All is built of Spark's own expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import once

#: The kinds in the order in which equal starts are listed, their patterns (letters of the
#: assignment's keyword in either case), and how long the group named must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGNED = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
MIN_EACH, MIN_TOTAL = 0.6, 20.0

#: Ordinary words of identifiers, from which the negative samples are put together.
IDENTIFIER_WORDS = (
    "account action address admin amount application archive array attribute backup balance batch binary body "
    "border branch buffer button cache callback category channel character child client collection column command "
    "comment commit config connection content context control counter country create currency current database "
    "date decode default delete description destination device digest directory display document domain download "
    "dynamic element email enable encode entry error event example execute export extension factory field file "
    "filter final finish folder format function gateway global group handler header height history identifier "
    "image import index input instance integer interface internal invoice item iterator label language layout "
    "length level library license limit listener local location logger manager mapping master maximum memory "
    "message method minimum module monitor number object offset operation option order output package page "
    "parameter parent parser partition password path pattern payload payment pending permission picture pipeline "
    "platform pointer position prefix previous primary process product profile project property protocol provider "
    "public query queue random record reference region register release remote report request resource response "
    "result schema script search secret section segment selection sequence server service session setting shipping "
    "source status storage stream string structure subject submit summary support system table target template "
    "temporary terminal thread timeout timestamp title token transaction transfer update upload utility validate "
    "value variable version viewport visible warning website widget window worker"
).split()


def default_samples(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """value, label: 1 for random strings (hashes written in several alphabets), 0 for identifiers put
    together from words, numbers and separators. n of each; deterministic."""
    ids = spark.range(n)
    pick = lambda salt, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    random = F.element_at(F.array(base64, F.substring(digest, 1, 40), F.upper(F.translate(base64, "+/=", "xyz")), F.translate(base64, "+/", "-_")), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    a, b, c = (pick(k, IDENTIFIER_WORDS) for k in (1, 2, 3))
    number = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10_000_000_000)).cast("string")
    written = F.array(F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(a, b, c), F.concat_ws("/", a, b, c), F.upper(F.concat_ws("_", a, b)), F.concat_ws("_", a, b, number), F.concat(number, number), F.concat_ws("-", F.lit("2024"), F.substring(number, 1, 2), F.substring(number, 3, 2)))
    ordinary = F.element_at(written, (F.pmod("id", F.lit(9)) + 1).cast("int"))
    return ids.select(random.alias("value"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("value"), F.lit(0).alias("label")))


def _steps(value: Column, f) -> Column:
    """f(state, next state) of all neighbours in a string, whose characters are split once."""
    states = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.greatest(F.length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(states, F.lit(1), n), F.slice(states, F.lit(2), n), f)


#: Fixed value: the corpus weighs at most so many character pairs in the negative model. All its pairs are counted;
#: the weight keeps separators and digits of identifiers, and the smoothing, as likely however much text there is.
CORPUS_WEIGHT = 500_000
#: Ordinary words: letters in any script, the first of either case.
CORPUS_WORD = r"(?<![\p{L}\p{N}])\p{Lu}?\p{Ll}+(?![\p{L}\p{N}])"


def pair_counts(samples: DataFrame) -> np.ndarray:
    """How often each state follows each, by label. Equal strings are counted first, then pairs; both aggregates
    combine before they shuffle, and at most a table of all states comes to the driver."""
    strings = samples.where(F.length("value") > 1).groupBy("value", "label").agg(F.count("*").alias("times"))
    pairs = strings.select("label", "times", F.explode(_steps(F.col("value"), lambda a, b: a * STATES + b)).alias("pair"))
    counts = np.zeros((2, STATES, STATES))
    for label, pair, n in pairs.groupBy("label", "pair").agg(F.sum("times").alias("n")).collect():
        counts[label, pair // STATES, pair % STATES] += n
    return counts


def corpus_words(docs: DataFrame) -> DataFrame:
    """Negative samples in the corpus's own languages: the words of all documents."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CORPUS_WORD), F.lit(0))
    return docs.select(F.explode(words).alias("value"), F.lit(0).alias("label"))


def train(samples: DataFrame, corpus: DataFrame | None = None) -> np.ndarray:
    """Log ratios of the next character's probability, random over ordinary, by state and next state
    (add-one smoothing). Needs at least one sample; unseen pairs keep the smoothed ratio."""
    counts = 0.5 + pair_counts(samples)
    if corpus is not None:
        found = pair_counts(corpus)
        counts += found * min(1.0, CORPUS_WEIGHT / max(1.0, found.sum()))
    p = counts / counts.sum(axis=2, keepdims=True)
    return np.log(p[1] / p[0])


#: Matches of one block of the prefix sums.
BLOCK = 64


def _lengths(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Structs (step, size, kept) of the leftmost matches: code points from the last match's end to this one's end,
    and of the match. What stands between the matches gives the steps."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), (keep if keep is not None else F.transform(hits, lambda _: F.lit(True))).alias("kept"))
    found = F.transform(rows, lambda r: F.struct((F.length(r["gap"]) + F.length(r["hit"])).alias("step"), F.length(r["hit"]).alias("size"), r["kept"].alias("kept")))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<step:int,size:int,kept:boolean>>"))


def _sum(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0), lambda acc, x: acc + of(x))


def _with_places(d: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """d, whose column of each kind holds _lengths, with spans in its place: structs (begin, rank, end), kept ones
    only. Sums go by blocks of matches, and columns a lambda reads are evaluated once."""
    blocks = lambda k: F.sequence(F.lit(0), F.floor(F.size(k) / BLOCK).cast("int"))

    def sums(k: str) -> Column:
        return F.transform(blocks(k), lambda b: _sum(F.slice(k, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x["step"]))

    def ahead(k: str) -> Column:
        return F.transform(blocks(k), lambda b: _sum(F.slice(f"{k}_sums", F.lit(1), b), lambda x: x))

    d = once(d, **{f"{k}_sums": sums(k) for k in kinds})
    d = once(d, **{f"{k}_ahead": ahead(k) for k in kinds})

    def placed(kind: str) -> Column:
        def span(x, i):
            block = F.floor(i / BLOCK).cast("int")
            end = F.get(f"{kind}_ahead", block) + _sum(F.slice(kind, block * BLOCK + 1, i % BLOCK), lambda y: y["step"]) + x["step"]
            return F.when(x["kept"], F.struct((end - x["size"]).alias("begin"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end")))

        return F.array_compact(F.transform(kind, span))

    return d.select(*[c for c in d.columns if c not in kinds and not c.endswith(("_sums", "_ahead"))], *[placed(k).alias(k) for k in kinds])


def score(value: Column, table: np.ndarray) -> Column:
    """Log-likelihood ratio of a string, summed over its steps; 0 of a string of fewer than two characters."""
    ratios = F.lit(np.round(table, 6).ravel())
    return F.aggregate(_steps(value, lambda a, b: F.get(ratios, a * STATES + b)), F.lit(0.0), lambda acc, x: acc + x)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, text, base and spans (arrays of begin, rank of the kind, end, sorted)."""
    table = train(samples) if samples is not None else train(default_samples(docs.sparkSession), corpus_words(docs))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    assigned = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_ASSIGNED)
    candidates = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    verdict = lambda v: score(v, table) >= F.greatest(F.lit(MIN_TOTAL), MIN_EACH * F.length(v))
    found = (_lengths(text, ASSIGN, assigned), _lengths(text, ACCESS), _lengths(text, HEX), _lengths(text, CANDIDATE, F.transform(candidates, verdict)))
    d = _with_places(once(d, **dict(zip(KINDS, found, strict=True))))
    d = once(d, base=F.array_sort(F.concat("assign", "access", "hex")))
    fresh = F.filter("markov", lambda x: ~F.exists("base", lambda b: (b["begin"] < x["end"]) & (x["begin"] < b["end"])))
    return d.select("doc_id", "text", "base", F.array_sort(F.concat("base", fresh)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans; one row a row of docs."""
    found = find_secrets(docs, samples)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
