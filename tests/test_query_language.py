import sqlite3

import pytest

from textquarry.functions.porter import stem
from textquarry.operators import search
from textquarry.plans import query
from textquarry.plans.query import Near, Op, Phrase, QuerySyntaxError, parse

CORPUS = [
    "the quick brown fox jumps over the lazy dog",
    "a quick dog and a quick fox",
    "governing bodies govern the governed",
    "party secretary of the county party committee",
    "secretary party meeting notes",
    "alpha beta gamma delta epsilon",
    "alpha gamma beta",
    "beta alpha alpha alpha",
    "recruitment of recruits recruiting",
    "connections connected connecting connection",
    "numbers 1999 and 2001 in the text",
    "nothing in common here",
    "fox",
    "dog fox dog fox dog",
    "...",
    "café résumé naïve",
    "新疆是边疆",
    "疆 新 和 平 边",
    "新的疆土",
]
QUERIES = [
    "fox", "quick fox", "quick AND fox", "quick OR alpha", "fox NOT dog", '"quick brown"', '"party secretary"', "party secretary",
    "alpha NEAR/0 beta", "alpha NEAR/1 beta", "alpha NEAR/2 gamma", '"alpha beta" NEAR/1 delta', "gov*", "quick dog OR gamma",
    "alpha OR beta gamma", "alpha AND beta NOT gamma", "beta NOT delta OR fox", "dog fox", "1999", "nothing OR fox OR alpha",
    "(alpha OR fox) AND (dog OR beta)", "alpha beta NOT gamma", '"fox dog"', "missing", "fox AND missing", "connection", "connect*",
    "dog NEAR/3 fox", "alpha NEAR/1 beta NOT gamma", "新疆", '"新疆"', "边疆 OR fox", "the", "cafe", "résumé OR resume", "naive cafe", "CAFÉ NEAR/2 naïve",
]


def sqlite_hits(text, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{tokenizer}')")
    for i, x in enumerate(CORPUS):
        spaced = "".join(f" {c} " if "一" <= c <= "鿿" else c for c in x)
        con.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, spaced))
    return {i: -r for i, r in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (text,))}


def fts(x):
    """The tree as FTS5 text."""
    if isinstance(x, Phrase):
        return '"' + " ".join(x.words) + '"' + ("*" if x.prefix else "")
    if isinstance(x, Near):
        return f"NEAR({' '.join(fts(p) for p in x.phrases)}, {x.distance})"
    return f"({fts(x.left)}) {x.kind.upper()} ({fts(x.right)})"


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([(i, 0, x) for i, x in enumerate(CORPUS)], "doc_key long, block_index int, text string").cache()


@pytest.mark.parametrize("stemmed", [False, True])
def test_matches_and_scores_equal_fts5(spark, blocks, stemmed):
    plain = {f"q{i}": q for i, q in enumerate(QUERIES)}
    got = {}
    for r in search.search_batch(blocks, plain, limit=100, stemmed=stemmed).collect():
        got.setdefault(r["query"], {})[r.doc_key] = r.score
    for name, text in plain.items():
        want = sqlite_hits(fts(search.folded_query(parse(text), False).tree), "porter unicode61" if stemmed else "unicode61")
        assert set(got.get(name, {})) == set(want), text
        for doc, score in want.items():
            assert got[name][doc] == pytest.approx(score, abs=6e-5), (text, doc)


@pytest.mark.parametrize("text", ["NEAR(a b, 3)", "a NEAR b"])
def test_refused_forms(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["", "  ", "NOT x", "a AND NOT b", "AND", "a OR", "!!!"])
def test_queries_that_do_not_recover(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize(("text", "bare"), [("foo:bar", "foo bar"), ("foo-bar", "foo bar"), ("it's", "it s"), ("(a OR b) c", "a OR b c")])
def test_malformed_queries_fall_back_to_words(text, bare):
    assert parse(text) == parse(bare)


def test_near_inside_quotes_is_a_word():
    assert parse('"foo NEAR bar"').tree == Phrase(("foo", "near", "bar"))


def test_unbalanced_quote_is_closed():
    assert parse('"quick brown').tree == Phrase(("quick", "brown"))


def test_precedence():
    a, b, c = (Phrase((x,)) for x in "abc")
    assert parse("a b OR c").tree == Op("or", Op("and", a, b), c)
    assert parse("a AND b NOT c").tree == Op("and", a, Op("not", b, c))


def test_cjk_run_is_unordered_proximity():
    assert parse("党委书记").tree == Near(tuple(Phrase((x,)) for x in "党委书记"), 3)
    assert parse("党").tree == Phrase(("党",))


def test_single_phrase():
    assert query.single_phrase('"ho peter 2017"') == "ho peter 2017"
    assert query.single_phrase('"how"') is None
    assert query.single_phrase('"a b" c') is None


def test_anchors():
    assert query.anchors('"quick fox" 1999 dog*')[:2] == [("quick fox", False), ("dog", True)]
    assert query.anchors("quick fox")[0] == ("quick fox", False)
    assert ("x", False) not in query.anchors("a NOT x")


def test_stemmer_equals_sqlite():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll governing recruitment yes ion".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert {w: stem(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_traditional_characters_meet_simplified_ones(spark):
    rows = [(1, 0, "黨委書記"), (2, 0, "党委书记"), (3, 0, "plain")]
    blocks = spark.createDataFrame(rows, "doc_key long, block_index int, text string")
    for text in ("書記", "书记", '"黨委"', '"党委"'):
        assert {r.doc_key for r in search.search(blocks, text).collect()} == {1, 2}
    assert {r.doc_key for r in search.exact_ranges(blocks, "黨委書記").collect()} == {1, 2}


def test_flexible_anchors(spark):
    df = spark.createDataFrame([("x 党 委 y",), ("ab  cd",), ("A\nb",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] is not None for r in df.select(search.anchor_offset(F.col("t"), '"党委"')).collect()] == [True, False, False]
    assert [r[0] is not None for r in df.select(search.anchor_offset(F.col("t"), '"a b"')).collect()] == [False, False, True]


def exact_by_hand(blocks, phrase):
    rows = [(b, w) for b, t in blocks for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    ranks, words, best = {b: k for k, b in enumerate(dict.fromkeys(b for b, _ in rows))}, phrase.split(), None
    for p in range(len(rows) - len(words) + 1):
        if [w for _, w in rows[p : p + len(words)]] == words:
            a, z = rows[p][0], rows[p + len(words) - 1][0]
            best = min(best or (9**9,), (ranks[z] - ranks[a], p, a, z))
    return best and best[2:]


def test_exact_ranges_equal_a_plain_scan(spark):
    import random

    rng = random.Random(3)
    docs = {d: [(b, " ".join(rng.choice(["a", "b", "c", "--", "B!"]) for _ in range(rng.randrange(0, 4)))) for b in range(12)] for d in range(60)}
    df = spark.createDataFrame([(d, b, t) for d, bs in docs.items() for b, t in bs], "doc_key long, block_index int, text string").repartition(5)
    for phrase in ("a", "a b", "b c a", "a b c b a"):
        got = {r.doc_key: (r.block_start, r.block_end) for r in search.exact_ranges(df, phrase).collect()}
        assert got == {d: r for d, bs in docs.items() if (r := exact_by_hand(bs, phrase))}


def test_a_phrase_without_match_is_quick(spark):
    import time

    df = spark.createDataFrame([(1, i, f"block {i} holds some words that never match") for i in range(5_000)], "doc_key long, block_index int, text string").cache()
    df.count()
    search.exact_ranges(df, "match block zero").collect()
    began = time.monotonic()
    assert search.exact_ranges(df, "never some words").collect() == []
    assert time.monotonic() - began < 3
