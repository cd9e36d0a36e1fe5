"""Stemming without Python: the stemmer over lines of words, and the words that have a stem."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry import queries, registry  # noqa: F401
from textquarry.functions import porter
from textquarry.operators import search
from textquarry.plans.query import Phrase
from tests.comparing import connection, same
from tests.test_oracles import SF

PARTS = ["a", "e", "i", "o", "u", "y", "b", "l", "s", "t", "m", "z", "n", "w", "x", "1", "\u00e9", "\u66f8", "iz", "tt", "yyy"]
ENDS = [*porter.STEP2, *porter.STEP3, *porter.STEP4, "s", "d", "ed", "ing", "eed", "y", "e", "ll", "es", "ies", "sses", ""]


def made_up(n: int) -> list[str]:
    dice = random.Random(5)
    made = {"".join(dice.choices(PARTS, k=dice.randint(1, 4)) + dice.choices(ENDS, k=dice.randint(0, 3))) for _ in range(n)}
    return sorted(made | {"a" * 63 + "s", "a" * 64 + "s", "ay", "ays", "is", "y"})


def test_lines_are_stemmed_as_words_are(spark):
    words = made_up(20_000)
    lines = [words[i : i + 50] for i in range(0, len(words), 50)]
    got = spark.createDataFrame([(i, w) for i, w in enumerate([*lines, [], None])], "i int, w array<string>").orderBy("i").select(porter.stems(F.col("w"))).collect()
    assert [r[0] for r in got] == [*[[porter.stem(w) for w in line] for line in lines], [], None]


def test_words_of_a_stem_are_all_found():
    words = [w for w in made_up(300) if len(w) < 12]
    for w in words[::3]:
        assert w in porter.words_of_stem(porter.stem(w)), w
    assert all(porter.stem(w) == "abl" for w in porter.words_of_stem("abl"))
    for w in ("happy", "abilities", "hoping", "rating", "generalization"):
        for start in {w[:3], w[:4], porter.stem(w), w}:
            lost, more = porter.words_of_prefix(start)
            assert ((w.startswith(start) and w not in lost) or w in more) == porter.stem(w).startswith(start), (w, start)


def test_prefixes_are_prefixes_of_stems(spark):
    df = spark.createDataFrame([(1, 0, "happy hope hoping"), (2, 0, "it's c:\\\\d happily")], "doc_key long, block_index int, text string")
    rows = search.placed(df, [Phrase(("happi",), True), Phrase(("hopi",), True), Phrase(())]).orderBy("doc_key").collect()
    assert [(r.n_tokens, r["__p0"], r["__p1"], r["__p2"]) for r in rows] == [(3, [0], [], []), (5, [4], [], [])]


@pytest.mark.parametrize("name", ["postings_incremental", "search_passages", "kw_batch_from_index", "kw_from_index", "kw_fallback", "kw_or", "kw_folded", "kw_parentheses", "kw_stemmed"])
def test_searches_need_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["kw_batch_from_index", "kw_from_index", "block_stats"])
def test_figures_of_blocks_need_no_stems(spark, name):
    """Only postings are stemmed, which stand in a plan twice, for figures and for hits, and run once."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    each = registry.QUERIES["postings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("__words")
    assert plan.count("__words") == each * {"block_stats": 0}.get(name, 2)


def test_passages_are_of_all_blocks_that_sql_counts(spark, tmp_path):
    """Lines of tabs count as blocks, and only the documents of hits are annotated."""
    con = connection(SF)
    con.sql(f"COPY (FROM documents UNION ALL BY NAME SELECT 100000 + i AS doc_id, chr(9) || chr(10) || chr(9) AS text, 'en' AS lang, 's' AS source, 3 AS n_chars FROM range(500) t(i)) TO '{tmp_path}/documents.parquet'")
    con.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    same(registry.QUERIES["search_passages"](spark, str(tmp_path)), con, registry.ORACLES["search_passages"])
