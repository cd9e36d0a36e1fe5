"""Steps that most texts pass by, or that see only few of the words."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import heuristics, porter
from textquarry.functions import text as T
from textquarry.operators import search
from textquarry.plans.query import Phrase


def test_long_runs_of_blanks_are_cleaned_in_linear_time(spark):
    gap = " " * 300_000
    df = spark.createDataFrame([(f"a{gap}b",), (f"a{gap}b\n{gap}c{gap}\nd ",)], "x string")
    began = time.monotonic()
    assert [r[0] for r in df.select(T.clean_text(F.col("x"))).collect()] == [f"a{gap}b", f"a{gap}b\n{gap}c\nd"]
    assert time.monotonic() - began < 10


def test_every_boilerplate_phrase_is_hinted():
    for phrase in (*heuristics.BOILERPLATE_PHRASES, "contents", "table of contents", "page 1 of 2"):
        assert any(h in phrase for h in heuristics.BOILERPLATE_HINTS), phrase


def test_words_begin_with_the_least_prefix_of_their_stem():
    for w in ("ability", "conflating", "vietnamization", "happy", "possibly", "rebelled", "ofs", "sensibiliti", "hopefulness", "generally", "with", "caresses"):
        s = porter.stem(w)
        assert all(w.startswith(porter.least_prefix(s[:k])) for k in range(1, len(s) + 1)), w


def test_only_words_that_can_match_are_stemmed(spark):
    df = spark.createDataFrame([(1, 0, "of the others the runners ran"), (2, 0, "nothing here")], "doc_key long, block_index int, text string")
    rows = search.placed(df, [Phrase(("runner",)), Phrase(("of", "the"))]).orderBy("doc_key").collect()
    assert [(r.n_tokens, r["__p0"], r["__p1"]) for r in rows] == [(6, [4], [0]), (2, [], [])]


def test_stems_kept_in_a_worker_are_bounded():
    words = pa.array([[f"w{i}ing" for i in range(porter.KEPT + 10)], None, [], ["runs", None]])
    got = porter.stem_all.func(words)
    assert got.slice(1).to_pylist() == [None, [], ["run", None]]
    assert len(porter._kept) <= porter.KEPT
