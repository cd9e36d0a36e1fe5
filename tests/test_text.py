import pytest
from pyspark.sql import functions as F

from textquarry.functions import heuristics as H
from textquarry.functions import text as T


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.segment_cjk, {"新疆是边疆": "新 疆 是 边 疆", "新疆is边": "新 疆 is 边", "plain text": "plain text", "a 中\n文": "a 中\n文", "": ""}),
    (T.clean_text, {"a  \nb\r\n\n\n\nc\x00 ": "a\nb\n\nc", " x ": "x", "": ""}),
    (T.exact_text, {"Ｈｅｌｌｏ, World!": "hello world", "党 委 书 记": "党委书记", "副书记 党委": "副书记 党委", "a-b_c": "a b c", "": "", "新 abc 疆 土": "新 abc 疆土"}),
    (T.reflow, {"…hyphen-\nated word\n\nnext…": "…hyphenated word next…", "中\n文": "中文", "a \t b": "a b", "…": "…"}),
    (T.compact, {"a  b\n": "a b"}),
    (T.diacritic_fold, {"café naïve Ñ": "cafe naive N", "e\u0301te\u0301 ạ": "ete a", "plain": "plain"}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text_functions(spark, k):
    f, cases = CASES[k]
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_simplified_folding(spark):
    assert apply(spark, lambda c: T.exact_text(c), ["書記", "abc"]) == ["书记", "abc"]


def test_overlapping_occurrences(spark):
    assert apply(spark, lambda c: T.occurrences(c, "aa"), ["aaaa", "b"]) == [3, 0]


def test_window(spark):
    assert apply(spark, lambda c: T.window(c, F.lit(5), 2), ["0123456789"]) == ["…3456…"]
    assert apply(spark, lambda c: T.window(c, F.lit(1), 3), ["0123"]) == ["0123"]


FLAGS = {
    "See https://example.org": (True, False),
    "Smith, John. A title (2001)": (True, False),
    "In 2001 (2001a) the journal": (True, False),
    "plain prose": (False, False),
    "All rights reserved by x": (False, True),
    "Table of Contents": (False, True),
    "page 3 of 12": (False, True),
    "citation: x": (False, True),
    "the copyrighted": (False, False),
    "": (False, False),
}


def test_flags(spark):
    assert list(zip(apply(spark, H.reference_text, list(FLAGS)), apply(spark, H.boilerplate_like, list(FLAGS)), strict=True)) == list(FLAGS.values())


def test_section_path_with_holes(spark):
    df = spark.createDataFrame([(["Intro", None, "References"],), (["Preferences"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(H.reference_section(F.col("p"))).collect()] == [True, False, False]


def test_contents_lines(spark):
    assert apply(spark, H.contents_like, ["Chapter one ........ 12", "no", "....... 4"]) == [True, False, True]


def test_long_contents_lines_take_linear_time(spark):
    import time

    texts = ["x" * 200_000, "." * 60_000, "a b " * 50_000 + "..... 7"]
    began = time.monotonic()
    assert apply(spark, H.contents_like, texts) == [False, False, True]
    assert time.monotonic() - began < 10
