from pyspark.sql import functions as F

from textquarry.operators import blocks as B
from textquarry.operators import retrieve, search


def markdown(spark):
    text = "# One\n\npara a\nline two\n\n### Deep\ntext\n\n# References\n\nSmith, J. 2001"
    return spark.createDataFrame([("d", text), ("e", ""), ("f", "  \n ")], "doc_key string, markdown string")


def test_markdown_blocks_offsets_and_paths(spark):
    rows = B.annotate(B.markdown_elements(markdown(spark), "doc_key", "markdown")).orderBy("doc_key", "block_index").collect()
    assert [(r.block_index, r.block_type, r.text) for r in rows] == [(0, "heading", "One"), (1, "paragraph", "para a\nline two"), (2, "heading", "Deep"), (3, "paragraph", "text"), (4, "heading", "References"), (5, "paragraph", "Smith, J. 2001")]
    assert rows[3].section_path == ["One", None, "Deep"]
    assert rows[5].section_path == ["References"] and rows[5].is_reference_like and not rows[1].is_reference_like
    whole = B.rendered(B.annotate(B.markdown_elements(markdown(spark), "doc_key", "markdown"))).where("doc_key = 'd'").first().markdown
    for r in rows:
        assert whole[r.char_start : r.char_end] == r.snippet
        assert r.line_start == whole[: r.char_start].count("\n") + 1


def test_manifest_prefers_elements(spark):
    e = spark.createDataFrame([("d", 0, "paragraph", None, "from elements")], "doc_key string, pos int, block_type string, heading_level int, text string")
    rows = B.manifests(markdown(spark), e).collect()
    assert [(r.doc_key, r.text) for r in rows] == [("d", "from elements")]


def test_merge_puts_a_heading_between_attachments(spark):
    e = spark.createDataFrame([("a", 0, "list item", None, "x"), ("b", 0, "paragraph", None, "y"), ("b", 1, "paragraph", None, " ")], "doc_key string, pos int, block_type string, heading_level int, text string")
    files = spark.createDataFrame([("a", "I", "p/2.pdf"), ("b", "I", "p/1.pdf"), ("c", "I", "p/0.pdf")], "doc_key string, item_key string, file_path string")
    rows = B.merge_items(B.annotate(e), files).orderBy("block_index").collect()
    assert [(r.snippet, r.char_start, r.source_doc_key) for r in rows] == [("y", 0, "b"), ("# Attachment: 2.pdf", 3, "a"), ("- x", 24, "a")]


def test_element_kinds(spark):
    df = spark.createDataFrame([("Heading",), ("list item",), ("table",)], "k string")
    assert [r[0] for r in df.select(B.element_kind(F.col("k"))).collect()] == ["heading", "list item", "table"]


def test_clean_fulltext(spark):
    lines = ["All rights reserved", "Same", "same ", "Head", "Head", "Body ..... 12"]
    kinds = ["paragraph", "paragraph", "paragraph", "heading", "heading", "paragraph"]
    e = spark.createDataFrame([("d", i, k, 1, t) for i, (k, t) in enumerate(zip(kinds, lines, strict=True))], "doc_key string, pos int, block_type string, heading_level int, text string")
    r = retrieve.clean_fulltext(B.annotate(e)).first()
    assert (r.total, r.kept, r.boilerplate, r.duplicate) == (6, 3, 2, 1)
    assert r.markdown == "Same\n\n# Head\n\n# Head"


def exact(spark, texts, phrase):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_key string, block_index int, text string")
    r = search.exact_ranges(df, phrase).first()
    return r and (r.block_start, r.block_end)


def test_exact_phrase_ranges(spark):
    assert exact(spark, ["one two", "three four"], "two three") == (0, 1)
    assert exact(spark, ["two", "", "three", "x two three y"], "two three") == (3, 3)
    assert exact(spark, ["how are you"], "ho are") is None
    assert exact(spark, ["党 委", "书记"], "党委书记") == (0, 1)
    assert exact(spark, ["nothing"], "two three") is None


def test_passage_anchors_and_midpoints(spark):
    text = "x " * 200 + "needle " + "y " * 200
    e = spark.createDataFrame([(1, text), (2, "needles only here")], "doc_id long, text string")
    b = B.annotate(B.lines_as_elements(e, "doc_id", "text"), paths=False)
    hits = search.search(b, "needle*")
    rows = {r.doc_key: r for r in search.passages(hits, b, B.rendered(b), "needle*").collect()}
    assert rows[1].char_offset == 403 and rows[1].passage.startswith("…") and "needle" in rows[1].passage
    assert rows[2].passage == "needles only here"


def test_limit_comes_before_min_score(spark):
    df = spark.createDataFrame([(i, 0, "cat " * (i + 1) + "dog") for i in range(5)] + [(9, 0, "z"), (10, 0, "y"), (11, 0, "x y"), (12, 0, "w"), (13, 0, "v"), (14, 0, "u"), (15, 0, "t")], "doc_key long, block_index int, text string")
    assert search.search(df, "cat", limit=2).count() == 2
    assert search.search(df, "cat", limit=2, min_score=99.0).count() == 0
