from textquarry import queries, registry  # noqa: F401


def test_phrases_after_300_characters_are_found(spark, tmp_path):
    late = "words " * 100
    rows = [(1, f"title\n{late}so that the end"), (2, f"title\n{late}so that, the end"), (3, f"title\n{late}"), (4, f"says that the title\n{late}"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.item_key): (r.score, r.matched_fields) for r in registry.QUERIES["metadata_search"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, "abstract"), 2: (3, "abstract"), 4: (9, "title,abstract")}
