import pytest
from pyspark.sql import functions as F

from textquarry.operators import index, search, sync
from textquarry.streaming import ingest

FACTS = "supported boolean, file_exists boolean, is_pdf boolean, previous_status string, size_mtime_unchanged boolean, artifacts_reusable boolean, artifact_pair_present boolean, previous_catalog_completed boolean, retry_errors boolean, has_rename_candidate boolean"
T, N = True, False
TABLE = [
    ((N, T, N, None, N, N, N, N, N, N), ("record-unsupported", None)),
    ((T, N, N, "ready", T, T, T, T, N, N), ("record-missing", None)),
    ((T, T, N, "error", T, N, N, T, N, N), ("skip-unchanged-error", None)),
    ((T, T, N, "error", T, N, N, T, T, N), ("extract", None)),
    ((T, T, N, "error", T, T, T, T, N, N), ("reuse", False)),
    ((T, T, N, None, N, N, N, T, N, T), ("adopt-then-extract", None)),
    ((T, T, N, None, N, T, T, T, N, T), ("reuse", False)),
    ((T, T, N, "ready", T, N, T, T, N, N), ("reuse", True)),
    ((T, T, T, "ready", T, N, T, T, N, N), ("extract", None)),
    ((T, T, N, "ready", T, N, T, N, N, N), ("extract", None)),
    ((T, T, N, "ready", N, T, T, T, N, N), ("extract", None)),
    ((T, T, T, "ready", T, T, T, T, N, N), ("reuse", True)),
]


def test_triage_table(spark):
    rows = spark.createDataFrame([f for f, _ in TABLE], FACTS).coalesce(1).select(sync.triage().alias("t")).collect()
    assert [(r.t.action, r.t.carry) for r in rows] == [x for _, x in TABLE]


def test_index_policy():
    s, old = sync.IndexerState("m", "s"), sync.IndexerState("m", "t")
    assert sync.index_policy(s, s, True, True)["short_circuit"]
    assert not sync.index_policy(s, s, True, True, orphans=1)["short_circuit"]
    changed = sync.index_policy(s, old, True, True)
    assert changed["keyword_rebuild"] and not changed["reset_vectors"] and changed["progress_state"] == s
    reset = sync.index_policy(s, sync.IndexerState("n", "s"), True, True)
    assert reset["reset_vectors"] and reset["progress_state"] == sync.IndexerState("n", "s")
    assert not sync.index_policy(s, sync.IndexerState(None, None), False, False)["reset_vectors"]


def test_renames_need_a_single_candidate(spark):
    schema = "doc_key string, item_key string, size long, mtime_ms long, extract_status string"
    old = spark.createDataFrame([("a", "I", 1, 1, "ready"), ("b", "I", 2, 2, "ready"), ("c", "I", 2, 2, "ready"), ("d", "I", 3, 3, "error"), ("e", "I", 4, 4, "ready")], schema)
    new = spark.createDataFrame([("a2", "I", 1, 1, "ready"), ("b2", "I", 2, 2, "ready"), ("d2", "I", 3, 3, "ready"), ("e", "I", 4, 4, "ready"), ("e2", "I", 4, 4, "ready")], schema)
    assert [(r.old_key, r.new_key) for r in sync.renames(old, new).collect()] == [("a", "a2")]


def test_exclusions_report_keys_that_match_nothing(spark):
    keys, rows = spark.createDataFrame([("A",), ("Z",)], "item_key string"), spark.createDataFrame([("A",), ("B",)], "item_key string")
    assert [r[0] for r in sync.exclude(rows, keys).collect()] == ["B"]
    assert [r[0] for r in sync.unmatched_exclusions(keys, rows, rows).collect()] == ["Z"]


def test_batches():
    files = [{"path": f"p/{n}.pdf"} for n in ("a", "b", "A")] + [{"path": "p/c.pdf", "type": "book"}, {"path": "p/d.pdf", "size": 30 << 20}, {"path": "p/e.pdf"}]
    assert [[f["path"][2] for f in b] for b in sync.batches(files)] == [["a", "b"], ["A"], ["c"], ["d"], ["e"]]


def tokens(spark, docs):
    rows = spark.createDataFrame(docs, "doc_key long, block_index int, text string")
    return search.tokenised(rows)


def listed(posts):
    return sorted((r.term, r.doc_key, r.block_index, tuple(r.positions)) for r in posts.collect())


def test_incremental_postings_equal_a_rebuild(spark):
    before = [(1, 0, "a b a"), (2, 0, "b c"), (3, 0, "c d"), (4, 0, "x")]
    after = [(1, 0, "a b a"), (2, 0, "b e"), (4, 0, "x")]
    changes = spark.createDataFrame([(2, "changed"), (3, "removed"), (2, "removed"), (4, "unreadable")], "doc_key long, state string")
    old, new = index.postings(tokens(spark, before)), index.postings(tokens(spark, [(2, 0, "b e"), (4, 0, "y")]))
    assert listed(index.updated(old, new, changes)) == listed(index.postings(tokens(spark, after)))


def test_pointer_appears_last(spark, tmp_path):
    store = index.BucketStore(spark, f"file://{tmp_path}/s")
    rows = lambda n: spark.createDataFrame([(i, f"r{i}") for i in range(n)], "doc_key long, x string")
    assert store.read() is None and store.version() == 0
    store.publish(rows(30), 4)
    rows(9).write.parquet(f"{tmp_path}/s/v2")  # a crash before the pointer is written
    (tmp_path / "s/versions/.2.tmp").write_text("{")  # and one while it is
    assert store.version() == 1 and store.read().count() == 30
    assert store.publish(rows(5), 4) == 2 and store.read().count() == 5
    with pytest.raises(RuntimeError):
        store.pointer.write(2, {})


def test_updates_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    store = index.BucketStore(spark, f"file://{tmp_path}/s")
    store.publish(spark.createDataFrame([(i, "old") for i in range(60)], "doc_key long, x string"), 8)
    before = store.state()["folders"]
    changes = spark.createDataFrame([(3, "changed"), (4, "removed"), (5, "unreadable")], "doc_key long, state string")
    store.update(spark.createDataFrame([(3, "new"), (5, "not taken")], "doc_key long, x string"), changes)
    after, want = store.state()["folders"], {i: "old" for i in range(60) if i != 4} | {3: "new"}
    assert {r.doc_key: r.x for r in store.read().collect()} == want
    assert 0 < sum(before[b] != after.get(b) for b in before) <= 2
    assert store.vacuum() and {r.doc_key: r.x for r in store.read().collect()} == want and store.pointer.versions() == [2]
    assert store.compact(most_files=1) and {r.doc_key: r.x for r in store.read().collect()} == want
    assert not store.compact()


def test_stream_replaces_documents(spark, tmp_path):
    schema, source, root = "doc_id long, text string", f"{tmp_path}/in", f"file://{tmp_path}/idx"
    spark.createDataFrame([(1, "old words"), (2, "stay")], schema).write.parquet(source)
    ingest.start(spark, source, schema, root, f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(1, "new text")], schema).write.mode("append").parquet(source)
    ingest.start(spark, source, schema, root, f"{tmp_path}/cp").awaitTermination()
    stored = index.KeywordIndex(spark, root)
    assert {(r.doc_key, r.term) for r in stored.posts.read().collect()} == {(1, "new"), (1, "text"), (2, "stai")}
    assert {(r.doc_key, r.n_tokens) for r in stored.stats.read().collect()} == {(1, 2), (2, 1)}


def test_reuse_verdict_and_diff_states(spark):
    prev = spark.createDataFrame([("a", "t", 1), ("b", "t", 1), ("c", None, 1)], "doc_key string, title string, size long")
    nxt = spark.createDataFrame([("a", "t", 1), ("b", "u", 1), ("c", None, 1), ("d", "t", 1)], "doc_key string, title string, size long")
    assert {r.doc_key: r.state for r in sync.unchanged(prev, nxt).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "added"}


def test_adopted_blocks_change_only_their_key(spark):
    blocks = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "doc_key string, block_index int, text string")
    moves = spark.createDataFrame([("a", "n")], "old_key string, new_key string")
    assert {(r.doc_key, r.text) for r in sync.adopted(blocks, moves).collect()} == {("n", "x"), ("b", "y")}


def test_signature_is_stable():
    assert sync.signature({"a": "1"}) == sync.signature({"a": "1"}) != sync.signature({"a": "2"})
    assert F.col("x") is not None
