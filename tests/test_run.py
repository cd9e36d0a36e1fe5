import gzip
import json

from pyspark.sql import functions as F

from textquarry.functions import papers as P
from textquarry.operators import run, sync
from textquarry.sources import artifacts as A

K = {n: f"{i:040x}" for i, n in enumerate("abcdefgh")}


def manifest(key, item="I", blocks=1, vertical=False):
    return {"docKey": K[key], "itemKey": item, "verticalText": vertical, "blocks": [{"blockIndex": i, "blockType": "paragraph", "text": f"t{i}", "charStart": 0, "charEnd": 2} for i in range(blocks)]}


def stored(tmp_path):
    m, n = tmp_path / "manifests", tmp_path / "normalized"
    m.mkdir()
    n.mkdir()
    for key, body in (("a", manifest("a")), ("b", manifest("b", blocks=0)), ("c", manifest("c", item="J")), ("e", manifest("e")), ("g", manifest("g")), ("h", manifest("h"))):
        (m / f"{K[key]}.json.gz").write_bytes(gzip.compress(json.dumps(body).encode()))
    (m / f"{K['d']}.json.gz").write_bytes(b"not gzip")
    for key in "abcdegh":
        (n / f"{K[key]}.md").write_text("text")
    (n / "notes.md").write_text("x")
    return str(m), str(n)


def test_artifacts_and_verdicts(spark, tmp_path):
    m, n = stored(tmp_path)
    manifests, normal = A.read_manifests(spark, m), A.read_normalized(spark, n)
    assert {r.doc_key: r.status for r in manifests.collect()}[K["d"]] == "unreadable"
    assert A.doc_keys(spark, n).count() == 7 and A.blocks_of(manifests).where(F.col("doc_key") == K["a"]).first().text == "t0"
    files = spark.createDataFrame([(K[x], "I", "pdf") for x in "abcdef"], "doc_key string, item_key string, file_ext string")
    vertical = spark.createDataFrame([("I",)], "item_key string")
    got = lambda v: {r.doc_key: r.v for r in A.facts(files, manifests, normal, v).select("doc_key", sync.reuse_verdict().alias("v")).collect()}
    assert [got(vertical.where("false"))[K[x]] for x in "abcdef"] == ["reusable", "no-blocks", "identity-mismatch", "unreadable", "reusable", "missing"]
    assert got(vertical)[K["a"]] == "vertical-mismatch"


def test_sync_run(spark, tmp_path):
    m, n = stored(tmp_path)
    schema = "doc_key string, item_key string, file_ext string, size long, mtime_ms long, extract_status string, error string, last_indexed_at string"
    previous = spark.createDataFrame([(K["a"], "I", "txt", 1, 1, "ready", None, "T"), (K["e"], "I", "txt", 1, 1, "ready", None, "T"), (K["g"], "I", "txt", 7, 7, "ready", None, "T"), (K["d"], "I", "txt", 4, 4, "error", "old", None)], schema)
    files = spark.createDataFrame([(K["a"], "I", "txt", True, True, 1, 1), (K["e"], "I", "txt", True, True, 2, 2), (K["f"], "I", "txt", True, True, 7, 7), (K["d"], "I", "txt", True, True, 4, 4), (K["b"], "I", "txt", True, False, 0, 0), (K["c"], "I", "doc", False, True, 0, 0)], "doc_key string, item_key string, file_ext string, supported boolean, file_exists boolean, size long, mtime_ms long")
    attachments = files.select("doc_key", "item_key", "file_ext").unionByName(spark.createDataFrame([(K["h"], "Z", "txt"), (K["g"], "I", "txt")], "doc_key string, item_key string, file_ext string"))
    state = A.facts(attachments, A.read_manifests(spark, m), A.read_normalized(spark, n), spark.createDataFrame([], "item_key string"))
    p = run.plan(previous, files, state.where("manifest_exists"), completed=True)
    assert {r.doc_key: (r.action, r.carry) for r in p.outcomes.collect()} == {K["a"]: ("reuse", True), K["e"]: ("extract", None), K["f"]: ("adopt-then-extract", None), K["d"]: ("skip-unchanged-error", None), K["b"]: ("record-missing", None), K["c"]: ("record-unsupported", None)}
    assert [tuple(r) for r in p.moves.collect()] == [(K["g"], K["f"])]
    assert K["h"] in {r.doc_key for r in p.sweep.where("kind = 'orphan'").collect()}
    s = run.statistics(p.outcomes).first()
    assert (s.attachments, s.reuse, s.extract, s.adopt_then_extract) == (6, 1, 1, 1)
    after = run.next_catalog(p, files, previous, spark.createDataFrame([(K["e"], None)], "doc_key string, error string"))
    assert {r.doc_key: (r.extract_status, r.last_indexed_at) for r in after.collect()} == {K["a"]: ("ready", "T"), K["e"]: ("ready", None), K["f"]: ("ready", None), K["d"]: ("error", None), K["b"]: ("missing", None), K["c"]: ("unsupported", None)}
    assert {(r.doc_key, r.state) for r in run.index_changes(p, previous, after).collect()} == {(K["e"], "changed"), (K["f"], "changed"), (K["g"], "removed")}


def test_publish_gate(spark):
    df = spark.createDataFrame([(" x", 1), (" ", 1), ("x", 0), (None, None)], "m string, n int")
    assert [r[0] for r in df.select(A.publishable(F.col("m"), F.col("n"))).collect()] == [True, False, False, False]


def test_papers(spark):
    rows = [json.dumps({"paperId": "p", "title": " T ", "authors": [{"name": "A B"}, {"name": " "}], "year": 2001, "externalIds": {"DOI": "10.1/x"}, "publicationTypes": ["Book"], "journal": {"name": ""}}), json.dumps({"title": "no id"})]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(P.paper(F.col("j"))).collect()]
    assert (got[0].title, got[0].authors, got[0].year, got[0].doi, got[0].journal) == ("T", ["A B"], "2001", "10.1/x", None) and got[1] is None
    df = spark.createDataFrame([(["Book"], None), (["Chapter"], ""), (["Book"], "J"), ([], None), (["ConferencePaper"], None)], "t array<string>, j string")
    assert [r[0] for r in df.select(P.paper_type(F.col("t"), F.col("j"))).collect()] == ["book", "bookSection", "journalArticle", None, "conferencePaper"]


def test_library_rows(spark):
    schema = "x struct<data:struct<key:string,title:string,creators:array<struct<name:string,firstName:string,lastName:string>>,date:string,itemType:string,dateAdded:string,dateModified:string>,meta:struct<parsedDate:string>>"
    item = (("K", " T ", [("Org", None, None), (None, "A", "B"), (None, None, None)], "c. 1999", "book", "d", "m"), (None,))
    r = spark.createDataFrame([(item,)], schema).select(P.recent_row(F.col("x")).alias("r")).first().r
    assert (r.title, r.authors, r.year) == ("T", ["Org", "A B"], "1999")


def test_translation(spark):
    c = spark.createDataFrame([([(None, None, "A", "B", None), ("editor", "Org", None, None, None), ("author", None, None, "One", 1), ("author", " ", None, None, None)],)], "c array<struct<creatorType:string,name:string,firstName:string,lastName:string,fieldMode:int>>")
    got = c.select(P.translated_creators(F.col("c")).alias("c")).first().c
    assert [tuple(x) for x in got] == [("author", "A", "B", None), ("editor", None, None, "Org"), ("author", None, None, "One")]
    t = spark.createDataFrame([([(" a ", 1), (" ", None)],)], "t array<struct<tag:string,type:int>>")
    assert [tuple(x) for x in t.select(P.translated_tags(F.col("t")).alias("t")).first().t] == [("a", 1)]


def test_paths_and_context(spark):
    df = spark.createDataFrame([("/home/u/a/b.c.pdf",), ("/home/u",), ("/home/user/x",)], "p string")
    assert [r[0] for r in df.select(P.compact_home(F.col("p"), "/home/u")).collect()] == ["~/a/b.c.pdf", "~", "/home/user/x"]
    assert df.select(P.file_stem(F.col("p"))).first()[0] == "b.c"
    c = spark.createDataFrame([("T", ["A", "B"], None, " "), (None, [], "1999", "abs")], "t string, a array<string>, y string, b string")
    assert [r[0] for r in c.select(P.context(*map(F.col, "tayb"))).collect()] == ["T\nA, B", "1999\nabs"]
