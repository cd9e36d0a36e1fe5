"""Whole runs over a stored corpus: previous state, files and options to artifacts, index, catalog and log."""

import pytest
from pyspark.sql import functions as F

from textquarry.commands import Corpus
from textquarry.operators import blocks as B
from textquarry.operators import run, sync
from textquarry.operators.index import KeywordIndex
from textquarry.operators.publish import ArtifactStore
from textquarry.sources.catalog import Catalog

SCHEMA = "doc_key string, item_key string, citation_key string, title string, file_path string, file_ext string, supported boolean, file_exists boolean, size long, mtime_ms long"
TEXTS = {"a": "# Head\n\nalpha beta", "b": "gamma delta", "c": "", "d": "alpha again"}


def files(spark, rows):
    """rows: key -> (item, size), all supported and there."""
    return spark.createDataFrame([(k, i, f"c{i}", k.upper(), f"/home/u/{k}.txt", "txt", True, size is not None, size or 0, size or 0) for k, (i, size) in rows.items()], SCHEMA)


class World:
    def __init__(self, spark, root, model="m", signature="s"):
        self.spark, self.asked = spark, []
        self.texts = dict(TEXTS)
        place = lambda n: f"file://{root}/{n}"
        self.sync = run.Sync(Catalog(spark, place("catalog"), "/home/u"), ArtifactStore(spark, place("artifacts")), KeywordIndex(spark, place("index")), self.extract, sync.IndexerState(model, signature))

    def extract(self, work):
        keys = sorted(r.doc_key for r in work.collect())
        self.asked.append(keys)
        good = [(k, self.texts[k]) for k in keys if k in self.texts]
        markdown = self.spark.createDataFrame(good, "doc_key string, markdown string")
        errors = self.spark.createDataFrame([(k, None if k in self.texts else "no tool") for k in keys], "doc_key string, error string")
        return B.annotate(B.markdown_elements(markdown, "doc_key", "markdown")), markdown, errors

    def states(self):
        return {r.doc_key: r.extract_status for r in self.sync.catalog.read()[0].collect()}

    def terms(self):
        return {(r.doc_key, r.term) for r in self.sync.index.posts.read().collect()}


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def test_runs_one_after_another(spark, world, tmp_path):
    one = {"a": ("I", 1), "b": ("I", 2), "c": ("J", 3), "x": ("J", 4), "m": ("J", None)}
    r = world.sync.run(files(spark, one), now="T1")
    assert world.asked == [["a", "b", "c", "x"]] and r.failed == {"c": "no text or no blocks", "x": "no tool"}
    assert world.states() == {"a": "ready", "b": "ready", "c": "error", "x": "error", "m": "missing"}
    assert ("a", "alpha") in world.terms() and r.policy["keyword_rebuild"]
    assert "## Extracted (4)" in r.log and "- x: no tool" in r.log and "## Missing (1)" in r.log

    r = world.sync.run(files(spark, one), now="T2")  # nothing new: errors wait
    assert world.asked[1:] == [[]] and r.policy["short_circuit"] and r.counts["skip_unchanged_error"] == 2
    assert {x.last_indexed_at for x in world.sync.catalog.read()[0].where("extract_status = 'ready'").collect()} == {"T1"}

    world.texts["x"] = "epsilon"
    world.sync.run(files(spark, one), retry_errors=True)
    assert world.asked[2] == ["c", "x"] and world.states()["x"] == "ready" and ("x", "epsilon") in world.terms()

    world.texts["b"] = "zeta"
    two = one | {"b": ("I", 9)}
    world.sync.run(files(spark, two))  # a changed source
    assert world.asked[3] == ["b"] and ("b", "zeta") in world.terms() and ("b", "gamma") not in world.terms()

    three = {("n" if k == "a" else k): v for k, v in two.items()}  # a renamed file
    r = world.sync.run(files(spark, three))
    assert world.asked[4] == [] and r.counts["adopt_then_extract"] == 1 and world.states()["n"] == "ready"
    assert ("n", "alpha") in world.terms() and not any(k == "a" for k, _ in world.terms())

    r = world.sync.run(files(spark, {k: v for k, v in three.items() if k != "n"}))  # a removal
    assert r.removed == 1 and "n" not in world.states() and not any(k == "n" for k, _ in world.terms())
    assert "n" not in {x.doc_key for x in world.sync.artifacts.rows().collect()}


def test_ambiguous_renames_are_extracted(spark, world):
    world.sync.run(files(spark, {"a": ("I", 1), "d": ("I", 1)}))
    world.texts["n"] = "new text"
    world.sync.run(files(spark, {"n": ("I", 1)}))
    assert world.asked[1] == ["n"] and ("n", "text") in world.terms()


def test_a_lost_catalog_is_rebuilt_from_artifacts(spark, world, tmp_path):
    rows = {"a": ("I", 1), "b": ("I", 2)}
    world.sync.run(files(spark, rows))
    (tmp_path / "catalog/versions/1").write_text("{ broken")
    (tmp_path / "catalog/versions/.1.crc").unlink(missing_ok=True)
    assert world.states() == {} and not world.sync.catalog.pointer.versions()
    world.sync.run(files(spark, rows))
    assert world.asked[1] == [] and world.states() == {"a": "ready", "b": "ready"}
    assert any("corrupt" in p.name for p in (tmp_path / "catalog/versions").iterdir())


def test_signature_rebuilds_and_model_resets(spark, world, tmp_path):
    rows = {"a": ("I", 1)}
    world.sync.run(files(spark, rows))
    world.sync.state = sync.IndexerState("m", "other")
    assert world.sync.run(files(spark, rows)).policy["keyword_rebuild"]
    world.sync.state = sync.IndexerState("n", "other")
    p = world.sync.run(files(spark, rows)).policy
    assert p["reset_vectors"] and not p["keyword_rebuild"] and not p["short_circuit"]


def test_paths_of_other_homes(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", "/home/u")
    c.write(spark.createDataFrame([("k", "/home/u/x.pdf"), ("l", "/Users/v/y.pdf"), ("m", "/Users/v/z.pdf")], "doc_key string, file_path string"))
    rows, _ = c.read()
    known = spark.createDataFrame([("/home/u/y.pdf",)], "file_path string")
    assert {r.doc_key: r.file_path for r in c.rehomed(rows, known).collect()} == {"k": "/home/u/x.pdf", "l": "/home/u/y.pdf", "m": "/Users/v/z.pdf"}
    raw = spark.read.parquet(f"{tmp_path}/c/v1")
    assert raw.where("doc_key = 'k'").first().file_path == "~/x.pdf"


class Fixed:
    def embed(self, texts):
        return [[1.0, 0.0]]

    def keys_with_tags(self, tags):
        return ["I"], 1

    def keys_in_collection(self, key):
        return []

    def recent(self, start, size, order):
        return [{"itemType": t} for t in ("note", "book")][start : start + size]

    def search(self, query, limit):
        return [{"paperId": "p", "title": "T"}, {"title": "no id"}]

    def get(self, paper_id):
        return None


def test_commands_over_a_stored_corpus(spark, world):
    import json

    world.sync.run(files(spark, {"a": ("I", 1), "b": ("I", 2), "d": ("J", 5)}))
    blocks = world.sync.artifacts.blocks()
    chunks = spark.createDataFrame([("a", 0, 0, 5, [0.0, 1.0]), ("b", 0, 0, 5, [1.0, 0.1]), ("d", 0, 0, 5, [0.5, 0.5])], "doc_key string, seq int, pos int, len int, embedding array<double>")
    c = Corpus(world.sync.catalog.read()[0], blocks, None, world.sync.artifacts.normalized(), world.sync.index, chunks, Fixed(), lambda p: F.substring(p, 1, 4), Fixed(), Fixed())
    ask = lambda command, **a: json.loads(c.run(command, **a))
    found = ask("search", query="alphas")["data"]
    assert {r["doc_key"] for r in found} == {"a", "d"} and all(len(r["passage"]) <= 4 for r in found)
    assert {r["doc_key"] for r in ask("search", query="alpha", tags=["t"])["data"]} == {"a"}
    assert [r["doc_key"] for r in ask("search", query="any", semantic=True, limit=2)["data"]] == ["b", "d"]
    assert ask("search", query="any", semantic=True, tags=["t"])["error"]["code"] == "INVALID_ARGUMENT"
    assert ask("fulltext", key="cI")["data"] == [{"item_key": "I", "markdown": "# Head\n\nalpha beta\n\n# Attachment: b.txt\n\ngamma delta", "origin": "stored"}]
    status = ask("status")["data"][0]
    assert status["indexed_documents"] == 3 and status["unindexed_documents"] == 0
    assert ask("recent", limit=5)["data"] == [{"itemType": "book"}]
    assert [r["paper_id"] for r in ask("s2", query="x")["data"]] == ["p"]
    assert ask("add", doi="10.1/x")["error"]["code"] == "INVALID_ARGUMENT"
