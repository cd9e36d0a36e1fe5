import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.functions import items as I
from textquarry.sources import bibliography as bib
from textquarry.sources import connectors as C
from textquarry.sources import markup


def one(spark, value, schema, f):
    return spark.createDataFrame([(value,)], f"x {schema}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("https://doi.org/10.1/ab/", "10.1/ab"), ("doi: 10.1000/X%2Fy", "10.1000/X/y"), ("10.1/a+b", "10.1/a+b"), ("nope", None), ("", None)])
def test_doi(spark, raw, want):
    assert one(spark, raw, "string", I.doi) == want


@pytest.mark.parametrize(("raw", "want"), [("Foo: Bar", "Foo"), ("标题：副标题", "标题"), ("O157:H7", None), ("long-term", None), ("A - B", "A"), ("Foo: ", None), (": x", None)])
def test_short_title(spark, raw, want):
    assert one(spark, raw, "string", I.short_title) == want


def test_issued(spark):
    assert one(spark, [2001, 2, 3], "array<int>", I.issued) == "2001-02-03"
    assert one(spark, [2001, None, 3], "array<int>", I.issued) == "2001"
    assert one(spark, [], "array<int>", I.issued) == ""


@pytest.mark.parametrize(("raw", "want"), [("Doe, Jane", ("Jane", "Doe", None)), ("Jane Q. Doe", ("Jane Q.", "Doe", None)), ("Plato", (None, None, "Plato")), (" ", None), ("Doe,", (None, "Doe", None))])
def test_author(spark, raw, want):
    r = one(spark, raw, "string", I.author)
    assert (r and tuple(r)) == want


def test_csl_authors_and_types(spark):
    people = [("Doe", "Jane", None), (None, None, "WHO"), (None, None, None)]
    got = one(spark, people, "array<struct<family:string,given:string,literal:string>>", I.csl_authors)
    assert [tuple(x) for x in got] == [("Jane", "Doe", None), (None, None, "WHO")]
    df = spark.createDataFrame([("article", "arXiv", "", ""), ("article", "", "", "J"), ("book-chapter", "", "", ""), ("odd", "", "", "")], "t string, p string, u string, c string")
    assert [r[0] for r in df.select(I.item_type(*map(F.col, "tpuc"))).collect()] == ["preprint", "journalArticle", "bookSection", "document"]


def test_titles_and_abstract(spark):
    df = spark.createDataFrame([("A", "B", None), ("A", None, "S"), (None, None, None)], "t string, s string, g string")
    assert [tuple(r[0]) for r in df.select(I.titles(*map(F.col, "tsg"))).collect()] == [("A: B", "A"), ("A", "S"), ("", None)]
    assert one(spark, "<p>a <b>b</b></p>", "string", I.abstract) == "a b"


def test_error_lines(spark):
    assert one(spark, "start\nError: bad\nbye", "string", I.last_error_line) == "Error: bad"
    assert one(spark, "a\n\nb\n", "string", I.last_error_line) == "b"


ITEMS = [
    {"id": "c1", "zotero-item-key": "AAAA1111", "title": "T", "author": [{"family": "Doe", "given": "J"}], "issued": {"date-parts": [["1999", 1]]}, "type": "article-journal", "container-title": "J", "publisher": "P", "file": "/lib/a;b.pdf;/lib/sub/c.epub;/lib/a;b.pdf"},
    {"id": "c2", "title": "no key"},
    {"id": "c3", "zotero-item-key": "BBBB2222", "editor": [{"literal": "Ed"}], "type": "book", "publisher": "P", "file": "/other/lib/x.htm;/lib/../y.pdf"},
]


@pytest.mark.parametrize("shape", [lambda x: x, lambda x: {"items": x}, lambda x: {"meta": 1, "rows": x}])
def test_bibliography(spark, tmp_path, shape):
    path = tmp_path / "b.json"
    path.write_text(json.dumps(shape(ITEMS)))
    rows = bib.records(bib.read_items(spark, str(path))).orderBy("item_key").collect()
    assert [r.item_key for r in rows] == ["AAAA1111", "BBBB2222"]
    assert rows[0].authors == ["Doe J"] and set(rows[0].author_search_texts) == {"Doe J", "J Doe"} and rows[0].year == "1999"
    assert (rows[0].journal, rows[0].publisher) == ("J", None) and (rows[1].title, rows[1].authors, rows[1].publisher) == ("BBBB2222", ["Ed"], "P")
    files = bib.attachments(bib.records(bib.read_items(spark, str(path))), "/lib", "lib").collect()
    assert sorted((f.file_path, f.file_ext, f.supported) for f in files) == [("a;b.pdf", "pdf", True), ("sub/c.epub", "epub", True), ("x.htm", "html", True)]
    assert all(len(f.doc_key) == 40 for f in files)


def test_bibliography_without_array(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="no array"):
        bib.read_items(spark, str(tmp_path / "b.json"))


def test_html():
    page = "<html><head><title>t</title></head><body><p>out</p><article><h2>Head <b>x</b></h2><p>a\n b<br>c</p><ul><li>one <p>two</p></li></ul><script>no</script></article></body></html>"
    assert markup.html_markdown(page) == "## Head x\n\na b\n\nc\n\n- one two"
    assert markup.html_markdown(None) == ""


def test_epub(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="u"><manifest><item id="a" href="1.xhtml"/><item id="b" href="2.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/1.xhtml", "<html><body><p>first</p></body></html>")
        z.writestr("OPS/2.xhtml", "<html><body><h1>second</h1></body></html>")
    (tmp_path / "x.epub").write_bytes(out.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = {r.path.rsplit("/", 1)[1]: r for r in markup.read_epubs(spark, str(tmp_path)).collect()}
    assert rows["x.epub"].markdown == "# second\n\nfirst" and rows["bad.epub"].error


def test_elements(spark):
    tree = [{"type": "heading", "heading level": 2, "content": "H", "kids": [{"type": "list", "text": "x", "page number": 3, "bounding box": [1, 2]}]}, {"type": "image"}]
    rows = markup.flatten_elements(spark.createDataFrame([("d", json.dumps(tree)), ("e", "{")], "doc_key string, json string")).orderBy("pos").collect()
    assert [(r.type, r.heading_level, r.text, r.page, r.bbox) for r in rows] == [("heading", 2, "H", None, None), ("list", None, "x", 3, [1.0, 2.0])]


class Library:
    def __init__(self, rows=(), keys=(), total=0):
        self.rows, self.keys, self.total, self.made = list(rows), list(keys), total, []

    def keys_with_tags(self, tags):
        return self.keys, self.total

    def recent(self, start, size, order):
        return self.rows[start : start + size]

    def create(self, payload):
        if payload.get("bad"):
            raise ValueError("refused")
        self.made.append(payload)
        return "K"


def test_connectors():
    with pytest.raises(C.TruncatedError):
        C.complete_keys(Library(keys=["a"], total=2), ["t"])
    rows = [{"itemType": "note"}, {"itemType": "book", "n": 1}, {"itemType": "attachment"}, {"itemType": "book", "n": 2}]
    assert [r["n"] for r in C.recent_items(Library(rows), 2, page=2)] == [1, 2]
    key, warnings = C.create_with_children(Library(), {"t": 1}, [{"itemType": "note"}, {"itemType": "note", "bad": True}])
    assert key == "K" and warnings == ["note: refused"]


class Tier:
    def __init__(self, ok):
        self.ok = ok

    def extract(self, paths):
        return {p: C.Extracted(markdown=p) if p in self.ok else C.Extracted(error="no") for p in paths}


def test_extraction_tiers():
    got = C.extract_in_tiers([Tier({"a"}), Tier({"b"})], ["a", "b", "c"])
    assert [got[p].error for p in "abc"] == [None, None, "no"]
