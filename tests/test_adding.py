import json

import pytest

from textquarry.functions.lenient import InputError
from textquarry.functions.papers import paper_item
from textquarry.sources import adding as A

TEMPLATE = {"title": "", "creators": [], "date": "", "DOI": "", "tags": [], "collections": [], "publicationTitle": "", "url": "", "publisher": "", "abstractNote": ""}


class Sink:
    def __init__(self, refuse=()):
        self.rows, self.refuse = [], refuse

    def create(self, body):
        if body["itemType"] in self.refuse:
            raise RuntimeError("refused")
        self.rows.append(body)
        return f"K{len(self.rows)}"


class Wire:
    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def get(self, url, accept):
        self.asked.append((url, accept))
        return self.answers["get"]

    def post(self, url, body, content_type):
        self.asked.append((url, body))
        found = self.answers[url.rsplit("/", 1)[-1]]
        return found.pop(0) if isinstance(found, list) else found


def adder(**options):
    sink = Sink(**options)
    return A.Adder(sink, lambda kind: dict(TEMPLATE)), sink


def test_batches_keep_their_order(tmp_path):
    a, sink = adder()
    (tmp_path / "x.pdf").write_text("x")
    batch = [{"title": "one"}, {"no": "title"}, 3, {"title": "two", "attachFile": str(tmp_path / "gone.pdf")}, {"title": "three", "attachFile": str(tmp_path / "x.pdf"), "collectionKey": "AAAA1111"}]
    got = a.add_batch(json.dumps(batch))
    assert [(r["ordinal"], r["ok"]) for r in got] == [(0, True), (1, False), (2, False), (3, False), (4, True)]
    assert [r["title"] for r in sink.rows] == ["one", "three", "x.pdf"] and sink.rows[1]["collections"] == ["AAAA1111"]
    assert {"tag": "added-by-agent"} in sink.rows[0]["tags"] and sink.rows[2]["parentItem"] == "K2"
    assert a.add_batch('{"title": "z"}', "BBBB2222")[0]["ok"] and sink.rows[-1]["collections"] == ["BBBB2222"]
    with pytest.raises(InputError):
        a.add_batch("[]")


def test_linked_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.epub").write_text("x")
    f = A.linked_file(f" {tmp_path}/sub/b.epub ", str(tmp_path))
    assert (f.name, f.content_type, f.stored_path) == ("b.epub", "application/epub+zip", "attachments:sub/b.epub")
    assert A.linked_file(f"{tmp_path}/sub/b.epub").stored_path == f"{tmp_path}/sub/b.epub"
    for bad in ("", f"{tmp_path}/none", str(tmp_path)):
        with pytest.raises(InputError):
            A.linked_file(bad)


def test_failed_children_are_warnings():
    a, sink = adder(refuse=("note",))
    items = [{"itemType": "note", "parentItem": "P", "note": "n"}, {"itemType": "book", "key": "P", "title": "T", "date": "1999", "odd": 1}, {"itemType": "book", "title": "U"}]
    got = a.add_translated(items)
    assert got["ok"] and len(got["warnings"]) == 2 and len(sink.rows) == 1 and "odd" not in sink.rows[0]


def test_one_item_and_its_notes():
    item, notes, warnings = A.one_item([{"itemType": "book", "key": "P"}, {"itemType": "note", "parentItem": "P", "note": "mine"}, {"itemType": "note", "parentItem": "Q", "note": "other"}, {"itemType": "note", "parentItem": "P", "note": " "}])
    assert item["key"] == "P" and [n["note"] for n in notes] == ["mine"] and not warnings
    with pytest.raises(A.LookupFailed):
        A.one_item([{"itemType": "attachment"}])


def test_lookup_by_doi():
    record = {"type": "book", "title": ["T"], "issued": {"date-parts": [[2001, 3]]}, "author": [{"family": "B", "given": "A"}, {"literal": "Org"}], "DOI": "10.1/x"}
    wire = Wire(get=A.Response(200, json.dumps(record)))
    a, sink = adder()
    assert a.add_citation(A.Lookup(wire, "http://t").doi("https://doi.org/10.1/x"))["ok"]
    assert wire.asked[0][0] == "https://doi.org/10.1/x" and sink.rows[0]["date"] == "2001-03" and sink.rows[0]["creators"][1] == {"creatorType": "author", "name": "Org"}
    for answer, text, code in ((A.Response(404, ""), "10.1/x", "DOI_NOT_FOUND"), (A.Response(500, "x"), "10.1/x", "LOOKUP_FAILED"), (A.Response(200, "<"), "10.1/x", "LOOKUP_FAILED"), (A.Response(200, "{}"), "none", "INVALID_IDENTIFIER")):
        with pytest.raises(A.LookupFailed) as e:
            A.Lookup(Wire(get=answer), "http://t").doi(text)
        assert e.value.code == code


def test_pages_offer_choices():
    offer = A.Response(300, json.dumps({"session": "s", "items": {"a": "First", "b": {"title": "Second"}}}))
    assert A.Lookup(Wire(web=offer), "http://t").page("http://x") == A.Choices({"a": "First", "b": "Second"})
    wire = Wire(web=[offer, A.Response(200, '[{"itemType": "book", "title": "T"}]')])
    assert A.Lookup(wire, "http://t").page("http://x", "b")[0]["title"] == "T"
    assert json.loads(wire.asked[1][1]) == {"url": "http://x", "session": "s", "items": {"b": {"title": "Second"}}}
    for answer, select, code in ((offer, "z", "INVALID_SELECT_KEY"), (A.Response(501, ""), None, "TRANSLATION_NO_ITEMS"), (A.Response(300, "{}"), None, "TRANSLATION_NO_ITEMS"), (A.Response(200, "{}"), None, "LOOKUP_FAILED")):
        with pytest.raises(A.LookupFailed) as e:
            A.Lookup(Wire(web=answer), "http://t").page("http://x", select)
        assert e.value.code == code
    with pytest.raises(A.LookupFailed) as e:
        A.Lookup(Wire(search=A.Response(501, "")), "http://t").identifier("978")
    assert e.value.code == "IDENTIFIER_NOT_FOUND"


def test_papers_as_items():
    got = paper_item({"title": "T", "authors": [{"name": "A B"}, {}], "year": 2001, "externalIds": {"DOI": "10.1/x"}, "publicationTypes": ["Book"], "journal": None})
    assert got == {"itemType": "book", "title": "T", "authors": ["A B"], "date": "2001", "DOI": "10.1/x"}
