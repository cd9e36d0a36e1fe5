import json

import pytest
from pyspark.sql import functions as F

from textquarry.commands import Config, Corpus
from textquarry.functions import budget, han, lenient
from textquarry.operators import blocks as B
from textquarry.operators import index, search


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("a", "alpha beta\n\nline about gamma"), ("b", "second file alpha"), ("c", "other item")], "doc_key string, text string")
    catalog = spark.createDataFrame([("a", "AAAA1111", "smith", "p/1.txt", "T", "ready", True), ("b", "AAAA1111", "smith", "p/2.txt", "T", "ready", True), ("c", "BBBB2222", "doe", "p/3.txt", "U", "ready", True), ("d", "CCCC3333", "doe", "p/4.txt", "V", "ready", True)], "doc_key string, item_key string, citation_key string, file_path string, title string, extract_status string, supported boolean")
    records = spark.createDataFrame([("AAAA1111", "On Alpha", ["Smith"], "1999", None, None, None, True)], "item_key string, title string, author_search_texts array<string>, year string, abstract string, journal string, publisher string, has_supported_file boolean")
    return Corpus(catalog, B.annotate(B.markdown_elements(docs, "doc_key", "text")).cache(), records)


def run(corpus, command, **arguments):
    return json.loads(corpus.run(command, **arguments))


def test_commands(corpus):
    assert [r["doc_key"] for r in run(corpus, "search", query="gamma")["data"]] == ["a"]
    assert run(corpus, "search_in", query='"alpha beta"', key="@smith")["data"][0]["score"] == 100.0
    assert [r["item_key"] for r in run(corpus, "metadata", query="alpha")["data"]] == ["AAAA1111"]
    assert [r["text"] for r in run(corpus, "page", key="AAAA1111", offset=1, limit=2)["data"]] == ["line about gamma", "Attachment: 2.txt"]
    assert run(corpus, "fulltext", key="AAAA1111")["data"][0]["markdown"].endswith("# Attachment: 2.txt\n\nsecond file alpha")
    assert run(corpus, "expand", key="AAAA1111", offset=5, radius=5)["data"][0]["slice"] == "alpha beta"
    assert run(corpus, "status")["data"][0]["ready"] == 4
    assert run(corpus, "diagnose", everything=True)["ok"]


@pytest.mark.parametrize(("command", "arguments", "code"), [("search", {"query": "a NEAR b"}, "INVALID_QUERY"), ("search", {"query": "x", "limit": 0}, "INVALID_ARGUMENT"), ("page", {"key": "doe"}, "INVALID_ARGUMENT"), ("page", {"key": "ZZZZ9999"}, "INVALID_ARGUMENT"), ("metadata", {}, "INVALID_ARGUMENT"), ("metadata", {"filters": {"colour": "x"}}, "INVALID_ARGUMENT"), ("search", {"query": "x", "colour": 1}, "INVALID_ARGUMENT"), ("nothing", {}, "INVALID_ARGUMENT")])
def test_bad_commands(corpus, command, arguments, code):
    assert run(corpus, command, **arguments)["error"]["code"] == code


def test_item_filter_is_tristate(spark, corpus):
    none, one = spark.createDataFrame([], "item_key string"), spark.createDataFrame([("BBBB2222",)], "item_key string")
    assert run(corpus, "search", query="alpha OR item", item_keys=none)["data"] == []
    assert [r["doc_key"] for r in run(corpus, "search", query="alpha OR item", item_keys=one)["data"]] == ["c"]


def test_config():
    c = Config.resolve({"data_dir": "x"}, {"TEXTQUARRY_DATA_DIR": "y", "TEXTQUARRY_VERTICAL_TAG": "v"}, {"excluded_tag": "e", "odd": 1})
    assert (c.data_dir, c.vertical_tag, c.excluded_tag, c.warnings) == ("x", "v", "e", ("unknown setting odd",))


QUERIES = ["alpha", "alpha NOT gamma", '"second file" OR gam*', "alpha NEAR/1 beta", "missing OR item", "al* AND line", '"beta line"']


@pytest.mark.parametrize("text", QUERIES)
def test_index_search_equals_scan(corpus, text):
    t = search.tokenised(corpus.blocks)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(search.search_index(index.postings(t), index.block_stats(t), text)) == key(search.search(corpus.blocks, text))


def test_simplified_map(spark):
    m = han.simplified_map()
    assert m["書"] == "书" and m["記"] == "记" and "乾" not in m and "人" not in m


def test_token_budget(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([("word " * 50,), ("few words",), (None,)], "t string")
    got = [r[0] for r in df.select(budget.cap_tokens(F.col("t"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 10)).collect()]
    assert got[0].endswith("…") and len(got[0]) < 60 and got[1:] == ["few words", None]


def test_lenient_items(spark):
    raw = {"title": " T ", "authors": ["Doe, J", 3], "keywords": ["a", " "], "abstract": "x", "doi": "bad", "journal": "J", "year": "1999", "collectionKey": "K", "pages": "1-2"}
    item = lenient.lenient_item(raw)
    assert item["fields"] == {"creators": [{"creatorType": "author", "firstName": "J", "lastName": "Doe"}], "tags": [{"tag": "a"}], "abstractNote": "x", "publicationTitle": "J", "date": "1999", "pages": "1-2"}
    assert item["collections"] == ["K"] and len(item["warnings"]) == 3
    out = lenient.payload(item | {"itemType": "bookSection"}, {"bookTitle": "", "date": "", "tags": []}, "agent")
    assert out["bookTitle"] == "J" and "pages" not in out and {"tag": "agent"} in out["tags"]
    rows = spark.createDataFrame([(0, json.dumps(raw)), (1, "[]"), (2, '{"a": 1}')], "ordinal long, json string")
    assert [r.error is None for r in lenient.map_items(rows).orderBy("ordinal").collect()] == [True, False, False]


@pytest.mark.parametrize("text", ["", "3", "[]", "{"])
def test_batches_that_are_refused(text):
    with pytest.raises(lenient.InputError):
        lenient.read_batch(text)
