"""HTML pages and EPUB books to markdown, and trees of extracted elements to rows.

The walk over a page's tags is imperative, so it runs in vectorised functions; it needs only the standard library.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCK_TAGS = {"p", "div", "section", "article", "main", "blockquote", "pre", "table", "tr", "ul", "ol", "header", "footer", "figure", "figcaption", "dl", "dt", "dd", "body"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
SILENT = {"script", "style", "head", "noscript", "template"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Walk(HTMLParser):
    """Collects blocks: inline text is gathered until a block tag begins or ends. Only what lies within the
    first <article>, else <main>, else <body>, counts; without any of them everything does."""

    def __init__(self, scope: str | None):
        super().__init__(convert_charrefs=True)
        self.scope, self.depth, self.silent = scope, 0 if scope else 1, 0
        self.done, self.line, self.item = False, [], 0
        self.out: list[str] = []

    def flush(self, mark: str = "") -> None:
        text = " ".join("".join(self.line).split())
        self.line = []
        if text:
            self.out.append(mark + text)

    def handle_starttag(self, tag, attrs):
        if tag == self.scope and not self.done:
            self.depth += 1
        if tag in SILENT:
            self.silent += 1
        if not self._on():
            return
        if tag == "br":
            self.flush()
        elif tag == "li" or (tag in HEADINGS or tag in BLOCK_TAGS) and not self.item:
            self.flush("- " if self.item and tag == "li" else "")
            self.item += tag == "li"

    def handle_endtag(self, tag):
        if self._on():
            if tag in HEADINGS and not self.item:
                self.flush("#" * HEADINGS[tag] + " ")
            elif tag == "li" and self.item:
                self.flush("- ")
                self.item -= 1
            elif tag in BLOCK_TAGS and not self.item:
                self.flush()
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag == self.scope and self.depth and not self.done:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self._on():
            self.line.append(data)

    def _on(self) -> bool:
        return self.depth > 0 and not self.silent


def html_markdown(html: str | None) -> str:
    """Markdown of one page; null is empty."""
    if not html:
        return ""
    low = html.lower()
    scope = next((t for t in ("article", "main", "body") if re.search(rf"<{t}[\s>]", low)), None)
    walk = _Walk(scope)
    walk.feed(html)
    walk.close()
    walk.flush()
    return "\n\n".join(walk.out)


@F.pandas_udf(StringType())
def _html_markdown(pages: pd.Series) -> pd.Series:
    return pages.map(html_markdown)


def markdown_of_html(html: Column) -> Column:
    return _html_markdown(html)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_markdown(content: bytes) -> str:
    """Markdown of a book: container to package, its spine's chapters in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ElementTree.fromstring(book.read(package))
        files = {e.attrib["id"]: e.attrib["href"] for e in opf.iter() if _local(e.tag) == "item"}
        order = [files[e.attrib["idref"]] for e in opf.iter() if _local(e.tag) == "itemref" and e.attrib.get("idref") in files]
        base, names = posixpath.dirname(package), set(book.namelist())
        paths = [posixpath.normpath(posixpath.join(base, href.split("#")[0])) for href in order]
        chapters = [html_markdown(book.read(p).decode("utf-8", "replace")) for p in paths if p in names]
    return "\n\n".join(c for c in chapters if c)


def read_epubs(spark, path: str) -> DataFrame:
    """path, markdown, error of every EPUB file below a path; a broken one has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((where, epub_markdown(content), None))
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    rows.append((where, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def read_texts(spark, path: str) -> DataFrame:
    """path, markdown of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))


ELEMENTS = "doc_key string, pos int, type string, heading_level int, text string, page int, bbox array<double>"


def walk_elements(tree: object) -> Iterator[tuple]:
    """Type, level, text, page, box of the elements of a tree, parents before children."""
    if isinstance(tree, list):
        for x in tree:
            yield from walk_elements(x)
    elif isinstance(tree, dict):
        text = next((tree[k] for k in ("content", "description", "text") if isinstance(tree.get(k), str) and tree[k].strip()), None)
        if isinstance(tree.get("type"), str) and text is not None:
            number = lambda k: int(tree[k]) if isinstance(tree.get(k), (int, float)) and not isinstance(tree.get(k), bool) else None
            box = tree.get("bounding box")
            good = isinstance(box, list) and box and all(isinstance(x, (int, float)) for x in box)
            level = number("heading level")
            yield tree["type"], level if level is not None else number("level"), text, number("page number"), [float(x) for x in box] if good else None
        for key, value in tree.items():
            if isinstance(value, (list, dict)) and key != "bounding box":
                yield from walk_elements(value)


def flatten_elements(trees: DataFrame) -> DataFrame:
    """Rows of elements from doc_key and json; a tree that is no JSON has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_key"], pdf["json"], strict=True):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(key, pos, *e) for pos, e in enumerate(walk_elements(tree))]
            yield pd.DataFrame(rows, columns=["doc_key", "pos", "type", "heading_level", "text", "page", "bbox"]).astype({"heading_level": "Int32", "page": "Int32"})

    return trees.select("doc_key", "json").mapInPandas(run, ELEMENTS)
