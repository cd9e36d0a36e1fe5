"""License scans (operator 3): Aho-Corasick over notice phrases and identifier tags, and a shunting-yard
evaluation of the licence expressions that follow the tags.

A text is lower-cased (A-Z) and reduced to its words; one automaton finds all phrases as runs of whole
words. After a tag, the rest of the raw line is a licence expression of identifiers, and / or / with and
parentheses. Null text has no words; an expression that does not parse keeps the identifiers it names.
Long texts are scanned whole. Repeated rows are scanned and returned each; an empty table gives no rows. Columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .words import ITEM_BYTES, LOWER_BYTES, texts

#: Phrases that make the base, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, their labels and how sure a find is.
NOTICE_PHRASES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "public domain dedication": ("cc0", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_SURE = 0.9
TAG = "spdx license identifier"
RAW_TAG = b"spdx-license-identifier:"

#: Families of licence identifiers by prefix, with how much they restrict (0 least).
FAMILIES = (
    ("cc0", "cc0", 0),
    ("unlicense", "unlicense", 0),
    ("mit", "mit", 1),
    ("bsd", "bsd", 1),
    ("isc", "isc", 1),
    ("apache", "apache", 1),
    ("cc-by-nc", "cc-by", 4),
    ("cc-by-sa", "cc-by", 3),
    ("cc-by", "cc-by", 1),
    ("mpl", "mpl", 2),
    ("epl", "epl", 2),
    ("lgpl", "lgpl", 2),
    ("agpl", "agpl", 4),
    ("gpl", "gpl", 3),
)
UNKNOWN = 5
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, int]:
    return next(((label, level) for prefix, label, level in FAMILIES if identifier.startswith(prefix)), (identifier, UNKNOWN))


def evaluate(expression: str) -> tuple[list[str], int | None]:
    """Labels named by a licence expression, and how restrictive it is: `or` lets one choose the mildest,
    `and` binds to the strictest, `with` relaxes a copyleft licence by one. None: it does not parse."""
    out: list[tuple[str, int]] = []
    labels: list[str] = []
    ops: list[str] = []
    operand = False

    def apply() -> None:
        op = ops.pop()
        (_, b), (left, a) = out.pop(), out.pop()
        out.append((left, min(a, b) if op == "or" else max(a, b) if op == "and" else max(0, a - (2 <= a <= 4))))

    try:
        for token in _TOKEN.findall(expression.lower()):
            if token in _RANK:
                if not operand:
                    raise ValueError(token)
                while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                    apply()
                ops.append(token)
                operand = False
            elif token == "(":
                if operand:
                    break
                ops.append(token)
            elif token == ")":
                while ops and ops[-1] != "(":
                    apply()
                if not ops:
                    break
                ops.pop()
                operand = True
            else:
                if operand:
                    break  # prose follows the expression
                exception = bool(ops) and ops[-1] == "with"
                out.append((token, 0) if exception else family(token))
                labels += [] if exception else [out[-1][0]]
                operand = True
        while ops:
            if ops[-1] == "(":
                raise ValueError("open parenthesis")
            apply()
        return labels, out[0][1] if len(out) == 1 else None
    except (IndexError, ValueError):
        return labels, None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase, label, BASE_SURE, True))
    for phrase, (label, sure) in NOTICE_PHRASES.items():
        found.add_word(f" {phrase} ", (phrase, label, sure, False))
    found.add_word(f" {TAG} ", (TAG, None, 1.0, False))
    found.make_automaton()
    return found


def scan_text(text: bytes, found) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, level of one text."""
    words = text.translate(ITEM_BYTES).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    starts, base, labels, doubt, level, at, seen = [], set(), set(), 1.0, None, 0, 0
    tagged = False
    for end, (phrase, label, sure, is_base) in found.iter(joined):
        start = end + 1 - len(phrase) - 2
        if start < at:  # a longer phrase that began earlier
            at, seen = 0, 0
        seen, at = seen + joined.count(" ", at, start), start
        doubt *= 1 - sure
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(seen)
    if tagged:
        for line in text.translate(LOWER_BYTES).split(RAW_TAG)[1:]:
            named, of = evaluate(line.split(b"\n", 1)[0].decode("utf-8", "replace"))
            labels.update(named)
            level = of if level is None else level if of is None else max(level, of)
    score = 1 - doubt
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, level


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restriction long"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: base finds, all labels, how sure (0 to 1) and how restrictive the tagged
    expression is (null without one). An empty table gives no rows."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = automaton(), [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in it:
            rows = [scan_text(t, found) for t in texts(batch, "text")]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, scan, SCHEMA)
