"""Flags of blocks: references, boilerplate, tables of contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, compact

# Headings of reference lists, cues of references, publication words, boilerplate phrases, and the
# patterns of a cited year, a citation's start, a contents title, a page count and a contents line.
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited", "reference list")
REFERENCE_HEADINGS_CJK = "参考文献"
REFERENCE_CUES = ("available at", "retrieved from", r"doi\s*:", "https?://")
PUBLICATION_WORDS = ("journal", "press", r"vol\.", r"pp\.", "isbn", "issn", "conference", "proceedings")
BOILERPLATE_PHRASES = (
    "to cite (?:this|the) (?:article|paper)",
    "please cite",
    "recommended citation",
    r"citation\s*:",
    "downloaded from",
    "all rights reserved",
    "copyright",
    "creative commons",
    "author manuscript",
    "accepted manuscript",
    "published online",
    "supplementary material",
    "supporting information",
    "correspondence (?:to|should be addressed to)",
    "preprint",
    "this version posted",
)
#: Every boilerplate phrase and title holds one of these, whatever its spaces.
BOILERPLATE_HINTS = ("cit", "right", "commons", "manuscript", "online", "supp", "correspond", "print", "posted", "download", "contents", "page")
CITED_YEAR = r"\(\d{4}[a-z]?\)"
CITATION_START = r"^[\p{L}\p{M}'’.-]+,\s+(?:\p{Lu}[\p{L}\p{M}'’.-]*|\p{Lu}\.)[\s\S]{0,120}\(\d{4}[a-z]?\)"
CONTENTS_TITLE = r"(?i)^(?:contents|table of contents)$"
PAGE_COUNT = r"(?i)^page \d+ of \d+$"
CONTENTS_LINE = r"(?:^\.{0,3}|[\s\S]{4})\.{4}\s*+\d++\s*+$"

#: Word boundaries between ASCII word characters only.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def reference_section(path: Column) -> Column:
    """Whether the section path, holes read as empty, names a list of references."""
    joined = F.array_join(F.transform(path, lambda x: F.coalesce(x, F.lit(""))), " / ")
    return joined.rlike(f"(?i){_B}{_any(REFERENCE_HEADINGS)}{_E}|{REFERENCE_HEADINGS_CJK}")


def reference_text(text: Column) -> Column:
    t = compact(text)
    return (t != "") & (t.rlike(f"(?i){_any(REFERENCE_CUES)}") | t.rlike(CITATION_START) | (t.rlike(CITED_YEAR) & t.rlike(f"(?i){_any(PUBLICATION_WORDS)}")))


def reference_like(text: Column, path: Column) -> Column:
    return F.coalesce(reference_section(path), F.lit(False)) | F.coalesce(reference_text(text), F.lit(False))


def boilerplate_like(text: Column) -> Column:
    """Texts without any hint, the most, are not matched with the patterns."""
    low = F.lower(text)
    hinted = bound(low, lambda x: reduce(lambda a, b: a | b, [x.contains(h) for h in BOILERPLATE_HINTS]))
    return F.when(hinted, _boilerplate(compact(text))).when(text.isNotNull(), F.lit(False))


def _boilerplate(t: Column) -> Column:
    phrase = t.rlike(f"(?i){_B}{_any(BOILERPLATE_PHRASES)}(?:{_E}|(?<=:))")
    return (t != "") & (phrase | t.rlike(CONTENTS_TITLE) | t.rlike(PAGE_COUNT))


def contents_like(text: Column) -> Column:
    """A dot leader and a page number at the end."""
    return compact(text).rlike(CONTENTS_LINE)
