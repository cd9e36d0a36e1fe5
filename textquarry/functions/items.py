"""Mapping of external metadata to item fields, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# CSL and registrar work types, and the item types they become; anything else is a document.
ITEM_TYPES = {
    "article-journal": "journalArticle",
    "journal-article": "journalArticle",
    "paper-conference": "conferencePaper",
    "proceedings-article": "conferencePaper",
    "chapter": "bookSection",
    "book-chapter": "bookSection",
    "book-part": "bookSection",
    "book-section": "bookSection",
    "book": "book",
    "edited-book": "book",
    "monograph": "book",
    "reference-book": "book",
    "report": "report",
    "thesis": "thesis",
    "webpage": "webpage",
    "post-weblog": "webpage",
    "article-magazine": "magazineArticle",
    "article-newspaper": "newspaperArticle",
}
#: Separators of a subtitle; ASCII ones need a space on a side.
SUBTITLE = r"\s*：\s*|\s+[:—–]\s*|\s*[:—–]\s+|\s+-\s+"

CREATOR = "struct<firstName:string,lastName:string,name:string>"


def tidy(c: Column) -> Column:
    """No-break spaces to spaces, runs to one, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def first_text(array: Column) -> Column:
    """First element that is not blank, tidied; else empty."""
    return F.coalesce(F.get(F.filter(F.transform(array, tidy), lambda x: x != ""), F.lit(0)), F.lit(""))


def doi(c: Column) -> Column:
    """A bare DOI, or null if it is none. Percent escapes are decoded; a plus sign stays one."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bare = F.regexp_replace(F.trim(decoded), r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)", "")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(bare.rlike(r"(?i)^10\.\S+/\S+$"), bare)


def item_type(csl_type: Column, publisher: Column, url: Column, container: Column) -> Column:
    kind, pairs = tidy(csl_type), [F.lit(x) for kv in ITEM_TYPES.items() for x in kv]
    preprint = (F.lower(tidy(publisher)) == "arxiv") | F.lower(tidy(url)).contains("arxiv.org")
    known = F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("document"))
    return F.when((kind == "article") & preprint, "preprint").when((kind == "article") & (tidy(container) != ""), "journalArticle").otherwise(known)


def titles(title: Column, subtitle: Column, short: Column) -> Column:
    """struct(full, short): the short title given, else the title before a subtitle, else null."""
    t, s, given = tidy(title), tidy(subtitle), tidy(short)
    full = F.when((t != "") & (s != ""), F.concat(t, F.lit(": "), s)).otherwise(t)
    brief = F.when(full == "", None).when(given != "", given).when((t != "") & (s != ""), t)
    return F.struct(full.alias("full"), brief.alias("short"))


def short_title(full: Column) -> Column:
    """What stands before the first subtitle separator, if something follows it; else null."""
    t = F.trim(full)
    head = F.trim(F.get(F.split(t, SUBTITLE, 2), F.lit(0)))
    rest = F.trim(F.get(F.split(t, SUBTITLE, 2), F.lit(1)))
    return F.when((head != "") & (rest != "") & (head != t), head)


def issued(parts: Column) -> Column:
    """Up to three date parts, padded to 4, 2 and 2 digits, up to the first that is missing."""
    whole = F.slice(F.coalesce(parts, F.array().cast("array<int>")), 1, 3)
    stop = F.coalesce(F.array_min(F.filter(F.transform(whole, lambda x, i: F.when(x.isNull(), i)), lambda x: x.isNotNull())), F.size(whole))
    return F.array_join(F.transform(F.slice(whole, F.lit(1), stop), lambda x, i: F.when(i == 0, F.lpad(x.cast("string"), 4, "0")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-")


def author(c: Column) -> Column:
    """One name: "Last, First", "First ... Last" or a single word; null if blank."""
    name = tidy(c)
    parts = F.split(name, ",")
    last, first = tidy(F.get(parts, F.lit(0))), tidy(F.get(parts, F.lit(1)))
    words = F.split(name, " ")
    none = F.lit(None).cast("string")
    comma = F.struct(F.nullif(first, F.lit("")).alias("firstName"), F.nullif(last, F.lit("")).alias("lastName"), none.alias("name"))
    plain = F.struct(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("firstName"), F.element_at(words, -1).alias("lastName"), none.alias("name"))
    single = F.struct(none.alias("firstName"), none.alias("lastName"), name.alias("name"))
    return F.when(name == "", None).when(F.contains(name, F.lit(",")) & ((last != "") | (first != "")), comma).when(F.size(words) > 1, plain).otherwise(single)


def csl_authors(people: Column) -> Column:
    """From structs of family, given, literal: family and given win; empty people go."""

    def one(p: Column) -> Column:
        family, given, literal = tidy(p["family"]), tidy(p["given"]), tidy(p["literal"])
        none = F.lit(None).cast("string")
        named = F.struct(F.nullif(given, F.lit("")).alias("firstName"), F.nullif(family, F.lit("")).alias("lastName"), none.alias("name"))
        whole = F.struct(none.alias("firstName"), none.alias("lastName"), literal.alias("name"))
        return F.when((family != "") | (given != ""), named).when(literal != "", whole)

    return F.filter(F.transform(people, one), lambda x: x.isNotNull())


def abstract(c: Column) -> Column:
    return tidy(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def year_of(parsed: Column, raw: Column) -> Column:
    """First four digits in a row of the parsed date, else of the raw one; else null."""
    four = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{4}", 0), F.lit(""))
    return F.coalesce(four(parsed), four(raw))


def add_error(message: Column) -> Column:
    """Class of a failed addition."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.contains("attach"), "INVALID_ATTACH_FILE").when(m.contains("title"), "MISSING_TITLE").when(m.contains("item type") | m.contains("itemtype"), "INVALID_ITEM_TYPE").when(m.contains("json"), "INVALID_JSON").otherwise("ADD_FAILED")


def last_error_line(log: Column) -> Column:
    """Last line that names an error, else the last that is not blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    errors = F.filter(lines, lambda x: x.rlike("(?i)error|exception|failed|cannot|unable"))
    return F.coalesce(F.try_element_at(errors, F.lit(-1)), F.try_element_at(lines, F.lit(-1)))
