"""Rows of outside services to fields: papers, library items, translated creators and tags, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import first_text, tidy, year_of

PAPER = "struct<paperId:string,title:string,authors:array<struct<name:string>>,year:int,externalIds:struct<DOI:string>,venue:string,journal:struct<name:string>,publicationDate:string,publicationTypes:array<string>,url:string,openAccessPdf:struct<url:string>,abstract:string>"
#: Publication types of papers, and item types, the first that applies.
PAPER_TYPES = (
    (("journalarticle",), "journalArticle"),
    (("conference", "conferencepaper"), "conferencePaper"),
    (("book",), "book"),
    (("booksection", "chapter"), "bookSection"),
    (("thesis",), "thesis"),
    (("report",), "report"),
    (("preprint",), "preprint"),
)


def _given(c: Column) -> Column:
    return F.nullif(tidy(c), F.lit(""))


def paper(json: Column) -> Column:
    """A struct of a paper's fields; null without an id and a title."""
    p = F.from_json(json, PAPER)
    fields = F.struct(
        _given(p["paperId"]).alias("paper_id"),
        _given(p["title"]).alias("title"),
        F.filter(F.transform(F.coalesce(p["authors"], F.array().cast("array<struct<name:string>>")), lambda a: tidy(a["name"])), lambda n: n != "").alias("authors"),
        p["year"].cast("string").alias("year"),
        _given(p["externalIds"]["DOI"]).alias("doi"),
        _given(p["venue"]).alias("venue"),
        _given(p["journal"]["name"]).alias("journal"),
        _given(p["publicationDate"]).alias("published"),
        F.coalesce(p["publicationTypes"], F.array().cast("array<string>")).alias("types"),
        _given(p["url"]).alias("url"),
        _given(p["openAccessPdf"]["url"]).alias("pdf_url"),
        _given(p["abstract"]).alias("abstract"),
    )
    return F.when((tidy(p["paperId"]) != "") & (tidy(p["title"]) != ""), fields)


def paper_type(types: Column, journal: Column) -> Column:
    """Item type of a paper; null if nothing tells."""
    low = F.transform(types, lambda t: F.lower(t))
    has = lambda names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    out = F.lit(None).cast("string")
    for names, kind in reversed(PAPER_TYPES):
        test = has(names) | (F.coalesce(journal, F.lit("")) != "") if kind == "journalArticle" else has(names)
        out = F.when(F.coalesce(test, F.lit(False)), kind).otherwise(out)
    return out


def paper_item(raw: dict) -> dict:
    """An outside paper as the input of an item (see functions.lenient); for one object on the driver."""
    given = [str(t).lower() for t in raw.get("publicationTypes") or []]
    journal = ((raw.get("journal") or {}).get("name") or "").strip()
    kind = next((k for names, k in PAPER_TYPES if set(names) & set(given) or (k == "journalArticle" and journal)), "journalArticle")
    fields = {
        "itemType": kind,
        "title": raw.get("title"),
        "authors": [a.get("name") for a in raw.get("authors") or [] if isinstance(a, dict) and a.get("name")],
        "date": raw.get("publicationDate") or (str(raw["year"]) if raw.get("year") else None),
        "DOI": (raw.get("externalIds") or {}).get("DOI"),
        "publicationTitle": journal or raw.get("venue"),
        "url": raw.get("url"),
        "abstract": raw.get("abstract"),
    }
    return {k: v for k, v in fields.items() if v}


def manual_type(item_type: Column, url: Column, publication: Column) -> Column:
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(item_type), item_type).when(given(url) & ~given(publication), "webpage").otherwise("journalArticle")


def display_names(creators: Column) -> Column:
    """Names of library creators: the whole name, else first and last."""

    def one(c: Column) -> Column:
        name, first, last = (F.trim(F.coalesce(c[k], F.lit(""))) for k in ("name", "firstName", "lastName"))
        return F.when(name != "", name).otherwise(F.trim(F.concat_ws(" ", first, last)))

    return F.filter(F.transform(creators, one), lambda x: x != "")


def recent_row(item: Column) -> Column:
    """item_key, title, authors, year, type, added, modified of a library item (data and meta structs)."""
    d = item["data"]
    return F.struct(d["key"].alias("item_key"), F.trim(F.coalesce(d["title"], F.lit(""))).alias("title"), display_names(d["creators"]).alias("authors"), year_of(item["meta"]["parsedDate"], d["date"]).alias("year"), d["itemType"].alias("type"), d["dateAdded"].alias("added"), d["dateModified"].alias("modified"))


#: Kinds of items that stand below others.
CHILD_TYPES = ("note", "attachment", "annotation")


def newest(items: DataFrame, limit: int = 10, order: str = "dateAdded", most: int = 100) -> DataFrame:
    """Rows (see recent_row) of the newest regular items of a library table (structs data and meta)."""
    rows = items.where(~F.coalesce(F.col("data.itemType").isin(*CHILD_TYPES), F.lit(False)))
    rows = rows.orderBy(F.desc(F.col(f"data.{order}")), F.col("data.key")).limit(min(limit, most))
    return rows.select(recent_row(F.struct("data", "meta")).alias("r")).select("r.*")


def translated_creators(creators: Column) -> Column:
    """Structs of creatorType, firstName, lastName, name: one-field names as name, empty ones dropped."""

    def one(c: Column) -> Column:
        kind = F.coalesce(_given(c["creatorType"]), F.lit("author")).alias("creatorType")
        name, first, last = _given(c["name"]), _given(c["firstName"]), _given(c["lastName"])
        none = F.lit(None).cast("string")
        whole = F.coalesce(name, F.when(c["fieldMode"] == 1, last))
        single = F.struct(kind, none.alias("firstName"), none.alias("lastName"), whole.alias("name"))
        double = F.struct(kind, first.alias("firstName"), last.alias("lastName"), none.alias("name"))
        return F.when(whole.isNotNull(), single).when(first.isNotNull() | last.isNotNull(), double)

    return F.filter(F.transform(creators, one), lambda x: x.isNotNull())


def translated_tags(tags: Column) -> Column:
    """Structs of tag and type, tidied, blank ones dropped."""
    return F.filter(F.transform(tags, lambda t: F.struct(tidy(t["tag"]).alias("tag"), t["type"].alias("type"))), lambda t: t["tag"] != "")


def context(title: Column, authors: Column, year: Column, abstract: Column) -> Column:
    """Lines that stand beside a document's vectors: title, authors, year, abstract, those that are not blank."""
    parts = F.array(title, F.when(F.size(authors) > 0, F.array_join(authors, ", ")), year, abstract)
    return F.array_join(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n")


def compact_home(path: Column, home: str) -> Column:
    """Home folder to ~."""
    return F.when(path == home, "~").when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 100_000))).otherwise(path)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def reference_title(values: Column) -> Column:
    """First text of a field that may hold several."""
    return first_text(values)
