"""Adding items to a library: metadata looked up by DOI, identifier or page, files to link, and batches in order.

Network access is a Transport; nothing here opens a connection.
"""

from __future__ import annotations

import json
import mimetypes
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import quote

from ..functions.lenient import InputError, clean_doi, lenient_item, payload, read_batch
from .connectors import ItemSink, create_with_children


@dataclass(frozen=True)
class Response:
    status: int
    text: str


class Transport(Protocol):
    def get(self, url: str, accept: str) -> Response: ...

    def post(self, url: str, body: str, content_type: str) -> Response: ...


class LookupFailed(RuntimeError):
    """Carries a code for the command's envelope."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Choices:
    """Candidates of a page that lists several items: key -> title."""

    titles: dict[str, str]


@dataclass(frozen=True)
class Lookup:
    transport: Transport
    translator: str
    resolver: str = "https://doi.org"

    def doi(self, text: str) -> dict:
        """The citation record of a DOI."""
        doi = clean_doi(text)
        if doi is None:
            raise LookupFailed("INVALID_IDENTIFIER", f"{text} is no DOI")
        found = self._ok(self.transport.get(f"{self.resolver}/{quote(doi, safe='/')}", "application/vnd.citationstyles.csl+json"), "DOI_NOT_FOUND")
        record = self._json(found)
        if not isinstance(record, dict):
            raise LookupFailed("DOI_NOT_FOUND", f"{doi} has no citation record")
        return record

    def identifier(self, text: str) -> list[dict]:
        """Items of a DOI, ISBN or other identifier, by the translation service."""
        if not text.strip():
            raise LookupFailed("INVALID_IDENTIFIER", "an identifier is needed")
        answer = self.transport.post(f"{self.translator}/search", text.strip(), "text/plain")
        return self._items(self._ok(answer, "IDENTIFIER_NOT_FOUND", missing=(400, 501)))

    def page(self, url: str, select: str | None = None) -> list[dict] | Choices:
        """Items of a page. Where the service offers several (status 300), those are returned as choices, or the
        selected one is asked for in the same session."""
        answer = self.transport.post(f"{self.translator}/web", url, "text/plain")
        if answer.status != 300:
            return self._items(self._ok(answer, "TRANSLATION_NO_ITEMS", missing=(501,)))
        offer = self._json(answer.text)
        listed = offer.get("items") if isinstance(offer, dict) else None
        titles = {k: v if isinstance(v, str) else (v or {}).get("title") or k for k, v in listed.items()} if isinstance(listed, dict) else {}
        if not titles:
            raise LookupFailed("TRANSLATION_NO_ITEMS", f"{url} offers no items")
        if select is None:
            return Choices(titles)
        if select not in titles:
            raise LookupFailed("INVALID_SELECT_KEY", f"{select} is none of {', '.join(titles)}")
        again = json.dumps({"url": offer.get("url") or url, "session": offer.get("session"), "items": {select: listed[select]}})
        return self._items(self._ok(self.transport.post(f"{self.translator}/web", again, "application/json"), "TRANSLATION_NO_ITEMS"))

    @staticmethod
    def _ok(answer: Response, code: str, missing: tuple[int, ...] = (404,)) -> str:
        if answer.status in missing:
            raise LookupFailed(code, answer.text.strip()[:200] or "nothing found")
        if not 200 <= answer.status < 300:
            raise LookupFailed("LOOKUP_FAILED", f"status {answer.status}: {answer.text.strip()[:200]}")
        return answer.text

    @staticmethod
    def _json(text: str) -> object:
        try:
            return json.loads(text)
        except ValueError as e:
            raise LookupFailed("LOOKUP_FAILED", f"the answer is no JSON: {e}") from e

    def _items(self, text: str) -> list[dict]:
        value = self._json(text)
        if not isinstance(value, list):
            raise LookupFailed("LOOKUP_FAILED", "the answer is no list of items")
        return [x for x in value if isinstance(x, dict)]


def one_item(items: list[dict]) -> tuple[dict, list[dict], list[str]]:
    """The first regular item of a translation, the notes below it, and warnings of what is left out."""
    regular = [x for x in items if x.get("itemType") and x["itemType"] not in ("note", "attachment")]
    if not regular:
        raise LookupFailed("TRANSLATION_NO_ITEMS", "no regular item was found")
    chosen = regular[0]
    mine = chosen.get("key")
    notes = [{"itemType": "note", "note": x["note"]} for x in items if x.get("itemType") == "note" and mine and x.get("parentItem") == mine and str(x.get("note") or "").strip()]
    return chosen, notes, [f"{len(regular) - 1} further items are left out"] if len(regular) > 1 else []


@dataclass(frozen=True)
class LinkedFile:
    path: str
    name: str
    content_type: str
    stored_path: str


def linked_file(path: str, root: str | None = None) -> LinkedFile:
    """A file to link: it must be there and regular; below the root its stored path is portable."""
    if not path.strip():
        raise InputError("the path of the file is empty")
    full = os.path.abspath(os.path.expanduser(path.strip()))
    if not os.path.exists(full):
        raise InputError(f"there is no file {full}")
    if not os.path.isfile(full):
        raise InputError(f"{full} is no regular file")
    below = root and os.path.commonpath([full, os.path.abspath(root)]) == os.path.abspath(root)
    kind = "application/epub+zip" if full.lower().endswith(".epub") else mimetypes.guess_type(full)[0]
    return LinkedFile(full, os.path.basename(full), kind or "application/octet-stream", f"attachments:{os.path.relpath(full, root)}" if below else full)


@dataclass
class Adder:
    """Creates items through a sink. template: item type -> its empty fields."""

    sink: ItemSink
    template: Callable[[str], dict]
    root: str | None = None
    collection: str | None = None
    tag: str | None = "added-by-agent"
    made: list[str] = field(default_factory=list)

    def add(self, item: dict, notes: list[dict] | None = None, collection: str | None = None) -> dict:
        """One lenient item. Its file is checked before anything is created; children that fail are warnings."""
        attach = linked_file(item["attachFile"], self.root) if item.get("attachFile") else None
        wanted = [collection] if collection else item["collections"] or ([self.collection] if self.collection else [])
        body = payload({**item, "collections": wanted}, self.template(item["itemType"]), self.tag)
        children = list(notes or [])
        if attach:
            children.append({"itemType": "attachment", "linkMode": "linked_file", "title": attach.name, "path": attach.stored_path, "contentType": attach.content_type})
        key, warnings = create_with_children(self.sink, body, children)
        self.made.append(key)
        return {"ok": True, "key": key, "title": item["title"], "itemType": item["itemType"], "warnings": [*item["warnings"], *warnings]}

    def add_raw(self, raw: object, collection: str | None = None) -> dict:
        try:
            return self.add(lenient_item(raw), collection=collection)
        except InputError as e:
            return {"ok": False, "code": "INVALID_ITEM", "error": str(e)}
        except Exception as e:  # noqa: BLE001  one item's failure is its own result
            return {"ok": False, "code": "CREATE_FAILED", "error": str(e)}

    def add_batch(self, text: str, collection: str | None = None) -> list[dict]:
        """One result an input, in the inputs' order, failed ones in their places."""
        return [{"ordinal": i, **self.add_raw(raw, collection)} for i, raw in enumerate(read_batch(text))]

    def add_translated(self, items: list[dict], collection: str | None = None) -> dict:
        chosen, notes, warnings = one_item(items)
        fields = {k: v for k, v in chosen.items() if k not in ("itemType", "title", "key", "collections", "notes", "attachments")}
        item = {"itemType": chosen["itemType"], "title": str(chosen.get("title") or "").strip(), "fields": fields, "collections": [], "attachFile": None, "warnings": warnings}
        return self.add(item, notes, collection)

    def add_citation(self, record: dict, collection: str | None = None) -> dict:
        """A citation record by DOI."""
        text = lambda k: next((x for x in (record.get(k) if isinstance(record.get(k), list) else [record.get(k)]) if isinstance(x, str) and x.strip()), "")
        parts = ((record.get("issued") or {}).get("date-parts") or [[]])[0]
        date = "-".join(f"{int(x):02d}" if i else str(x) for i, x in enumerate(parts) if x is not None)
        people = [{"creatorType": "author"} | ({"name": a["literal"]} if a.get("literal") else {"firstName": a.get("given") or "", "lastName": a.get("family") or ""}) for a in record.get("author") or [] if isinstance(a, dict)]
        raw = {"itemType": CITED_TYPES.get(record.get("type"), "journalArticle"), "title": text("title"), "DOI": text("DOI"), "publicationTitle": text("container-title"), "date": date, "publisher": text("publisher"), "url": text("URL"), "abstract": text("abstract")}
        return self.add(lenient_item({k: v for k, v in raw.items() if v} | ({"creators": people} if people else {})), collection=collection)


#: Item types of citation records.
CITED_TYPES = {"article-journal": "journalArticle", "book": "book", "chapter": "bookSection", "paper-conference": "conferencePaper", "report": "report", "thesis": "thesis", "webpage": "webpage"}
