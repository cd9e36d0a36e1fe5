"""Interfaces to what lies outside: extractors, item libraries, paper search. Tests use fakes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol


class Extractor(Protocol):
    """Turns files into element trees or markdown; has its own time limits."""

    def extract(self, paths: list[str]) -> dict[str, Extracted]: ...


@dataclass(frozen=True)
class Extracted:
    markdown: str | None = None
    elements_json: str | None = None
    error: str | None = None


class ItemSource(Protocol):
    """Item keys by tag and collection, and recent items."""

    def keys_with_tags(self, tags: list[str]) -> tuple[list[str], int]: ...

    def keys_in_collection(self, key: str) -> list[str]: ...

    def recent(self, start: int, size: int, order: str) -> list[dict]: ...


class PaperSource(Protocol):
    """Papers of an outside service, as the objects it returns."""

    def search(self, query: str, limit: int) -> list[dict]: ...

    def get(self, paper_id: str) -> dict | None: ...


class ItemSink(Protocol):
    def create(self, payload: dict) -> str: ...


class TruncatedError(RuntimeError):
    """A result holds fewer keys than its total says."""


def complete_keys(source: ItemSource, tags: list[str]) -> list[str]:
    keys, total = source.keys_with_tags(tags)
    if total > len(keys):
        raise TruncatedError(f"{len(keys)} of {total} keys")
    return keys


def extract_in_tiers(tiers: list[Extractor], paths: list[str]) -> dict[str, Extracted]:
    """Each tier gets what the earlier ones failed on; the last error stays."""
    done: dict[str, Extracted] = {}
    for tier in tiers:
        left = [p for p in paths if p not in done or done[p].error]
        if left:
            done |= tier.extract(left)
    return done


def create_with_children(sink: ItemSink, parent: dict, children: list[dict]) -> tuple[str, list[str]]:
    """The parent's key; children that fail become warnings."""
    key, warnings = sink.create(parent), []
    for child in children:
        try:
            sink.create({**child, "parentItem": key})
        except Exception as e:  # noqa: BLE001  the parent stands
            warnings.append(f"{child.get('itemType', 'child')}: {e}")
    return key, warnings


def recent_items(source: ItemSource, limit: int, order: str = "dateAdded", page: int = 50, most: int = 100) -> list[dict]:
    """The newest regular items: pages are read, notes and attachments skipped, until there are enough."""
    out: list[dict] = []
    start = 0
    while len(out) < min(limit, most):
        rows = source.recent(start, page, order)
        out += [r for r in rows if r.get("itemType") not in ("note", "attachment")]
        start += len(rows)
        if len(rows) < page:
            break
    return out[: min(limit, most)]
