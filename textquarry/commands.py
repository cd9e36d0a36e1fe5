"""Commands: arguments checked, operators run, rows returned in a JSON envelope."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.lenient import InputError
from .functions.papers import paper, paper_item
from .operators import blocks as B
from .operators import diagnose, metadata, retrieve, search, sync
from .operators.index import KeywordIndex
from .operators.semantic import search as vector_search
from .operators.vectors import Embedder
from .plans.query import QuerySyntaxError
from .sources.adding import Adder, Choices, Lookup, LookupFailed
from .sources.connectors import ItemSource, PaperSource, complete_keys, recent_items


def ok(data: object, **meta: object) -> str:
    return json.dumps({"ok": True, "data": data} | ({"meta": meta} if meta else {}), ensure_ascii=False)


def error(code: str, message: str, **details: object) -> str:
    return json.dumps({"ok": False, "error": {"code": code, "message": message} | ({"details": details} if details else {})}, ensure_ascii=False)


def rows_of(df: DataFrame) -> list[dict]:
    """Rows as objects; absent values are left out."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


@dataclass(frozen=True)
class Config:
    """What a corpus is made of; overrides go before the environment, a file and the defaults."""

    data_dir: str = "data"
    attachments_root: str | None = None
    vertical_tag: str | None = None
    excluded_tag: str | None = None
    warnings: tuple[str, ...] = field(default=())

    @staticmethod
    def resolve(overrides: dict | None = None, env: dict | None = None, file: dict | None = None) -> Config:
        env = os.environ if env is None else env
        out, warnings = Config(), []
        for name in ("data_dir", "attachments_root", "vertical_tag", "excluded_tag"):
            found = [x.get(k) for x, k in ((overrides or {}, name), (env, f"TEXTQUARRY_{name.upper()}"), (file or {}, name)) if x.get(k)]
            if found:
                out = replace(out, **{name: found[0]})
        for k in file or {}:
            if k not in Config.__dataclass_fields__:
                warnings.append(f"unknown setting {k}")
        return replace(out, warnings=tuple(warnings))


class Usage(ValueError):
    """An argument that a command does not take."""


def positive(name: str, value: float, least: float = 1) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < least:
        raise Usage(f"{name} must be a number of at least {least}")
    return value


def collection_keys(keys: list[str]) -> list[str]:
    bad = [k for k in keys if not re.fullmatch("[A-Z0-9]{8}", k)]
    if bad:
        raise Usage(f"not a collection key: {bad[0]}")
    return list(dict.fromkeys(keys))


@dataclass
class Corpus:
    """Tables of one corpus: catalog, blocks (annotated), records."""

    catalog: DataFrame
    blocks: DataFrame
    records: DataFrame | None = None
    #: Stored texts (doc_key, markdown), the keyword index, chunk vectors (doc_key, seq, pos, len, embedding).
    normalized: DataFrame | None = None
    index: KeywordIndex | None = None
    chunks: DataFrame | None = None
    embedder: Embedder | None = None
    #: Cuts a passage column to its token budget (see functions.budget).
    cap: Callable[[Column], Column] | None = None
    library: ItemSource | None = None
    paper_source: PaperSource | None = None
    lookup: Lookup | None = None
    adder: Adder | None = None

    def _item(self, key: str) -> tuple[DataFrame, DataFrame]:
        """Attachments and merged blocks of an item key, or of a citation key (with or without @) that names one."""
        ready = sync.ready(self.catalog)
        if not re.fullmatch("[A-Z0-9]{8}", key):
            found = sync.key_conflicts(ready.where(F.col("citation_key") == key.removeprefix("@"))).first()
            if found is None:
                raise Usage(f"no item is cited as {key}")
            if found.item_key is None:
                raise Usage(f"{key} names several items: {found.item_keys}")
            key = found.item_key
        files = ready.where(F.col("item_key") == key)
        if files.isEmpty():
            raise Usage(f"no ready attachment of {key}")
        merged = B.merge_items(self.blocks.join(files.select("doc_key"), "doc_key", "left_semi"), files)
        return files, merged.withColumnRenamed("item_key", "doc_key")

    def run(self, command: str, **arguments: object) -> str:
        try:
            return ok(getattr(self, f"_{command}")(**arguments))
        except (Usage, TypeError, AttributeError) as e:
            return error("INVALID_ARGUMENT", str(e))
        except QuerySyntaxError as e:
            return error("INVALID_QUERY", str(e))
        except LookupFailed as e:
            return error(e.code, str(e))
        except InputError as e:
            return error("INVALID_ITEM", str(e))

    def _found(self, hits: DataFrame) -> list[dict]:
        """Hits with their items, passages within the token budget."""
        hits = hits.withColumn("passage", self.cap(F.col("passage"))) if self.cap else hits
        return rows_of(hits.join(sync.ready(self.catalog).select("doc_key", "item_key", "title"), "doc_key").orderBy(F.desc("score"), "doc_key"))

    def _search(self, query: str, limit: int = 10, min_score: float | None = None, item_keys: DataFrame | None = None, semantic: bool = False, tags: list[str] | None = None) -> list[dict]:
        """Keyword search, by the stored index where there is one; or the nearest chunks' documents."""
        n = int(positive("limit", limit))
        allowed = None if item_keys is None else sync.filter_items(sync.ready(self.catalog), item_keys)
        if tags:
            if semantic:
                raise Usage("semantic search takes no tags")
            keys = self._tagged(tags)
            allowed = sync.filter_items(sync.ready(self.catalog) if allowed is None else self.catalog.join(allowed.select("doc_key"), "doc_key", "left_semi"), keys)
        if semantic:
            if self.embedder is None or self.chunks is None:
                raise Usage("semantic search needs vectors and an embedder")
            if not query.strip():
                raise QuerySyntaxError("a query cannot be empty")
            ready = sync.ready(self.catalog) if allowed is None else allowed
            return self._found(vector_search(self.chunks, self.blocks, B.rendered(self.blocks), self.embedder.embed([query])[0], n, min_score, ready))
        if self.index is not None and self.index.exists():
            hits = search.search_index(self.index.posts.read(), self.index.stats.read(), query, n, allowed)
            hits = hits if min_score is None else hits.where(F.col("score") >= min_score)
        else:
            hits = search.search(self.blocks, query, n, min_score, allowed=allowed)
        few = self.blocks.join(F.broadcast(hits.select("doc_key")), "doc_key", "left_semi")
        return self._found(search.passages(hits, few, B.rendered(few), query))

    def _tagged(self, tags: list[str]) -> DataFrame:
        if self.library is None:
            raise Usage("tags need a library")
        keys = complete_keys(self.library, tags)
        return self.catalog.sparkSession.createDataFrame([(k,) for k in keys], "item_key string")

    def _search_in(self, query: str, key: str, limit: int = 10) -> list[dict]:
        return rows_of(search.search_in(self._item(key)[1], query, int(positive("limit", limit))))

    def _metadata(self, query: str = "", limit: int = 20, fields: list[str] | None = None, filters: dict | None = None, has_file: bool = False, abstract: bool = False) -> list[dict]:
        if not query.strip() and not filters:
            raise Usage("a query or a filter is needed")
        unknown = set(fields or ()) | set(filters or ())
        if unknown - set(metadata.WEIGHTS):
            raise Usage(f"unknown field {sorted(unknown - set(metadata.WEIGHTS))[0]}")
        found = metadata.search_metadata(self.records, query, fields, filters, has_file, limit=int(positive("limit", limit)))
        if abstract:
            found = found.join(self.records.select("item_key", "abstract"), "item_key").orderBy(F.desc("score"), F.desc("has_supported_file"), F.collate("title", "UNICODE"), "item_key")
        return rows_of(found)

    def _page(self, key: str, offset: int = 0, limit: int = 20) -> list[dict]:
        return rows_of(retrieve.page(self._item(key)[1], int(positive("offset", offset, 0)), int(positive("limit", limit))).select("block_index", "block_type", "text", "char_start", "char_end").orderBy("block_index"))

    def _fulltext(self, key: str, clean: bool = False) -> list[dict]:
        """The cleaned blocks, or the text: of one attachment its stored text, of several all, each below its heading."""
        files, merged = self._item(key)
        if clean:
            return rows_of(retrieve.clean_fulltext(merged))
        if self.normalized is None:
            return rows_of(retrieve.fulltext(merged))
        own = self.blocks.join(files.select("doc_key"), "doc_key", "left_semi")
        return rows_of(retrieve.item_text(retrieve.fulltext(own, self.normalized), files))

    def _expand(self, key: str, offset: int, radius: int = 1000) -> list[dict]:
        merged = self._item(key)[1]
        return rows_of(retrieve.expand(B.rendered(merged), merged, int(positive("offset", offset, 0)), int(positive("radius", radius))))

    def _diagnose(self, limit: int = 50, everything: bool = False, mean: float = diagnose.MEAN, median: float = diagnose.MEDIAN) -> list[dict]:
        return rows_of(diagnose.diagnose(self.blocks, int(positive("limit", limit)), everything, t_mean=positive("mean", mean, 1e-9), t_median=positive("median", median, 1e-9)))

    def _status(self) -> list[dict]:
        out = rows_of(sync.catalog_counts(self.catalog))
        if self.index is not None and self.index.exists():
            stats = self.index.stats.read()
            indexed = stats.select("doc_key").distinct()
            out[0] |= {"indexed_blocks": stats.count(), "indexed_documents": indexed.count(), "unindexed_documents": sync.ready(self.catalog).select("doc_key").distinct().join(indexed, "doc_key", "left_anti").count(), "index_version": self.index.posts.version()}
        return out

    def _recent(self, limit: int = 10, order: str = "dateAdded") -> list[dict]:
        if self.library is None:
            raise Usage("recent items need a library")
        if order not in ("dateAdded", "dateModified"):
            raise Usage("order is dateAdded or dateModified")
        return recent_items(self.library, int(positive("limit", limit)), order)

    def _s2(self, query: str, limit: int = 10) -> list[dict]:
        """Papers of an outside search, as rows."""
        if self.paper_source is None:
            raise Usage("papers need a source")
        if not query.strip():
            raise Usage("a query is needed")
        found = [(i, json.dumps(p)) for i, p in enumerate(self.paper_source.search(query, int(positive("limit", limit))))]
        rows = self.catalog.sparkSession.createDataFrame(found, "at int, json string").select("at", paper(F.col("json")).alias("p")).where("p is not null")
        return rows_of(rows.orderBy("at").select("p.*"))

    def _add(self, json_text: str | None = None, doi: str | None = None, identifier: str | None = None, url: str | None = None, select: str | None = None, paper_id: str | None = None, collection: str | None = None) -> object:
        """Adds what one of the sources gives; a page that offers several items answers with the choices."""
        given = [x for x in (json_text, doi, identifier, url, paper_id) if x is not None]
        if self.adder is None or len(given) != 1:
            raise Usage("one of json_text, doi, identifier, url, paper_id, and a library to add to, are needed")
        if collection is not None:
            collection_keys([collection])
        if json_text is not None:
            return self.adder.add_batch(json_text, collection)
        if paper_id is not None:
            raw = self.paper_source.get(paper_id) if self.paper_source else None
            if raw is None:
                raise Usage(f"no paper {paper_id}")
            return self.adder.add_raw(paper_item(raw), collection)
        if self.lookup is None:
            raise Usage("a lookup is needed")
        if doi is not None:
            return self.adder.add_citation(self.lookup.doi(doi), collection)
        items = self.lookup.identifier(identifier) if identifier is not None else self.lookup.page(url, select)
        return {"choices": items.titles} if isinstance(items, Choices) else self.adder.add_translated(items, collection)
