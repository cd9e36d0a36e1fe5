"""Snapshot sync: what a run does with each attachment, as expressions over joined catalogs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that must not differ for an entry to count as unchanged.
CONTENT = ("item_key", "citation_key", "title", "authors", "year", "abstract", "type", "file_path", "file_ext", "size", "mtime_ms", "extract_status")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    states = ("ready", "missing", "unsupported", "error")
    return catalog.agg(F.count("*").alias("total"), F.count_if("supported").alias("supported"), *[F.count_if(F.col("extract_status") == s).alias(s) for s in states])


def ready(catalog: DataFrame) -> DataFrame:
    return catalog.where("extract_status = 'ready'")


def filter_items(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """None lets all through; an empty frame lets none through."""
    return rows if keys is None else rows.join(keys.select("item_key").distinct(), "item_key", "left_semi")


def unindexed(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    return keys.select("item_key").distinct().join(ready(catalog).select("item_key"), "item_key", "left_anti")


def with_all_tags(item_tags: DataFrame, tags: list[str]) -> DataFrame:
    wanted = [t for t in dict.fromkeys(t.strip() for t in tags) if t]
    return item_tags.where(F.col("tag").isin(wanted)).groupBy("item_key").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("item_key")


def in_collections(item_collections: DataFrame, collections: list[str]) -> DataFrame:
    return item_collections.where(F.col("collection_key").isin(collections)).select("item_key").distinct()


def prefer(attachments: DataFrame, better: str = "epub", worse: str = "pdf") -> DataFrame:
    """Where an item has a file of the better kind, its files of the worse kind go."""
    has = attachments.where(F.col("file_ext") == better).select("item_key").distinct().withColumn("__has", F.lit(True))
    out = attachments.join(has, "item_key", "left").where(~((F.col("file_ext") == worse) & F.coalesce("__has", F.lit(False))))
    return out.drop("__has")


def exclude(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("item_key").distinct(), "item_key", "left_anti")


def unmatched_exclusions(keys: DataFrame, records: DataFrame, attachments: DataFrame) -> DataFrame:
    seen = records.select("item_key").unionByName(attachments.select("item_key")).distinct()
    return keys.select("item_key").distinct().join(seen, "item_key", "left_anti")


def reuse_verdict() -> Column:
    """Why an artifact cannot be reused, by the first rule that refuses it; `reusable` if none does."""
    c = F.col
    return (
        F.when(~c("manifest_exists") | ~c("normalized_exists"), "missing")
        .when(c("normalized_empty"), "empty-normalized")
        .when(~c("manifest_readable"), "unreadable")
        .when(c("n_blocks") == 0, "no-blocks")
        .when(~c("identity_matches"), "identity-mismatch")
        .when(~c("vertical_matches"), "vertical-mismatch")
        .otherwise("reusable")
    )


def triage() -> Column:
    """struct(action, carry) from the ten facts of an attachment; carry: its index state still holds."""
    c = F.col
    was = F.coalesce(c("previous_status"), F.lit("never"))
    usable = F.when(c("previous_catalog_completed") & ~c("is_pdf"), c("artifact_pair_present")).otherwise(c("artifacts_reusable"))
    same = (was == "ready") & c("size_mtime_unchanged") & usable
    stale = (was == "ready") & ~c("size_mtime_unchanged")
    action = (
        F.when(~c("supported"), "record-unsupported")
        .when(~c("file_exists"), "record-missing")
        .when((was == "error") & c("size_mtime_unchanged") & ~c("artifacts_reusable") & ~c("retry_errors"), "skip-unchanged-error")
        .when((was == "never") & ~c("artifacts_reusable") & c("has_rename_candidate"), "adopt-then-extract")
        .when(same, "reuse")
        .when(stale | ~c("artifacts_reusable"), "extract")
        .otherwise("reuse")
    )
    return F.struct(action.alias("action"), F.when(action == "reuse", same).alias("carry"))


def renames(previous: DataFrame, next_: DataFrame) -> DataFrame:
    """old_key, new_key: a new attachment whose item, size and time match exactly one previous ready one that
    dropped out of the bibliography."""
    triple = ["item_key", "size", "mtime_ms"]
    gone = ready(previous).join(next_.select("doc_key"), "doc_key", "left_anti")
    single = ready(previous).groupBy(*triple).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    old = gone.join(single, triple, "left_semi").select(*triple, F.col("doc_key").alias("old_key"))
    fresh = next_.join(previous.select("doc_key"), "doc_key", "left_anti").select(*triple, F.col("doc_key").alias("new_key"))
    return fresh.join(old, triple).select("old_key", "new_key")


def adopted(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """Blocks under the new key, unchanged otherwise."""
    m = moves.select(F.col("old_key").alias("doc_key"), "new_key")
    return blocks.join(m, "doc_key", "left").withColumn("doc_key", F.coalesce("new_key", "doc_key")).drop("new_key")


def unchanged(previous: DataFrame, next_: DataFrame) -> DataFrame:
    """doc_key, state: added, removed, changed or unchanged, comparing all content null-safely."""
    columns = [c for c in CONTENT if c in previous.columns and c in next_.columns]
    p, n = previous.select("doc_key", F.struct(*columns).alias("p")), next_.select("doc_key", F.struct(*columns).alias("n"))
    state = F.when(F.col("p").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("p").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return p.join(n, "doc_key", "full_outer").select("doc_key", state.alias("state"))


def sweep(expected: DataFrame, touched: DataFrame, on_disk: DataFrame) -> DataFrame:
    """doc_key, kind: stale (expected but not touched) and orphan (on disk but neither)."""
    e, t, d = (x.select("doc_key").distinct() for x in (expected, touched, on_disk))
    stale = e.join(t, "doc_key", "left_anti").withColumn("kind", F.lit("stale"))
    return stale.unionByName(d.join(e.unionByName(t).distinct(), "doc_key", "left_anti").withColumn("kind", F.lit("orphan")))


def dropped_ready(previous: DataFrame, next_: DataFrame) -> DataFrame:
    return ready(previous).select("doc_key").join(ready(next_).select("doc_key"), "doc_key", "left_anti")


def context_changes(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_key, action: remove, write or keep, from doc_key and context on both sides."""
    d, s = desired.select("doc_key", F.col("context").alias("d")), stored.select("doc_key", F.col("context").alias("s"))
    action = F.when(F.col("d").isNull(), "remove").when(F.col("d").eqNullSafe(F.col("s")), "keep").otherwise("write")
    return d.join(s, "doc_key", "full_outer").select("doc_key", action.alias("action"))


def key_conflicts(entries: DataFrame) -> DataFrame:
    """citation_key, item_key (null if several), item_keys: what a citation key resolves to."""
    keys = F.array_sort(F.collect_set("item_key"))
    out = entries.where("citation_key is not null").groupBy("citation_key").agg(keys.alias("ks"))
    return out.select("citation_key", F.when(F.size("ks") == 1, F.get("ks", F.lit(0))).alias("item_key"), F.array_join("ks", ",").alias("item_keys"))


def batches(files: list[dict], most: int = 8, solo_bytes: int = 20 << 20) -> list[list[dict]]:
    """Greedy extraction batches in order: books, chapters, large and vertical files alone; no equal stems together."""
    out: list[list[dict]] = []
    open_: list[dict] = []
    for f in files:
        stem = f["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
        alone = f.get("type") in ("book", "chapter") or f.get("size", 0) >= solo_bytes or f.get("vertical")
        clash = any(stem == x["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() for x in open_)
        if open_ and (alone or clash or len(open_) >= most):
            out.append(open_)
            open_ = []
        if alone:
            out.append([f])
        else:
            open_.append(f)
    return out + ([open_] if open_ else [])


@dataclass(frozen=True)
class IndexerState:
    model: str | None
    signature: str | None


def signature(parts: dict[str, str]) -> str:
    return hashlib.sha1("\n".join(f"{k}={v}" for k, v in parts.items()).encode()).hexdigest()


def index_policy(current: IndexerState, previous: IndexerState, had_ready: bool, completed: bool, changed: int = 0, stale: int = 0, orphans: int = 0, all_match: bool = True) -> dict[str, object]:
    """What the index phase does: reset vectors (model changed and there may be some), rebuild the keyword index,
    skip everything; and the state that progress writes may record until vectors are cleared."""
    known = bool(previous.model and previous.signature)
    model_changed, signature_changed = previous.model != current.model, previous.signature != current.signature
    reset = model_changed and (had_ready or known)
    quiet = not (changed or stale or orphans) and all_match
    return {
        "reset_vectors": reset,
        "keyword_rebuild": not completed or signature_changed,
        "short_circuit": completed and not model_changed and not signature_changed and quiet,
        "progress_state": (previous if known else None) if reset else current,
    }
