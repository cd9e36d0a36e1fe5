"""A whole sync: previous catalog, bibliography files and artifacts to outcomes, work and the next catalog, and the run
that publishes artifacts, updates the keyword index, writes the catalog and the log.

Every attachment is one row of a join; its facts become an action, and the actions split the rows into what is
reused, moved, extracted or only recorded. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import search, sync
from .index import KeywordIndex, updated
from .publish import ArtifactStore


@dataclass(frozen=True)
class Plan:
    outcomes: DataFrame  # doc_key, item_key, action, carry, old_key
    extract: DataFrame  # attachments to extract
    moves: DataFrame  # old_key, new_key
    reuse: DataFrame  # doc_key of artifacts that stay
    sweep: DataFrame  # doc_key, kind


def plan(previous: DataFrame, files: DataFrame, artifacts: DataFrame, completed: bool, retry_errors: bool = False) -> Plan:
    """previous: catalog. files: doc_key, item_key, file_ext, supported, file_exists, size, mtime_ms. artifacts:
    doc_key with the columns of the reuse verdict; documents without a row have no artifact."""
    moves = sync.renames(previous, files.where("file_exists"))
    before = previous.select("doc_key", F.col("extract_status").alias("previous_status"), F.col("size").alias("p_size"), F.col("mtime_ms").alias("p_mtime"))
    have = artifacts.select("doc_key", (sync.reuse_verdict() == "reusable").alias("artifacts_reusable"), (F.col("manifest_exists") & F.col("normalized_exists") & ~F.col("normalized_empty")).alias("artifact_pair_present"))
    no = F.lit(False)
    rows = files.join(before, "doc_key", "left").join(have, "doc_key", "left").join(moves.withColumnRenamed("new_key", "doc_key"), "doc_key", "left")
    rows = rows.withColumns(
        {
            "is_pdf": F.col("file_ext") == "pdf",
            "size_mtime_unchanged": F.coalesce((F.col("size") == F.col("p_size")) & (F.col("mtime_ms") == F.col("p_mtime")), no),
            "artifacts_reusable": F.coalesce("artifacts_reusable", no),
            "artifact_pair_present": F.coalesce("artifact_pair_present", no),
            "previous_catalog_completed": F.lit(completed),
            "retry_errors": F.lit(retry_errors),
            "has_rename_candidate": F.col("old_key").isNotNull(),
        }
    )
    rows = rows.withColumn("t", sync.triage()).select(*files.columns, "old_key", "t.action", "t.carry")
    adopt = rows.where("action = 'adopt-then-extract'")
    touched = rows.where("action in ('reuse', 'extract', 'adopt-then-extract')").select("doc_key")
    return Plan(
        outcomes=rows.select("doc_key", "item_key", "action", "carry", "old_key"),
        extract=rows.where("action = 'extract'").select(*files.columns),
        moves=adopt.select("old_key", F.col("doc_key").alias("new_key")),
        reuse=rows.where("action = 'reuse'").select("doc_key"),
        sweep=sync.sweep(files.select("doc_key"), touched, artifacts.select("doc_key")),
    )


def statistics(outcomes: DataFrame) -> DataFrame:
    """One row of counts by action."""
    names = ("record-unsupported", "record-missing", "skip-unchanged-error", "adopt-then-extract", "reuse", "extract")
    return outcomes.agg(F.count("*").alias("attachments"), *[F.count_if(F.col("action") == n).alias(n.replace("-", "_")) for n in names])


def next_catalog(p: Plan, files: DataFrame, previous: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_key, item_key, file_ext, size, mtime_ms, extract_status, error, last_indexed_at. extracted: doc_key,
    error (null where it worked). Index times carry over only where the reuse says so."""
    result = extracted.select("doc_key", "error", F.lit(True).alias("tried"))
    old = previous.select("doc_key", F.col("last_indexed_at").alias("old_indexed"), F.col("error").alias("old_error"))
    rows = files.join(p.outcomes.select("doc_key", "action", "carry"), "doc_key").join(result, "doc_key", "left").join(old, "doc_key", "left")
    action = F.col("action")
    failed = F.col("error").isNotNull() | (action.isin("extract") & F.col("tried").isNull())
    status = F.when(action == "record-unsupported", "unsupported").when(action == "record-missing", "missing").when(action == "skip-unchanged-error", "error").when(action == "reuse", "ready").when(failed, "error").otherwise("ready")
    message = F.when(action == "skip-unchanged-error", F.col("old_error")).otherwise(F.coalesce("error", F.when(failed, F.lit("not extracted"))))
    return rows.select("doc_key", "item_key", "file_ext", "size", "mtime_ms", status.alias("extract_status"), message.alias("error"), F.when(F.coalesce("carry", F.lit(False)), F.col("old_indexed")).alias("last_indexed_at"))


def index_changes(p: Plan, previous: DataFrame, after: DataFrame) -> DataFrame:
    """doc_key, state for the keyword index: changed (extracted or moved and ready), removed (ready before only)."""
    moved = p.moves.select(F.col("new_key").alias("doc_key")).unionByName(p.extract.select("doc_key"))
    changed = moved.join(sync.ready(after).select("doc_key"), "doc_key", "left_semi").withColumn("state", F.lit("changed"))
    return changed.unionByName(sync.dropped_ready(previous, after).withColumn("state", F.lit("removed")))


def apply_to_index(postings: DataFrame, new: DataFrame, changes: DataFrame, rebuild: bool = False) -> DataFrame:
    return new if rebuild else updated(postings, new, changes)


#: Sections of the log in their order, and the outcomes each lists.
SECTIONS = (("Extracted", ("extract",)), ("Moved", ("adopt-then-extract",)), ("Unsupported", ("record-unsupported",)), ("Missing", ("record-missing",)), ("Skipped errors", ("skip-unchanged-error",)))


@dataclass
class SyncResult:
    counts: dict
    policy: dict
    removed: int
    log: str
    failed: dict = field(default_factory=dict)


@dataclass
class Sync:
    """Where a corpus lives. extract: attachments to extract -> (blocks, markdown (doc_key, markdown), errors (doc_key,
    error)); what it returns for a document counts as its whole extraction."""

    catalog: Catalog
    artifacts: ArtifactStore
    index: KeywordIndex
    extract: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]
    state: sync.IndexerState

    def facts(self, files: DataFrame, vertical: DataFrame) -> DataFrame:
        """The reuse verdict's columns of all stored artifacts."""
        rows = self.artifacts.rows()
        wanted = files.select("doc_key", F.col("item_key").alias("f_item"), "file_ext").join(vertical.select(F.col("item_key").alias("f_item"), F.lit(True).alias("wants")).distinct(), "f_item", "left")
        out = rows.join(wanted, "doc_key", "left")
        yes, no = F.lit(True), F.lit(False)
        pdf = F.coalesce(F.col("file_ext") == "pdf", no)
        return out.select(
            "doc_key",
            yes.alias("manifest_exists"),
            yes.alias("normalized_exists"),
            (F.trim(F.coalesce("markdown", F.lit(""))) == "").alias("normalized_empty"),
            yes.alias("manifest_readable"),
            F.size("blocks").alias("n_blocks"),
            F.coalesce(F.col("item_key") == F.col("f_item"), no).alias("identity_matches"),
            (~pdf | (F.coalesce("vertical", no) == F.coalesce("wants", no))).alias("vertical_matches"),
        )

    def run(self, files: DataFrame, vertical: DataFrame | None = None, retry_errors: bool = False, now: str = "", only_ready: bool = False) -> SyncResult:
        """One run. Order: plan; extract; publish, move and sweep in one step; keyword index; catalog last, so that a
        crash anywhere leaves a state the next run repairs. files: as for plan, with the catalog's other columns."""
        spark = files.sparkSession
        vertical = spark.createDataFrame([], "item_key string") if vertical is None else vertical
        previous, values = self.catalog.read()
        before = sync.IndexerState(values.get("model"), values.get("signature"))
        completed = bool(values.get("completed"))
        p = plan(previous, files, self.facts(files, vertical), completed, retry_errors)
        outcomes = p.outcomes.persist()
        work, moves, sweep = p.extract.persist(), p.moves.persist(), p.sweep.where("kind = 'orphan'").select("doc_key").persist()
        had_ready, n_moves, n_sweep = not sync.ready(previous).isEmpty(), moves.count(), sweep.count()

        blocks, markdown, errors = self.extract(work)
        wants = vertical.select("item_key", F.lit(True).alias("vertical")).distinct()
        items = work.select("doc_key", "item_key").join(wants, "item_key", "left").withColumn("vertical", F.coalesce("vertical", F.lit(False)))
        broken = errors.where("error is not null").select("doc_key", "error")
        fresh = ArtifactStore.pairs(blocks, markdown.join(broken.select("doc_key"), "doc_key", "left_anti"), items)
        published, refused = self.artifacts.apply(fresh, moves, sweep)
        extracted = published.withColumn("error", F.lit(None).cast("string")).unionByName(broken).unionByName(refused).persist()

        after = next_catalog(p, files, previous, extracted).persist()
        changes = index_changes(p, previous, after).persist()
        policy = sync.index_policy(self.state, before, had_ready, completed, changes.count(), 0, n_sweep)
        if policy["keyword_rebuild"] or not self.index.exists():
            ready = self.artifacts.blocks().join(sync.ready(after).select("doc_key"), "doc_key", "left_semi")
            self.index.rebuild(search.tokenised(ready))
        elif not policy["short_circuit"]:
            changed = changes.where("state = 'changed'").select("doc_key")
            self.index.apply(search.tokenised(self.artifacts.blocks().join(changed, "doc_key", "left_semi")), changes)
        stamped = after.withColumn("last_indexed_at", F.when(F.col("extract_status") == "ready", F.coalesce("last_indexed_at", F.lit(now))))
        rest = [c for c in files.columns if c not in stamped.columns and c != "file_exists"]
        self.catalog.write(stamped.join(files.select("doc_key", *rest), "doc_key"), model=self.state.model, signature=self.state.signature, completed=True)
        counts = statistics(outcomes).first().asDict()
        failed = {r.doc_key: r.error for r in extracted.where("error is not null").limit(1_000).collect()}
        return SyncResult(counts, policy, n_sweep, sync_log(outcomes, failed, counts, n_moves, now), failed)


def sync_log(outcomes: DataFrame, failed: dict[str, str], counts: dict, moves: int, now: str, most: int = 200) -> str:
    """The run as text: counts, then a section an outcome with at most `most` keys each, and how many more."""
    lines = [f"# Sync {now}".rstrip(), "", *[f"{k}: {v}" for k, v in counts.items()], f"moved: {moves}", f"failed: {len(failed)}"]
    for title, actions in SECTIONS:
        total = sum(counts[a.replace("-", "_")] for a in actions)
        if total:
            keys = [r.doc_key for r in outcomes.where(F.col("action").isin(*actions)).select("doc_key").orderBy("doc_key").limit(most).collect()]
            lines += ["", f"## {title} ({total})", *[f"- {k}" + (f": {failed[k]}" if k in failed else "") for k in keys], *([f"- and {total - most} more"] if total > most else [])]
    return "\n".join(lines) + "\n"
