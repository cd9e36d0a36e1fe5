"""Line dedup (operator 10): levelled sorted runs of line hashes.

A run is a Parquet table (key, n) sorted by key: how many documents of some batches hold a line. Every
new batch is counted, merge-anti-joined with the settled keys (those known to be in enough documents
already, which need no more counting) and added as a run of level 0; whenever a level has `fanout` runs
they are merged into one run of the next level. Keys are 64-bit hashes of the stripped, lower-cased
line: among 10^10 distinct lines and 10^6 settled ones, the chance that any rare line shares the hash
of a settled one is about 5 in 10 000.

Every row is a document of its own, so repeated rows count as often as they stand there. Null or empty
text is one empty line; keys of no code point are never dropped. Long texts are split whole; an empty table
gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import once
from .common import few, map_arrow, materialize, scratch_path
from .words import LOWER_BYTES, texts

BLANK = b" \t\n\x0b\x0c\r"
#: Settled keys up to this number (8 MB) are sent to every executor; above it, lines and keys are joined.
BROADCAST_KEYS = 1_000_000
#: Batches of a table: with runs merged by four, level 0 is compacted four times and level 1 once.
BATCHES = 16


def line_key(line: bytes) -> int | None:
    key = line.strip(BLANK).translate(LOWER_BYTES)
    return xxhash.xxh3_64_intdigest(key) - (1 << 63) if key else None


class LineRuns:
    """The runs, below one shared folder. Only paths and levels live on the driver."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path, self.n, self.levels, self.settled = scratch_path(spark, "line-runs"), 0, [[]], []

    def _write(self, counts: DataFrame) -> str:
        self.n += 1
        path = f"{self.path}/run-{self.n:05d}"
        counts.sortWithinPartitions("key").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key long, n long").parquet(*paths)

    def add(self, batch: DataFrame) -> None:
        """batch: a column key, one row for each document and distinct line of it."""
        counts = batch.groupBy("key").agg(F.count("*").alias("n"))
        if self.settled:
            counts = counts.join(self._read(self.settled).hint("merge"), "key", "left_anti")
        self.levels[0].append(self._write(counts))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                self.compact(k)

    def compact(self, k: int) -> None:
        """Merges the runs of level k; keys that have reached the limit move to the settled runs."""
        merged = self._read(self._write_merged(self.levels[k]))
        self.levels[k] = []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.settled.append(self._write(merged.where(F.col("n") >= self.min_docs)))
        self.levels[k + 1].append(self._write(merged.where(F.col("n") < self.min_docs)))

    def _write_merged(self, paths: list[str]) -> list[str]:
        return [self._write(self._read(paths).groupBy("key").agg(F.sum("n").alias("n")))]

    def frequent(self) -> DataFrame:
        """Keys in at least min_docs documents so far."""
        open_runs = [p for level in self.levels for p in level]
        found = []
        if open_runs:
            found.append(self._read(open_runs).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("key"))
        if self.settled:
            found.append(self._read(self.settled).select("key"))
        return reduce(DataFrame.unionByName, found).distinct()


def keys_of(docs: DataFrame, batches: int) -> DataFrame:
    """key and batch, one row for each document and distinct key of it."""

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, of = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                found = {*map(line_key, text.split(b"\n"))} - {None}
                out += found
                of += [zlib.crc32(str(doc).encode()) % batches] * len(found)
            yield pa.RecordBatch.from_pydict({"key": pa.array(out, pa.int64()), "batch": pa.array(of, pa.int32())})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").transform(map_arrow, keys, "key long, batch int")


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, text (without the lines found in at least min_docs documents), n_lines, n_dropped."""
    spark = docs.sparkSession
    path = scratch_path(spark, "line-keys")
    keys_of(docs, batches).write.partitionBy("batch").parquet(path)
    arrived, runs = spark.read.schema("key long, batch int").parquet(path), LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(arrived.where(F.col("batch") == b).select("key"))
    frequent = materialize(runs.frequent(), "frequent-lines")
    if few(frequent, broadcast_keys):
        return _drop_by_broadcast(docs, frequent)
    return _drop_by_join(docs, frequent)


def _drop_by_broadcast(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.key for r in frequent.collect()], dtype=np.int64)))

    def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        for batch in it:
            kept, total, gone = [], [], []
            for text in texts(batch, "text"):
                lines = text.split(b"\n")
                found = [line_key(x) for x in lines]
                values = np.array([x or 0 for x in found], dtype=np.int64)
                at = np.searchsorted(keys, values)
                hit = (keys[np.minimum(at, len(keys) - 1)] == values) & np.array([x is not None for x in found]) if len(keys) else np.zeros(len(lines), bool)
                rest = [x for x, h in zip(lines, hit, strict=True) if not h]
                kept.append(b"\n".join(rest))
                total.append(len(lines))
                gone.append(len(lines) - len(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, drop, "doc_id long, text string, n_lines long, n_dropped long")


def _drop_by_join(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """For more keys than may be sent around: positions are joined with the keys, then with the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))

    def positions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [(r, i, k) for r, t in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True) for i, k in enumerate(map(line_key, t.split(b"\n"))) if k is not None]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["row", "pos", "key"])

    at = rows.select("row", "text").transform(map_arrow, positions, "row long, pos int, key long")
    gone = at.join(frequent, "key", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("gone"))
    # Places are subtracted as sets, in time linear in the lines.
    out = once(rows.join(gone, "row", "left"), lines=F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rest = F.transform(kept, lambda i: F.get("lines", i))
    return out.select("doc_id", F.array_join(rest, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
