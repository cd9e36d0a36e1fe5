"""The catalog on a store: versions behind a pointer, broken ones moved aside, paths below the home folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.papers import compact_home
from ..operators.index import Pointer

SCHEMA = "doc_key string, item_key string, citation_key string, title string, authors array<string>, year string, abstract string, type string, file_path string, file_ext string, supported boolean, exists boolean, size long, mtime_ms long, extract_status string, error string, source_hash string, last_indexed_at string"
#: Fixed value: a home folder of another machine.
FOREIGN_HOME = r"^/(?:Users|home)/[^/]+"


class Catalog:
    """Entries (SCHEMA) and a few values of the run that wrote them: model, signature, completed."""

    def __init__(self, spark: SparkSession, root: str, home: str = "~"):
        self.spark, self.home, self.pointer = spark, home, Pointer(spark, root)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def read(self) -> tuple[DataFrame, dict]:
        """The newest readable version and its values. A missing catalog is empty. A broken version is moved aside
        (`.corrupt`) and the catalog read as empty, so that the next run rebuilds it instead of trusting an old one."""
        versions = self.pointer.versions()
        if not versions:
            return self.empty(), {}
        v = versions[-1]
        try:
            state = self.pointer.read(v)
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.pointer.root}/{state['folder']}")
            rows.agg(F.count("*")).first()  # a broken footer shows here
        except Exception:  # noqa: BLE001  any unreadable version counts as corrupt
            for each in versions:
                self.pointer.store().rename(self.pointer.path(f"versions/{each}"), self.pointer.path(f"versions/{each}.corrupt-{int(time.time() * 1000)}"))
            return self.empty(), {}
        return self._at_home(rows), {k: x for k, x in state.items() if k != "folder"}

    def _at_home(self, rows: DataFrame) -> DataFrame:
        path = F.when(F.col("file_path").startswith("~/"), F.concat(F.lit(self.home), F.expr("substring(file_path, 2)"))).otherwise(F.col("file_path"))
        return rows.withColumn("file_path", path)

    def rehomed(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Paths below another machine's home folder are taken as below this one's where such a file is known
        (file_path)."""
        here = F.regexp_replace("file_path", FOREIGN_HOME, self.home)
        there = known.select(F.col("file_path").alias("known_path")).distinct()
        out = rows.withColumn("here", here).join(there, F.col("here") == F.col("known_path"), "left")
        return out.withColumn("file_path", F.when(F.col("known_path").isNotNull(), F.col("here")).otherwise(F.col("file_path"))).drop("here", "known_path")

    def write(self, rows: DataFrame, **values: object) -> int:
        """A new version, sorted by path, with paths relative to home; it counts once its pointer is there."""
        missing = [f for f in self.empty().schema.fields if f.name not in rows.columns]
        full = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(self.empty().columns)
        v = max([*self.pointer.versions(), *self._aside()], default=0) + 1
        ordered = full.withColumn("file_path", compact_home(F.col("file_path"), self.home)).orderBy("file_path", "doc_key")
        ordered.write.mode("overwrite").parquet(f"{self.pointer.root}/v{v}")
        self.pointer.write(v, {"folder": f"v{v}", **values})
        return v

    def _aside(self) -> list[int]:
        store, folder = self.pointer.store(), self.pointer.path("versions")
        names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        return [int(n.split(".")[0]) for n in names if ".corrupt-" in n and n.split(".")[0].isdigit()]
