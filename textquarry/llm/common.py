"""Helpers shared by the operators: shared scratch tables and fast word handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scan import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Java and RE2 pattern of a word in the "item" sense: ASCII digits and letters, and all of non-ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in the "white space" sense: what stands between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; Spark's lower() would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set, a local one is made if driver and executors
    are one process (tests); on a cluster, where executors would write to disks of their own, this raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='textquarry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/textquarry/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there,
    and a lost executor costs a re-read rather than a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast."""
    return df.limit(most + 1).count() <= most


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that materialize() wrote below the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/textquarry")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Long texts make an Arrow batch of Spark's usual 10,000 rows too large for a small executor.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of bounded rows and bytes; lowers the session's two limits where they are above."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(function, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: such rows are never learned from. Null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
