"""What the operators of this package share: scratch tables in the cluster's shared folder and Arrow helpers.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names. Only a local-mode session without that setting (a
test) gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else; every byte that is not part of a word becomes a space, UTF-8 bytes beyond ASCII are kept.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    root = sc.getConf().get("spark.checkpoint.dir") or (current.get() if current.isDefined() else None)
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    elif current.isEmpty():
        sc.setCheckpointDir(root)
    return str(root).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df_or_spark: DataFrame | SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit numbers (unsigned) spread over all 64-bit numbers, different ones to different ones."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other characters unchanged (``lower`` would change those beyond ASCII)."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``: the split between learning and held-out rows; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def by_batch(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` at most (single longer rows stay whole)."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
