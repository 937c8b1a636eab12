"""What the operators of this subpackage share: reading tables, folds, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import scratch, shared_dir, written

__all__ = ["BROADCAST_KEYS", "SHINGLE_WORDS", "SIMILARITY", "fold", "read", "scratch", "shared_dir", "small_batches", "without", "written"]

#: Words of all operators on shingles.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str | Column, n: int) -> Column:
    """``crc32(value as text) mod n``; null for null."""
    return (F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n).cast("int")


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches to BATCH_ROWS rows at most.

    Rows of whole texts are large: ten thousand of them are tens of megabytes, which the JVM, off its heap, and the Python
    worker each hold once or twice.
    """
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Up to this number, keys to drop are broadcast to the scan (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among the dropped ones (one column, written); rows with a null key stay."""
    few = dropped.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(dropped) if few else dropped, key, "left_anti")
