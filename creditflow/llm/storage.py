"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a key-only side that may be broadcast (8-byte keys: about 8 MB); a larger side is shuffled.
BROADCAST_ROWS = 500_000
#: Rows of text in an Arrow batch.
TEXT_BATCH = 1_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder in local mode, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="creditflow-"))
    return context.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python TEXT_BATCH at a time from now on in this session, unless it asks for fewer.

    Spark's own limit is 10,000 rows however long they are, on both sides of the pipe.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, TEXT_BATCH)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (stored) with a broadcast hint if its counted rows are few; otherwise as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
