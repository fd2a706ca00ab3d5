"""Reading application tables and writing decision tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_applications(spark: SparkSession, path: str, columns: list[str] | None = None, format: str = "parquet", **options) -> DataFrame:
    """The named columns of a table; NaN in a floating column is read as null, which is what all operators expect."""
    df = spark.read.format(format).options(**options).load(path)
    df = df.select(*columns) if columns else df
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floating}) if floating else df


def write_decisions(df: DataFrame, path: str, by: str, batch_id: str | None = None) -> None:
    """One folder for each value of ``by``; rows of a value are brought together first, split where one is large.

    The values that df has replace what the table holds of them, and all others stay, so
    that a month may be written again. batch_id, if given, is kept in a column of that
    name and says which run wrote the rows. The first batch may be empty.
    """
    rows = df if batch_id is None else df.withColumn("batch_id", F.lit(batch_id))
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the session's shared folder (or its warehouse) and read back.

    For rows that several branches of a job read: they are not computed again, and every
    branch has the same ones.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="creditflow-") if alone else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
