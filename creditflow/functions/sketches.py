"""Quantile sketches by vintage: kept, merged, and read without the vintages' rows.

A sketch of a column's values (KLL, of Spark's own functions) is a few kilobytes however
many rows it has seen. Each vintage is sketched once, when it arrives; quantiles of
any set of vintages come from their merged sketches. Ranks are off by at most
``rank_error(size)`` of the rows with 99 per cent confidence, for merged sketches too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Size parameter of a sketch: about a tenth of a per cent of rank error, some 30 KB.
SIZE = 4096
TABLE = "variable string, n long, sketch binary, vintage string"


def rank_error(size: int = SIZE) -> float:
    """The published bound of a KLL sketch for single ranks, as a share of its rows."""
    return 2.296 / size**0.9021


def sketch(df: DataFrame, columns: list[str], vintage: Column, size: int = SIZE) -> DataFrame:
    """variable, n, sketch, vintage: one row for each column and vintage, summed up in tasks before the shuffle.

    Nulls and NaN are left out; a vintage of nothing else has no row.
    """
    long = df.select(vintage.cast("string").alias("vintage"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["vintage"], columns, "variable", "value")
    known = long.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("vintage").isNotNull())
    return known.groupBy("variable", "vintage").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch")).select("variable", "n", "sketch", "vintage")


def keep(sketches: DataFrame, path: str) -> None:
    """Writes the vintages that ``sketches`` has; those that are there already are replaced, others stay."""
    sketches.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vintage").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path)


def merged(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, variable, n, sketch: the sketches of all vintages of each key as one."""
    return sketches.groupBy(*(keys or []), "variable").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, points: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, variable, n, edges: approximate quantiles (values that occur) of the merged sketches."""
    edges = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(float(p)) for p in points)))
    return merged(sketches, keys).select(*(keys or []), "variable", "n", edges.alias("edges"))


def share_up_to(sketch_column: str, value: Column) -> Column:
    """The approximate share of rows with a value of at most this one."""
    return F.kll_sketch_get_rank_double(sketch_column, value)


def breaks(sketches: DataFrame, bins: int) -> dict[str, tuple[float, ...]]:
    """Distinct approximate quantiles of each variable, as rating recipes take them."""
    found = quantiles(sketches, [i / bins for i in range(bins + 1)]).collect()  # a row for each variable
    return {r["variable"]: tuple(sorted(set(r["edges"]))) for r in found}
