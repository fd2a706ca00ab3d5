"""Screening of candidate variables inside rating tiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.binning import left_bin_of, position_bin, quantiles, ranked
from creditflow.operators._merge import merge_bins
from creditflow.operators.models import unpivoted
from creditflow.sources.tables import staged


def _long(df: DataFrame, tier: Column, candidates: list[str], default: str, key: str) -> DataFrame:
    rows = df.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.col(default).isNotNull())
    return unpivoted(rows, candidates, ["tier", key, default], "variable", "value").where("value is not null")


def boundaries(df: DataFrame, tier: Column, candidates: list[str], default: str, key: str, bins: int = 10) -> DataFrame:
    """variable, tier, edges: distinct quantiles; tiers with fewer rows than bins, or one value, are left out."""
    long = _long(df, tier, candidates, default, key)
    enough = long.groupBy("variable", "tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bins)
    edges = quantiles(long, ["variable", "tier"], "value", [i / bins for i in range(bins + 1)]).join(enough, ["variable", "tier"])
    return edges.select("variable", "tier", F.array_sort(F.array_distinct("edges")).alias("edges")).where(F.size("edges") >= 2)


def inner(edges: Column) -> Column:
    return F.slice(edges, F.lit(2), F.size(edges) - 2)


def bin_counts(df: DataFrame, edges: DataFrame, tier: Column, candidates: list[str], default: str, key: str) -> DataFrame:
    """variable, tier, bin, volume, bads by the boundaries' left-closed bins."""
    long = _long(df, tier, candidates, default, key).join(edges, ["variable", "tier"])
    return long.groupBy("variable", "tier", left_bin_of(F.col("value"), inner(F.col("edges"))).alias("bin")).agg(F.count(F.lit(1)).alias("volume"), F.sum(F.col(default).cast("bigint")).alias("bads"))


def _merged(pdf: pd.DataFrame, method: str, falling: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    if falling and (pdf["bads"] / pdf["volume"]).corr(pdf["bin"]) < 0:
        pdf = pdf[::-1]
    none = pdf[[]].to_numpy()
    return pdf.assign(subsegment=merge_bins(pdf["volume"], pdf["bads"], none, none, 3, 0.1, 1, method))[["variable", "tier", "bin", "subsegment"]]


def subsegments(counts: DataFrame, method: str = "quantiles", falling: bool = False) -> DataFrame:
    """variable, tier, bin, subsegment: the bins present numbered, or merged to 3 groups at most.

    Bins are merged in ascending order of the variable, so that a variable whose rate
    falls ends in few groups; falling=True turns the bins of such a variable round.
    """
    if method == "quantiles":
        return counts.select("variable", "tier", "bin", F.dense_rank().over(Window.partitionBy("variable", "tier").orderBy("bin")).alias("subsegment"))
    return counts.groupBy("variable", "tier").applyInPandas(lambda pdf: _merged(pdf, method, falling), "variable string, tier int, bin int, subsegment int")


def tier_metrics(df: DataFrame, tier: Column, candidates: list[str], default: str, key: str, bins: int = 10) -> DataFrame:
    """Information value, least and greatest default rate, spread and volume by variable and tier, over equal-volume bins by position."""
    long = ranked(staged(_long(df, tier, candidates, default, key), "screened"), ["variable", "tier"], "value", key)
    bad = F.col(default).cast("double")
    groups = long.groupBy("variable", "tier", position_bin(F.col("rank"), F.col("rank_total"), bins).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(bad).alias("b"))
    every = Window.partitionBy("variable", "tier")
    share_bad = (F.col("b") + 0.5) / (F.sum("b").over(every) + 1.0)
    share_good = (F.col("n") - F.col("b") + 0.5) / (F.sum(F.col("n") - F.col("b")).over(every) + 1.0)
    rows = groups.withColumns({"iv": (share_bad - share_good) * F.log(share_bad / share_good), "pd": F.col("b") / F.col("n")})
    return rows.groupBy("variable", "tier").agg(F.sum("iv").alias("iv"), F.min("pd").alias("pd_min"), F.max("pd").alias("pd_max"), (F.max("pd") - F.min("pd")).alias("pd_spread"), F.sum("n").cast("bigint").alias("tier_vol"))


def predict(df: DataFrame, variable: str, tier: Column, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """df with subsegment: 1 for an unknown tier or bin, null for a null tier; a null value is in the top bin."""
    recipe = groups.where(F.col("variable") == variable).groupBy("tier").agg(F.map_from_entries(F.collect_list(F.struct("bin", "subsegment"))).alias("_map"))
    recipe = edges.where(F.col("variable") == variable).select("tier", "edges").join(recipe, "tier").select(F.col("tier").alias("_tier"), "edges", "_map")
    rows = df.withColumn("_t", tier).join(recipe, F.col("_t") == F.col("_tier"), "left")
    place = F.when(F.col(variable).isNull(), F.size(inner(F.col("edges")))).otherwise(left_bin_of(F.col(variable).cast("double"), inner(F.col("edges"))))
    found = F.when(F.col("_t").isNotNull(), F.coalesce(F.try_element_at("_map", place), F.lit(1)))
    return rows.withColumn("subsegment", found).drop("_t", "_tier", "edges", "_map")


def recipe_table(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """What prediction needs as one table to keep, a row for each bin: variable, tier, edges, bin, subsegment."""
    return edges.join(groups, ["variable", "tier"]).select("variable", "tier", "edges", "bin", "subsegment")


def from_recipe_table(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and groups of a kept recipe."""
    return table.select("variable", "tier", "edges").distinct(), table.select("variable", "tier", "bin", "subsegment")
