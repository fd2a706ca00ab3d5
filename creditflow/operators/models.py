"""Score power: KS, KS tables, rankings, amplitude, sequential cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.binning import equal_width_edges, quantile_edges, rank_bin, ranked, right_bin, unique
from creditflow.functions.expressions import true
from creditflow.functions.order import running


def unpivoted(df: DataFrame, columns: list[str], keep: list[str], name: str = "score_name", value: str = "score") -> DataFrame:
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keep, columns, name, value)


def ks(df: DataFrame, scores: list[str], default: str) -> DataFrame:
    """KS by score: largest gap between the cumulative shares of bads and goods, over distinct scores.

    Rows without score or default are left out, score by score; one class only gives 0.
    """
    long = unpivoted(df.where(F.col(default).isNotNull()), scores, [default]).where("score is not null")
    groups = long.groupBy("score_name", "score").agg(F.sum(F.col(default).cast("double")).alias("bad"), F.sum(1.0 - F.col(default).cast("double")).alias("good"))
    sums = running(groups, ["score_name"], ["score"], ["bad", "good"])
    from_top = lambda c: F.try_divide(F.col(f"{c}_all") - F.col(f"{c}_to") + F.col(c), F.col(f"{c}_all"))
    gap = F.abs(from_top("bad") - from_top("good"))
    return sums.groupBy("score_name").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def ks_table(df: DataFrame, score: str, default: str, bins: int = 10) -> DataFrame:
    """Buckets from the best score down: volume, bads, mean score, cumulative shares, gap.

    Buckets are quantiles; where these are all one value, bins of equal width.
    """
    rows = df.where(F.col(default).isNotNull() & F.col(score).isNotNull())
    edges = unique(quantile_edges(rows, [score], [i / bins for i in range(bins + 1)])[score])
    inner = (edges if len(edges) != 1 else equal_width_edges(edges[0], edges[0], bins))[1:-1]
    bad = F.col(default).cast("double")
    groups = rows.groupBy(right_bin(F.col(score), inner).alias("bin")).agg(F.count(F.lit(1)).alias("volume"), F.sum(bad).alias("bads"), F.avg(score).alias("mean_score"))
    order = Window.partitionBy().orderBy(F.desc("bin"))  # a row for each bin
    down, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    good = F.col("volume") - F.col("bads")
    shares = groups.withColumns({
        "bucket": F.row_number().over(order),
        "cum_bad": F.coalesce(F.try_divide(F.sum("bads").over(down), F.sum("bads").over(every)), F.lit(0.0)),
        "cum_good": F.coalesce(F.try_divide(F.sum(good).over(down), F.sum(good).over(every)), F.lit(0.0)),
    })
    return shares.withColumn("ks", F.abs(F.col("cum_bad") - F.col("cum_good"))).drop("bin")


def model_ranking(df: DataFrame, scores: list[str], default: str) -> DataFrame:
    strength = F.when(F.col("ks") < 0.20, "weak").when(F.col("ks") < 0.30, "fair").when(F.col("ks") < 0.45, "good").otherwise("strong")
    rows = ks(df, scores, default).withColumn("strength", strength)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("ks", 9)), "score_name")))  # a row for each score


def amplitude(df: DataFrame, challengers: list[str], default: str, key: str, bins: int = 10) -> DataFrame:
    """Largest minus smallest mean default over rank bins, for each challenger."""
    long = unpivoted(df, challengers, [key, default], "challenger", "value").where("value is not null")
    placed = ranked(long, ["challenger"], "value", key)
    rates = placed.groupBy("challenger", rank_bin(F.col("rank"), F.col("rank_total"), bins).alias("bin")).agg(F.avg(F.col(default).cast("double")).alias("rate"))
    return rates.groupBy("challenger").agg((F.max("rate") - F.min("rate")).alias("amplitude"))


def sequential(df: DataFrame, first: Column, second: Column, default: str) -> DataFrame:
    """Rows past the first cutoff, share of second calls saved, bad rate before and after the second cutoff."""
    first, both, bad = true(first), true(first) & true(second), F.col(default).cast("double")
    return df.agg(
        F.sum(first.cast("bigint")).alias("passed_first"), (1 - F.avg(first.cast("double"))).alias("calls_saved"),
        F.avg(F.when(first, bad)).alias("bad_before"), F.avg(F.when(both, bad)).alias("bad_after"),
    )
