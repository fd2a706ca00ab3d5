"""Quantile edges, the two bin conventions, and ranks that need no single-task sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.order import running


def quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float], weight: str | None = None) -> DataFrame:
    """keys, edges: quantiles of value (linear interpolation, rounded to 9 decimals) for each value of keys; weight: a column of whole counts.

    Values are counted first, and running counts say which of them hold the ranks
    asked for; only the ranges of values that hold one are sorted. Nulls are left out.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(n.alias("_n")).where("_n > 0")
    asked = F.array(*(F.lit(float(p)) for p in points))
    rank = lambda p, all_: p * (all_ - 1)
    within = lambda r, low, high: (r >= low) & (r < high)
    holds = lambda low, high, all_: F.exists(asked, lambda p: within(F.floor(rank(p, all_)), low, high) | within(F.ceil(rank(p, all_)), low, high))
    counts = running(counts, keys, ["_v"], ["_n"], wanted=holds).withColumnsRenamed({"_n_to": "_to", "_n_all": "_all"})
    some = counts.where(holds(F.col("_to") - F.col("_n"), F.col("_to"), F.col("_all")))
    found = some.groupBy(*keys, "_all").agg(F.collect_list(F.struct("_v", "_n", "_to")).alias("_some"))
    pick = lambda r: F.filter("_some", lambda x: within(r, x["_to"] - x["_n"], x["_to"]))[0]["_v"]

    def between(p: Column) -> Column:
        r = rank(p, F.col("_all"))
        low = pick(F.floor(r))
        return F.round(low + (r - F.floor(r)) * (pick(F.ceil(r)) - low), 9)

    return found.select(*keys, F.transform(asked, between).alias("edges"))


def quantile_edges(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float]]:
    """Quantiles of several columns in one pass; none for a column of nulls."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "_c", "_value")
    found = {r["_c"]: list(r["edges"]) for r in quantiles(long, ["_c"], "_value", points).collect()}
    return {c: found.get(c, []) for c in columns}


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of bins of equal width, right-closed; a constant is widened by a thousandth of itself either way, and the lowest edge by a thousandth of the range."""
    if low == high:
        low, high = (low - 0.001 * abs(low), high + 0.001 * abs(high)) if low else (-0.001, 0.001)
        return [low + (high - low) * i / bins for i in range(bins + 1)]
    edges = [low + (high - low) * i / bins for i in range(bins + 1)]
    return [edges[0] - 0.001 * (high - low), *edges[1:]]


def unique(edges: list[float]) -> list[float]:
    return sorted(set(edges))


def inner_edges(edges: Column) -> Column:
    """Distinct edges, ascending, without the outer ones."""
    e = F.array_sort(F.array_distinct(edges))
    return F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))


def left_bin(x: Column, inner: list[float], null_bin: str = "top") -> Column:
    """Left-closed bin: how many inner edges are <= x; a null is in the top bin, or null."""
    n = sum((F.when(x >= F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(x.isNotNull(), n).otherwise(F.lit(len(inner)) if null_bin == "top" else F.lit(None).cast("int"))


def right_bin(x: Column, inner: list[float]) -> Column:
    """Right-closed bin: how many inner edges are < x; null for null."""
    n = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(x.isNotNull(), n)


def left_bin_of(x: Column, inner: Column) -> Column:
    """left_bin with edges in an array column."""
    return F.size(F.filter(inner, lambda e: e <= x))


@dataclass(frozen=True)
class BinnedMean:
    """Means of a value by right-closed score bin; a bin without one, and a null score, get the fallback."""

    inner: tuple[float, ...]
    means: tuple[float | None, ...]
    fallback: float

    def at(self, score: Column) -> Column:
        means = F.array(*(F.lit(m).cast("double") for m in self.means)) if self.means else F.array(F.lit(None).cast("double"))
        return F.coalesce(F.get(means, right_bin(score, list(self.inner))), F.lit(self.fallback))


    @classmethod
    def of(cls, rows: list) -> BinnedMean:
        """From the collected rows of one label of ``binned_means``."""
        fallback = next((r["mean"] for r in rows if r["edges"] is not None), None)
        edges = next((r["edges"] for r in rows if r["edges"] is not None), [])
        means: list[float | None] = [None] * (len(edges) + 1)
        for r in rows:
            if r["edges"] is None and r["bin"] is not None:
                means[r["bin"]] = r["mean"]
        return cls(tuple(edges), tuple(means) if any(m is not None for m in means) else (), float(fallback or 0.0))


def binned_means(histogram: DataFrame, score: str, total: str, count: str, edges_from: DataFrame | None = None, bins: int | list[float] = 10, least: int = 0, label: str = "", has_score: bool = True) -> DataFrame:
    """Means by right-closed score bin from a histogram with n rows, sums and counts of a value: label, edges, bin, mean, n.

    One row has the inner edges (quantiles of edges_from, or of the histogram itself,
    or given edges) and the mean of all; the others have a bin's mean. Fewer than
    ``least`` rows, or no score, give the first row only, without edges in it.
    """
    whole = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"), F.try_divide(F.sum(total), F.sum(count)).alias("mean"))
    none = F.array().cast("array<double>")
    if isinstance(bins, int):
        base = (histogram if edges_from is None else edges_from).withColumn("_one", F.lit(1))
        found = quantiles(base, ["_one"], score, [i / bins for i in range(bins + 1)], "n").select(inner_edges(F.col("edges")).alias("e"))
        inner = F.coalesce("e", none)
        whole = whole.join(F.broadcast(found), F.lit(True), "left")  # one row
    else:
        inner = F.array(*(F.lit(float(e)) for e in bins))
    enough = (F.col("k") >= max(least, 1)) & F.lit(has_score)
    whole = whole.select("k", "mean", F.when(enough, inner).otherwise(none).alias("edges"), enough.alias("enough"))
    binned = histogram.crossJoin(F.broadcast(whole.where("enough"))).where(F.col(score).isNotNull())
    by = binned.groupBy(F.size(F.filter("edges", lambda e: e < F.col(score))).alias("bin")).agg(F.try_divide(F.sum(total), F.sum(count)).alias("mean"), F.sum("n").alias("n"))
    first = whole.select(F.lit(label).alias("label"), "edges", F.lit(None).cast("int").alias("bin"), "mean", F.col("k").alias("n"))
    return first.unionByName(by.select(F.lit(label).alias("label"), F.lit(None).cast("array<double>").alias("edges"), "bin", "mean", "n"))


def ranked(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "rank", id_buckets: int = 1) -> DataFrame:
    """Exact rank (from 1) by value and then tie, within keys, without one task per key.

    Running counts of the distinct values give offsets; rows are numbered within a value only.
    With id_buckets > 1 a value with very many ties is split by ranges of a numeric
    tie column.
    """
    slot = F.lit(0) if id_buckets == 1 else F.col("_slot")
    if id_buckets > 1:
        low, high = df.agg(F.min(tie), F.max(tie)).first()
        step = max(1, ((high or 0) - (low or 0)) // id_buckets + 1)
        df = df.withColumn("_slot", F.floor((F.col(tie) - F.lit(low or 0)) / step).cast("int"))
    df = df.withColumn("_slot", slot)
    groups = df.groupBy(*keys, value, "_slot").agg(F.count("*").alias("_n"))
    groups = running(groups, keys, [value, "_slot"], ["_n"])
    groups = groups.select(*keys, value, "_slot", (F.col("_n_to") - F.col("_n")).alias("_before"), F.col("_n_all").alias("_total"))
    on = F.lit(True)
    left, right = df.alias("l"), groups.alias("r")
    for c in [*keys, value, "_slot"]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    own = Window.partitionBy(*[F.col(c) for c in [*keys, value, "_slot"]]).orderBy(tie)
    joined = left.join(right, on).select("l.*", "r._before", "r._total")
    return joined.withColumn(name, F.row_number().over(own) + F.col("_before")).withColumnRenamed("_total", f"{name}_total").drop("_before", "_slot")


def rank_bin(rank: Column, total: Column, bins: int) -> Column:
    """Quantile bin of a rank (0 first): equal shares of rank - 1 over total - 1, right-closed."""
    return F.greatest(F.ceil((rank - 1) * bins / F.greatest(total - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def position_bin(rank: Column, total: Column, bins: int) -> Column:
    """Equal-volume bin by position: (rank - 1) * bins // total."""
    return F.floor((rank - 1) * bins / total).cast("int")
