"""Running sums in an order, without a task that holds a whole key.

The values of a key are cut into ranges at approximate quantiles. Totals of the
ranges, summed up over the few ranges of a key, are the offsets of their rows; within
a range the rows are sorted by one task. The quantiles only balance the tasks: the sums
are exact whatever they are. They depend on the order in which rows arrive, so ranges are
written once, and totals and rows are read from there: found twice they may differ. A
value itself is never cut, so rows should be summed by value before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.sources.tables import staged

#: Ranges of a key.
RANGES = 32


def _on(keys: list[str], left: str = "l", right: str = "r") -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def placed_in_ranges(rows: DataFrame, keys: list[str], value: str, totals: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """rows with ``_range``, which ascends with a numeric value (nulls: -1), and totals over the key."""
    cuts = F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(100 * ranges))
    # the totals stand beside the cuts so that all branches read the same columns of rows, and one shuffle
    every = rows.groupBy(*keys).agg(cuts.alias("_cuts"), *(c.alias(name) for name, c in totals.items()))
    placed = rows.alias("l").join(F.broadcast(every).alias("r"), _on(keys)).select("l.*", "_cuts", *totals)
    place = F.coalesce(F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value))), F.lit(0))
    return placed.withColumn("_range", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(place)).drop("_cuts")


def running(rows: DataFrame, keys: list[str], by: list[str], values: list[str], least: bool = False, before: bool = False, wanted: Callable[[Column, Column, Column], Column] | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with ``<v>_to``, the sum of each of values (least: the minimum) over the rows of a key up to this one in the order of ``by``, and ``<v>_all`` over the key.

    before leaves the row itself out (null, if it is the first). The first column of
    ``by`` is numeric; its nulls come first. wanted(low, high, all), on the sums of the
    first of values before and up to a range, says which ranges to keep.
    What is known of a key (ranges + 1 numbers) is broadcast: keys are variables, tiers or grid points.
    """
    total = F.min if least else F.sum
    added = (lambda a, b: F.least(a, b)) if least else (lambda a, b: F.coalesce(a + b, a, b))
    one = [*keys, "_key"]
    placed = staged(placed_in_ranges(rows.withColumn("_key", F.lit(0)), one, by[0], {f"{v}_all": total(v) for v in values}, ranges), "ranges")
    down = Window.partitionBy(*one).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = placed.groupBy(*one, "_range").agg(*(total(v).alias(f"_part_{v}") for v in values), *(F.first(f"{v}_all").alias(f"_whole_{v}") for v in values))
    parts = parts.withColumns({f"_low_{v}": total(f"_part_{v}").over(down) for v in values})
    if wanted:
        low = F.coalesce(F.col(f"_low_{values[0]}"), F.lit(0))
        parts = parts.where(wanted(low, low + F.col(f"_part_{values[0]}"), F.col(f"_whole_{values[0]}")))
    found = placed.alias("l").join(F.broadcast(parts.select(*one, "_range", *(f"_low_{v}" for v in values))).alias("r"), _on([*one, "_range"])).select("l.*", *(f"_low_{v}" for v in values))
    within = Window.partitionBy(*one, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return found.withColumns({f"{v}_to": added(F.col(f"_low_{v}"), total(v).over(within)) for v in values}).drop("_key", "_range", *(f"_low_{v}" for v in values))
