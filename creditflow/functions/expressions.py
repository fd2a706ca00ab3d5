"""Null-safe predicates, clipped ratios and repeatable uniforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Named functions (DataFrame -> Column) that saved rules can refer to.
REGISTRY: dict[str, Callable[[DataFrame], Column]] = {}


def register(name: str, fn: Callable[[DataFrame], Column]) -> None:
    REGISTRY[name] = fn


def quoted(name: str) -> Column:
    """A column by its exact name, which may hold blanks or dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def true(condition: Column) -> Column:
    """The condition, with unknown as false; negation of the result is two-valued."""
    return F.coalesce(condition, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """Inequality that holds where either side is missing."""
    return F.coalesce(a != b, F.lit(True))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def resolve(what, df: DataFrame) -> Column:
    """A Column from a Column, SQL text, number, name of a registered function, or function of the frame."""
    if callable(what) and not isinstance(what, Column):
        return what(df)
    if isinstance(what, str):
        if what.startswith("@"):
            return REGISTRY[what[1:]](df)
        return quoted(what) if what in df.columns else F.expr(what)
    return what if isinstance(what, Column) else F.lit(what)


def ratio(a: Column, b: Column) -> Column:
    """a / b within 0..1: 0/0 and unknown are 0, positive/0 is 1."""
    return clipped(F.when((b == 0) & (a > 0), 1.0).otherwise(F.try_divide(a.cast("double"), b.cast("double"))))


def clipped(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def uniform(salt: str, key: Column) -> Column:
    """A number in [0, 1) from salt and key: the same under any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string"))), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
