"""Reports over an evaluated table: one grouped aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.expressions import quoted
from creditflow.operators.evaluate import stage_name
from creditflow.operators.policy import Policy


def _zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _rate(bad: Column, volume: Column) -> Column:
    """bad / volume, 0 where there is no volume."""
    return F.coalesce(F.try_divide(bad, volume), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0))


def summary(sim: DataFrame, policy: Policy, by: list[str] | None = None, method: str = "analytical") -> DataFrame:
    """Applicants, approved, hired and bad rate by scenario (and more keys)."""
    p, pd, actual = F.col("new_approval"), F.col("simulated_default"), quoted(policy.default).cast("double")
    first = F.first("scenario")
    if method == "stochastic":
        bad = F.when(first == "swap_out", F.avg(actual)).when(first != "keep_out", F.avg(pd))
        applicants = F.count(quoted(policy.applicant_id))
    else:
        bad = F.when(first.isin("keep_in", "swap_in"), _rate(F.sum(_zero(pd) * p), F.sum(p))).when(first == "swap_out", F.coalesce(F.avg(actual), F.lit(0.0)))
        applicants = F.count(F.lit(1))
    return sim.groupBy(*(by or []), "scenario").agg(applicants.alias("applicants"), F.sum(F.col("approved_pre_rate").cast("double")).alias("approved"), F.sum(p.cast("double")).alias("hired"), bad.alias("bad_rate"))


def _outcome(sim: DataFrame) -> list[Column]:
    a, pd = F.col("approved_pre_rate").cast("double"), F.col("simulated_default")
    return [F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("approved"), F.sum(_zero(pd) * a).alias("bad")]


def compare(new: DataFrame, old: DataFrame) -> DataFrame:
    """Approval and bad rate of two evaluated policies, long form: metric, old, new, delta_abs, delta_rel."""
    one = new.agg(*_outcome(new)).crossJoin(old.agg(*(c.alias(f"o_{k}") for c, k in zip(_outcome(old), ("n", "approved", "bad"), strict=True))))
    rates = one.select(
        (F.col("o_approved") / F.col("n")).alias("ao"), (F.col("approved") / F.col("n")).alias("an"),
        _rate(F.col("o_bad"), F.col("o_approved")).alias("bo"), _rate(F.col("bad"), F.col("approved")).alias("bn"),
    )
    rows = rates.selectExpr("stack(2, 'Approval Rate', ao, an, 'Bad Rate', bo, bn) as (metric, old, new)")
    return rows.withColumns({"delta_abs": F.col("new") - F.col("old"), "delta_rel": (F.col("new") - F.col("old")) / F.greatest(F.col("old"), F.lit(1e-6))})


def swap_ratio(sim: DataFrame) -> DataFrame:
    """Approved volume of swap-ins over that of keep-ins."""
    part = lambda s: F.sum(F.when(F.col("scenario") == s, F.col("approved_pre_rate").cast("double")).otherwise(0.0))
    return sim.agg(_rate(part("swap_in"), part("keep_in")).alias("swap_in_ratio"))


def delta_table(sim: DataFrame, policy: Policy) -> DataFrame:
    """Approval share, hired default rate and hired volume: legacy (from its columns) and new."""
    hired, default = quoted(policy.hired or "hired").cast("double"), quoted(policy.default).cast("double")
    p, pd = F.col("new_approval").cast("double"), F.col("simulated_default")
    one = sim.agg(
        (_count(quoted(policy.approved) > 0) / F.count(F.lit(1))).alias("al"), (_count(F.col("approved_pre_rate") > 0) / F.count(F.lit(1))).alias("an"),
        _rate(F.sum(F.when(hired == 1, _zero(default))), F.sum(F.when(hired == 1, 1.0))).alias("dl"), _rate(F.sum(_zero(pd) * p), F.sum(p)).alias("dn"),
        F.sum(_zero(hired)).alias("vl"), F.sum(p).alias("vn"),
    )
    rows = one.selectExpr("stack(3, 'approval', al, an, 'default_rate', dl, dn, 'hired', vl, vn) as (metric, legacy, new)")
    return rows.withColumn("delta", F.col("new") - F.col("legacy"))


def _weights(policy: Policy) -> tuple[Column, Column]:
    """Hired volume and expected bads of a row in its quadrant."""
    s, p = F.col("scenario"), F.col("new_approval").cast("double")
    hired = _zero(quoted(policy.hired or "hired"))
    volume = F.when(s.isin("keep_in", "swap_in"), p).when(s == "swap_out", hired).otherwise(0.0)
    bad = F.when(s == "keep_in", _zero(quoted(policy.default)) * p).when(s == "swap_in", _zero(F.col("simulated_default")) * p).when(s == "swap_out", _zero(quoted(policy.default)) * hired).otherwise(0.0)
    return volume, bad


def quadrant_summary(sim: DataFrame, policy: Policy) -> DataFrame:
    volume, bad = _weights(policy)
    rate = F.when(F.col("scenario") != "keep_out", _rate(F.sum(bad), F.sum(volume)))
    return sim.groupBy("scenario").agg(F.sum(volume).alias("volume"), rate.alias("default_rate"))


def swap_in_by_rating(sim: DataFrame, rating: Column) -> DataFrame:
    p = F.col("new_approval").cast("double")
    rows = sim.where("scenario = 'swap_in'").groupBy(rating.alias("rating")).agg(F.sum(p).alias("volume"), _rate(F.sum(_zero(F.col("simulated_default")) * p), F.sum(p)).alias("stressed_rate"))
    return rows.withColumn("share", _rate(F.col("volume"), F.sum("volume").over(Window.partitionBy())))


def rating_quadrant(sim: DataFrame, policy: Policy, rating: Column) -> DataFrame:
    volume, bad = _weights(policy)
    s = F.col("scenario")
    approved = F.when(s == "swap_out", _zero(quoted(policy.approved))).otherwise(F.col("approved_pre_rate").cast("double"))
    return sim.groupBy(rating.alias("rating"), "scenario").agg(F.sum(approved).alias("approved_volume"), F.sum(volume).alias("hired_volume"), F.when(F.first("scenario") != "keep_out", _rate(F.sum(bad), F.sum(volume))).alias("bad_rate"))


def vintage(sim: DataFrame, policy: Policy, rating: Column, wide: list | None = None) -> DataFrame:
    """Mean default by month and rating of what the new policy takes; wide: one column for each rating."""
    rows = sim.where("new_approval > 0").withColumn("rating", rating)
    if wide is not None:
        return rows.groupBy(policy.time).pivot("rating", wide).agg(F.avg(quoted(policy.default)))
    return rows.groupBy(policy.time, "rating").agg(F.avg(quoted(policy.default)).alias("default_rate"))


def funnel(sim: DataFrame, policy: Policy) -> DataFrame:
    """Rows left after each stage, as a share of all, and the change against the stage before."""
    names = ["all", *(s.name for s in policy.stages)]
    one = sim.agg(F.count(F.lit(1)).cast("double").alias("n0"), *(F.sum(quoted(stage_name(i, s))).alias(f"n{i + 1}") for i, s in enumerate(policy.stages)))
    stacked = ", ".join(f"{i}, '{n.replace(chr(39), chr(39) * 2)}', n{i}" for i, n in enumerate(names))
    rows = one.selectExpr("n0", f"stack({len(names)}, {stacked}) as (step, stage, remaining)")
    last = F.lag("remaining").over(Window.partitionBy().orderBy("step"))
    return rows.select("step", "stage", "remaining", _rate(F.col("remaining"), F.col("n0")).alias("share"), (F.col("remaining") - last).alias("change"))


def legacy_panorama(df: DataFrame, policy: Policy) -> DataFrame:
    approved, hired = quoted(policy.approved), quoted(policy.hired or "hired")
    return df.agg(
        F.count(F.lit(1)).alias("applicants"), F.sum(approved.cast("bigint")).alias("approved"), F.sum(hired.cast("bigint")).alias("hired"),
        F.avg(F.when(hired == 1, quoted(policy.default)).cast("double")).alias("bad_rate"), _rate(F.sum(hired.cast("double")), F.sum(approved.cast("double"))).alias("take_up"),
    )


def segment_outcome(sim: DataFrame, segment: str) -> DataFrame:
    a = F.col("approved_pre_rate").cast("double")
    return sim.groupBy(segment).agg(F.avg(a).alias("approval_rate"), _rate(F.sum(_zero(F.col("simulated_default")) * a), F.sum(a)).alias("weighted_pd"))


def dev_oot(df: DataFrame, rating: Column, is_dev: Column, default: str) -> DataFrame:
    """Volume and bad rate by rating, development and out-of-time side by side."""
    d = quoted(default).cast("double")
    return df.groupBy(rating.alias("rating")).agg(
        F.sum(is_dev.cast("bigint")).alias("n_dev"), F.sum((~is_dev).cast("bigint")).alias("n_oot"),
        F.avg(F.when(is_dev, d)).alias("bad_dev"), F.avg(F.when(~is_dev, d)).alias("bad_oot"),
    )


def swap_in_matrix(sim: DataFrame, rating: Column, segment: str, values: list[str] | None = None) -> DataFrame:
    """Swap-in volume, ratings by segments; missing cells are 0."""
    rows = sim.where("scenario = 'swap_in'").withColumn("rating", rating)
    return rows.groupBy("rating").pivot(segment, values).agg(F.sum(F.col("new_approval").cast("double"))).fillna(0.0)


def rating_ranges(df: DataFrame, score: str, rating: Column, is_dev: Column) -> DataFrame:
    """Score range and counts by rating, rows without one included."""
    return df.groupBy(rating.alias("rating")).agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.sum(is_dev.cast("bigint")).alias("n_dev"), F.sum((~is_dev).cast("bigint")).alias("n_oot"))


def cardinality(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    count = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(*(count(c).alias(f"{c}_values") for c in columns))
