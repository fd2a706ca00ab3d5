"""Policy evaluation: funnel, quadrants, calibrated and stressed default rates, decisions.

``fit`` reads the table for the few numbers that a policy needs (bin edges and
means); ``simulate`` is then one narrow pass, which also runs on a stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creditflow.functions.binning import BinnedMean, binned_means, ranked
from creditflow.functions.expressions import quoted, resolve, uniform
from creditflow.operators.policy import Policy, clipped_or_null
from creditflow.sources.tables import staged


@dataclass(frozen=True)
class Fitted:
    """What a policy learned from a table: calibrated rates by stage, baseline PD by score bin or by rating, edges (score, id) of quantile stresses by number."""

    rates: dict[int, BinnedMean] = field(default_factory=dict)
    pd: BinnedMean = BinnedMean((), (), 0.0)
    pd_by_rating: dict[int, float] | None = None
    stress: dict[int, tuple[tuple[float, int | str], ...]] = field(default_factory=dict)


def calibrated_value(stage, df: DataFrame) -> Column | None:
    """What a rate stage averages by score: its ("calibrated", x), or with ``calibrate`` its expression (Column or SQL text that is no column's name)."""
    v = stage.variable
    if isinstance(v, (tuple, list)) and v[0] == "calibrated":
        return resolve(v[1], df)
    if stage.calibrate and (isinstance(v, Column) or (isinstance(v, str) and not v.startswith("@") and v not in df.columns)):
        return resolve(v, df)
    return None


def _hard(policy: Policy, df: DataFrame) -> Column:
    return reduce(lambda a, b: a * b, (s.passes(df) for s in policy.stages if s.kind != "rate"), F.lit(1.0))


def quadrant(old: Column, new: Column) -> Column:
    old, new = F.coalesce(old, F.lit(0)) > 0, F.coalesce(new, F.lit(0)) > 0
    return F.when(old & new, "keep_in").when(new, "swap_in").when(old, "swap_out").otherwise("keep_out")


def fit(df: DataFrame, policy: Policy, rating: Column | None = None) -> Fitted:
    """Calibrates the policy: aggregates of tens of numbers each.

    The table is read once, for a histogram by score, past and new decision; edges
    and means of all calibrations come from that and are collected together.
    """
    score, default = policy.score_for_calibration(), quoted(policy.default).cast("double")
    bins, least = policy.bins_and_least()
    values = {i: v for i, s in enumerate(policy.stages) if s.kind == "rate" and (v := calibrated_value(s, df)) is not None}
    old, keep = F.coalesce(quoted(policy.approved) == 1, F.lit(False)), quadrant(quoted(policy.approved), _hard(policy, df)) == "keep_in"
    narrow = df.select(
        (quoted(score) if score else F.lit(None).cast("double")).alias("_score"), old.alias("_old"), keep.alias("_keep"),
        (F.lit(None) if rating is None else rating).cast("int").alias("_rating"), default.alias("_pd"), *(F.when(old, v.cast("double")).alias(f"_{i}") for i, v in values.items()))
    sums = [f for c in ("pd", *values) for f in (F.count(f"_{c}").alias(f"n_{c}"), F.sum(f"_{c}").alias(f"s_{c}"))]
    histogram = narrow.groupBy("_score", "_old", "_keep", "_rating").agg(F.count(F.lit(1)).alias("n"), *sums).persist()
    wanted = [binned_means(histogram.where("_old"), "_score", f"s_{i}", f"n_{i}", bins=bins, label=str(i), has_score=score is not None) for i in values]
    if rating is None:
        base = histogram if policy.calibration_base in ("global", "all", "dataset") else None
        wanted.append(binned_means(histogram.where("_keep"), "_score", "s_pd", "n_pd", base, bins, least, "pd", score is not None))
    else:
        by = histogram.where("_keep").groupBy(F.col("_rating").alias("bin")).agg(F.try_divide(F.sum("s_pd"), F.sum("n_pd")).alias("mean"), F.sum("n_pd").alias("n"))
        wanted.append(by.select(F.lit("pd").alias("label"), F.lit(None).cast("array<double>").alias("edges"), "bin", "mean", "n"))
    try:
        rows = reduce(DataFrame.unionByName, wanted).collect()
    finally:
        histogram.unpersist()
    found = {label: [r for r in rows if r["label"] == label] for label in ("pd", *map(str, values))}
    rates = {i: BinnedMean.of(found[str(i)]) for i in values}
    stress = swap_in_edges(df, policy)
    if rating is None:
        return Fitted(rates, BinnedMean.of(found["pd"]), stress=stress)
    total = sum(r["n"] or 0 for r in found["pd"])
    mean = sum(r["mean"] * r["n"] for r in found["pd"] if r["n"]) / total if total else 0.0
    return Fitted(rates, BinnedMean((), (), mean), {int(r["bin"]): r["mean"] for r in found["pd"] if r["bin"] is not None and r["mean"] is not None}, stress)


def edge_rows(rows: DataFrame, keys: list[str], score: str, tie: str, bins: int) -> DataFrame:
    """keys and (score, tie) of the last row of each of ``bins`` equal bins but the highest, by score and then tie; rows without a score are in none."""
    known = rows.select(*map(quoted, keys), quoted(score).cast("double").alias("_score"), quoted(tie).alias("_tie")).where("_score is not null")
    placed = ranked(known, keys, "_score", "_tie")
    last = [F.floor(F.lit(b) * (F.col("rank_total") - 1) / bins) + 1 for b in range(1, bins)]
    edges = placed.withColumn("_edge", F.filter(F.array(*last), lambda r: r == F.col("rank"))).where(F.size("_edge") > 0)
    # with fewer rows than bins one row ends several
    return edges.select(*map(quoted, keys), F.explode("_edge").alias("_edge"), "_score", "_tie")


def swap_in_edges(df: DataFrame, policy: Policy) -> dict[int, tuple[tuple[float, int | str], ...]]:
    """Edges of each quantile stress over the policy's swap-ins."""
    found = {}
    for k, s in enumerate(policy.stresses):
        if s.kind == "quantile":
            # written once: ranks read them several times
            swap = staged(df.where(quadrant(quoted(policy.approved), _hard(policy, df)) == "swap_in").select(quoted(s.score), quoted(policy.applicant_id)), "swap_ins")
            edges = edge_rows(swap, [], s.score, policy.applicant_id, s.bins).collect()  # bins - 1 rows
            found[k] = tuple(sorted((r["_score"], r["_tie"]) for r in edges))
    return found


def bin_by_edges(score: Column, tie: Column, edges: tuple[tuple[float, int | str], ...]) -> Column:
    """How many edges lie below a row, by score and then tie; null without a score."""
    above = [F.when((score > F.lit(float(e))) | ((score == F.lit(float(e))) & (tie > F.lit(t))), 1).otherwise(0) for e, t in edges]
    return F.when(score.isNotNull(), sum(above, F.lit(0)))


def stressed_pd(df: DataFrame, policy: Policy, pd: str, bins: dict[int, Column]) -> Column:
    """The worst of all stresses of a PD column; bins: the row's bin of each quantile stress."""
    each = [s.apply(df, pd, bins.get(k)) for k, s in enumerate(policy.stresses)]
    return clipped_or_null(F.greatest(*each) if len(each) > 1 else each[0] if each else quoted(pd))


def baseline_pd(policy: Policy, fitted: Fitted, rating: Column | None = None) -> Column:
    if fitted.pd_by_rating is not None and rating is not None:
        return F.coalesce(*(F.when(rating == r, F.lit(float(m))) for r, m in fitted.pd_by_rating.items()), F.lit(fitted.pd.fallback))
    score = policy.score_for_calibration()
    return fitted.pd.at(quoted(score)) if score else F.lit(fitted.pd.fallback)


def stage_name(i: int, stage) -> str:
    return f"stage_{i}_{stage.name}"


def simulate(df: DataFrame, policy: Policy, method: str = "analytical", fitted: Fitted | None = None, rating: Column | None = None) -> DataFrame:
    """df with cumulative stage columns, new_approval, approved_pre_rate, scenario and simulated_default.

    No row is dropped. ``stochastic`` draws each rate (and swap-in default) from a
    uniform that depends on the applicant and the stage only.
    """
    policy.validate(df)
    fitted = fitted or fit(df, policy, rating)
    stochastic = method == "stochastic"
    conversion = policy.conversion_stages(df.columns)
    hired = quoted(policy.hired or "hired") if (policy.hired or "hired") in df.columns else F.lit(0)
    so_far, hard, columns = F.lit(1.0), F.lit(1.0), {}
    results: list[Column] = []
    for i, stage in enumerate(policy.stages):
        if stage.kind == "rate":
            calibrated = fitted.rates[i].at(quoted(policy.score_for_calibration())) if i in fitted.rates else None
            p = stage.rate(df, calibrated)
            known = F.coalesce(hired.cast("double"), F.lit(0.0)) if i in conversion else F.lit(1.0)
            if stochastic:
                p = F.when(uniform(f"{policy.seed}-{i}", quoted(policy.applicant_id)) < p, 1.0).otherwise(0.0)
            result = F.when(quoted(policy.approved) == 1, known).otherwise(p)
        else:
            result = stage.passes(df)
            hard = hard * result
        so_far = so_far * result
        results.append(result)
        columns[stage_name(i, stage)] = so_far
    out = df.withColumns(columns) if columns else df
    approval, pre = (so_far.cast("int"), (hard > 0).cast("int")) if stochastic else (so_far, hard)
    out = out.withColumns({"new_approval": approval, "approved_pre_rate": pre})
    out = out.withColumn("scenario", quadrant(quoted(policy.approved), F.col("approved_pre_rate")))
    pd = "_pd"
    while pd in out.columns:  # a name that the input has not
        pd += "_"
    out = out.withColumn(pd, baseline_pd(policy, fitted, rating))
    new = stressed_pd(out, policy, pd, {k: bin_by_edges(quoted(policy.stresses[k].score).cast("double"), quoted(policy.applicant_id), e) for k, e in fitted.stress.items()})
    if stochastic:
        new = F.when(uniform(f"{policy.seed}-default", quoted(policy.applicant_id)) < new, 1.0).otherwise(0.0)
    value = F.when(F.col("scenario") == "keep_in", quoted(policy.default).cast("double")).when(F.col("scenario") == "swap_in", new)
    return out.withColumn("simulated_default", value).drop(pd)


#: Input columns that a decision table leaves out, besides all that are named stage_<number>_... (fixed values).
RESERVED = (
    "new_approval", "approved_pre_rate", "quadrant", "simulated_default", "approved", "decisao", "motivo", "decision", "reason", "contratou", "inadimplente",
    "cenario", "hired", "defaulted", "scenario", "rating", "Rating", "risk_rating",
)


def is_reserved(column: str) -> bool:
    return column in RESERVED or re.match(r"stage_\d+_", column) is not None


def decisions(sim: DataFrame, policy: Policy, method: str = "analytical", rating: Column | None = None, labels: dict[int, str] | None = None) -> DataFrame:
    """The decision table: decision, reason of the first failed hard stage, hired, defaulted, scenario, rating letter."""
    keep = [quoted(c) for c in sim.columns if not is_reserved(c)]
    failed = [F.when(quoted(stage_name(i, s)) < 0.5, F.lit(f"{i + 1}: {s.name}")) for i, s in enumerate(policy.stages) if s.kind != "rate"]
    approved = F.col("approved_pre_rate") >= 0.5
    title = F.coalesce(*(F.when(F.col("scenario") == q, t) for q, t in (("keep_in", "Keep In"), ("swap_in", "Swap In"), ("swap_out", "Swap Out"), ("keep_out", "Keep Out"))))
    letter = F.lit(None).cast("string") if rating is None else F.coalesce(*(F.when(rating == k, v) for k, v in labels.items()), F.lit(None)) if labels else F.chr(F.lit(64) + rating)
    yes = lambda c: F.when(c >= 0.5, "Yes").otherwise("No")
    return sim.select(
        *keep,
        F.when(approved, "Approved").otherwise("Rejected").alias("decision"),
        F.coalesce(*failed, F.lit("Approved")).alias("reason"),
        (yes(F.col("new_approval")) if method == "stochastic" else F.col("new_approval")).alias("hired"),
        (yes(F.col("simulated_default")) if method == "stochastic" else F.col("simulated_default")).alias("defaulted"),
        title.alias("scenario"),
        letter.alias("rating"),
    )

