"""Cutoff grids in one pass, best points, frontiers, trade-offs.

A grid of cutoffs is not crossed with the rows: each row falls in the cell of the
cutoffs it reaches, the cells are summed in one aggregate, and running sums over
the cells give every combination exactly.
"""

from __future__ import annotations

import math
from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.binning import inner_edges, quantile_edges, quantiles
from creditflow.functions.expressions import all_of, quoted, uniform
from creditflow.functions.order import running
from creditflow.operators.evaluate import edge_rows, fit, simulate, stressed_pd
from creditflow.operators.policy import Policy, Stress, cutoff_stage
from creditflow.sources.tables import staged

#: Cells of an analytical grid, and combinations of a grid that meets rows.
MAX_CELLS, MAX_POINTS = 5_000_000, 100_000
#: Equal ranges of a draw.
DRAWS = 256


def cutoff_ranges(df: DataFrame, scores: list[str], steps: int = 10, percentiles: tuple[float, float] | None = (0.05, 0.95)) -> dict[str, list[float]]:
    """Even steps from the floor of the low to the ceiling of the high quantile of each score; one step: the median."""
    if steps < 1:
        raise ValueError("steps must be 1 or more")
    if not scores:
        raise ValueError("no score to vary")
    if missing := sorted(set(scores) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    low, high = percentiles or (0.0, 1.0)
    edges = quantile_edges(df, scores, [low, 0.5, high])
    if empty := [c for c in scores if not edges[c]]:
        raise ValueError(f"no rows, or nulls only: {', '.join(empty)}")
    out = {}
    for c, (a, m, b) in edges.items():
        if steps == 1:
            out[c] = [m]
        else:
            a, b = (math.floor(a), math.ceil(b)) if percentiles else (a, b)
            out[c] = [a + (b - a) * i / (steps - 1) for i in range(steps)]
    return out


def evaluated(df: DataFrame, policy: Policy) -> DataFrame:
    """The policy without its cutoffs (those by segment stay, as filters): columns _p (approval before rates) and _bad (expected bads) beside df's."""
    free = replace(policy, stages=tuple(s for s in policy.stages if s.kind != "cutoff"), calibration_score=policy.score_for_calibration())
    sim = simulate(df, free)
    p = F.col("approved_pre_rate").cast("double")
    return sim.withColumn("_p", p).withColumn("_bad", p * F.coalesce(F.col("simulated_default"), quoted(policy.default).cast("double"), F.lit(0.0)))


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys, of which nulls are equal too."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(other, all_of([quoted(k).eqNullSafe(quoted(f"_r_{k}")) for k in keys]), how).drop(*(f"_r_{k}" for k in keys))


def grid(df: DataFrame, cutoffs: dict[str, list[float]], keys: list[str] | None = None) -> DataFrame:
    """Every combination's approval and default rate: keys, combination_id, one column per score, approval_rate, default_rate.

    df has _p and _bad (see ``evaluated``). Rows without a score reach no cutoff of it.
    """
    keys = keys or []
    spark = df.sparkSession
    if math.prod(len(v) + 1 for v in cutoffs.values()) > MAX_CELLS:
        raise ValueError("the grid has too many cells")
    cell = {c: sum((F.when(F.col(c) >= F.lit(x), 1).otherwise(0) for x in sorted(v)), F.lit(0)) for c, v in cutoffs.items()}
    sums = df.groupBy(*keys, *(e.alias(f"_{c}") for c, e in cell.items())).agg(F.sum("_p").alias("_p"), F.sum("_bad").alias("_bad"), F.count(F.lit(1)).alias("_n"))
    lattice = sums.select(*keys).distinct() if keys else spark.range(1).select()
    for c, v in cutoffs.items():
        lattice = lattice.crossJoin(F.broadcast(spark.range(0, len(v) + 1).select(F.col("id").cast("int").alias(f"_{c}"))))
    places = [f"_{c}" for c in cutoffs]
    full = _matched(lattice, sums, [*keys, *places], "left").fillna(0.0, ["_p", "_bad"]).fillna(0, ["_n"])
    total = sums.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    full = _matched(full, total, keys) if keys else full.crossJoin(F.broadcast(total))
    for place in places:
        down = Window.partitionBy(*keys, *(x for x in places if x != place)).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({"_p": F.sum("_p").over(down), "_bad": F.sum("_bad").over(down)})
    at = all_of([F.col(x) > 0 for x in places])
    values = [F.get(F.array(*map(F.lit, map(float, sorted(v)))), F.col(f"_{c}") - 1).alias(c) for c, v in cutoffs.items()]
    number, width = F.lit(1), 1
    for c, v in reversed(cutoffs.items()):
        number, width = number + (F.col(f"_{c}") - 1) * width, width * len(v)
    rate = F.coalesce(F.try_divide(F.col("_bad"), F.col("_p")), F.lit(0.0))
    return full.where(at).select(*keys, number.cast("int").alias("combination_id"), *values, (F.col("_p") / F.col("_total")).alias("approval_rate"), rate.alias("default_rate"))


def judged(points: DataFrame, max_default: float, min_approval: float = 0.0) -> DataFrame:
    if not 0.0 <= max_default <= 1.0 or not 0.0 <= min_approval <= 1.0:
        raise ValueError("rates must lie within 0 and 1")
    met = (F.round("default_rate", 9) <= max_default) & (F.round("approval_rate", 9) >= min_approval)
    return points.withColumns({"constraints_met": met, "tradeoff_score": F.col("approval_rate") - 5 * F.col("default_rate")})


def best(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The feasible point of highest approval, else the highest trade-off score; ties to the lowest combination."""
    worth = F.round(F.when(F.col("constraints_met"), F.col("approval_rate")).otherwise(F.col("tradeoff_score")), 9)
    first = F.min(F.struct((~F.col("constraints_met")).alias("unmet"), (-worth).alias("loss"), "combination_id", F.struct(*points.columns).alias("point")))
    return points.groupBy(*(keys or [])).agg(first.alias("first")).where("first is not null").select("first.point.*")


def pareto(points: DataFrame) -> DataFrame:
    """Combinations on the frontier of approval (up) and default (down); those that share a point all stay.

    Approval values are ranked in ranges: the least default of all higher ranges and
    of the higher values of its own range decides on each.
    """
    rows = points.withColumns({"_a": F.round("approval_rate", 9), "_d": F.round("default_rate", 9)})
    least = rows.groupBy("_a").agg(F.min("_d").alias("_d")).withColumn("_down", -F.col("_a"))
    higher = running(least, [], ["_down"], ["_d"], least=True, before=True)
    front = higher.where("_d_to is null or _d < _d_to").select("_a", "_d")
    return rows.join(front, ["_a", "_d"]).drop("_a", "_d")


def equivalent(points: DataFrame, metric: str, value: float, tolerance: float = 0.01) -> DataFrame:
    """Points whose metric is within tolerance of the value, numbered from the nearest (position); if there is none, the nearest one."""
    rows = points.withColumn("diff", F.round(F.abs(F.col(metric) - value), 9))
    nearest = rows.agg(F.min(F.struct("diff", "combination_id")).alias("_first"))
    near = rows.crossJoin(F.broadcast(nearest)).where((F.col("diff") <= tolerance) | (F.struct("diff", "combination_id") == F.col("_first"))).drop("_first")  # one row is broadcast
    placed = running(near.withColumn("_one", F.lit(1)), [], ["diff", "combination_id"], ["_one"])
    return placed.withColumn("position", F.col("_one_to").cast("int")).drop("_one", "_one_to", "_one_all")


def _points(df: DataFrame, params: dict[str, list[float]]) -> DataFrame:
    """One row for each combination: combination_id and the values as _v0, _v1, ...; to be broadcast, so their number is bounded."""
    if math.prod(map(len, params.values())) > MAX_POINTS:
        raise ValueError("the grid has too many combinations")
    rows = [(i, *map(float, v)) for i, v in enumerate(product(*params.values()), 1)]
    return df.sparkSession.createDataFrame(rows, ", ".join(["combination_id int", *(f"_v{j} double" for j in range(len(params)))]))


def _with_pd(full: DataFrame, keep: Column, policy: Policy, every: DataFrame | None = None) -> DataFrame:
    """full (rows of weight _n, with _nd known defaults and _bad bads, for each combination_id) with _pd, calibrated on each combination's keep rows.

    every has all rows of the table, if full has only those that a combination takes.
    """
    name, (bins, least) = policy.score_for_calibration(), policy.bins_and_least()
    score = quoted(name).cast("double") if name else F.lit(None).cast("double")
    in_keep = lambda c: F.sum(F.when(keep, F.col(c)))
    some = [in_keep("_n").alias("_k"), F.coalesce(F.try_divide(in_keep("_bad"), in_keep("_nd")), F.lit(0.0)).alias("_mean")]
    none = F.array().cast("array<double>")
    if isinstance(bins, int):
        points = [i / bins for i in range(bins + 1)]
        wide = policy.calibration_base in ("global", "all", "dataset")
        if wide and every is not None:
            edges = quantiles(every.withColumn("_score", score), [], "_score", points, "_n")
            fits = full.groupBy("combination_id").agg(*some).join(F.broadcast(edges), F.lit(True), "left")  # one row
        else:
            edges = quantiles((full if wide else full.where(keep)).withColumn("_score", score), ["combination_id"], "_score", points, "_n")
            fits = full.groupBy("combination_id").agg(*some).join(edges, "combination_id", "left")
        fits = fits.withColumn("_inner", F.coalesce(inner_edges(F.col("edges")), none)).drop("edges")
    else:
        fits = full.groupBy("combination_id").agg(*some).withColumn("_inner", F.array(*(F.lit(float(e)) for e in bins)))
    binned = full.join(F.broadcast(fits), "combination_id").withColumn("_bin", F.when(score.isNotNull(), F.size(F.filter("_inner", lambda e: e < score))))
    means = binned.where(keep).groupBy("combination_id", "_bin").agg(F.try_divide(F.sum("_bad"), F.sum("_nd")).alias("_m"))
    joined = binned.join(F.broadcast(means), ["combination_id", "_bin"], "left")
    return joined.withColumn("_pd", F.when((F.col("_k") >= least) & F.lit(name is not None), F.coalesce("_m", "_mean")).otherwise(F.col("_mean")))


def _edges_below(edges: str, row: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < row))


def _stressed(full: DataFrame, swap: Column, policy: Policy) -> tuple[DataFrame, Column]:
    """full with what quantile stresses need, and the stressed ``_pd``; their bins are those of each combination's swap-ins."""
    bins = {}
    for k, s in enumerate(policy.stresses):
        if s.kind == "quantile":
            edges = edge_rows(full.where(swap), ["combination_id"], s.score, policy.applicant_id, s.bins).groupBy("combination_id").agg(F.array_sort(F.collect_list(F.struct("_score", "_tie"))).alias(f"_edges{k}"))
            full = full.join(F.broadcast(edges), "combination_id", "left")  # a row for each combination
            bins[k] = F.when(quoted(s.score).isNotNull(), _edges_below(f"_edges{k}", F.struct(quoted(s.score).cast("double").alias("_score"), quoted(policy.applicant_id).alias("_tie"))))
    return full, stressed_pd(full, policy, "_pd", bins)


def grid_stochastic(df: DataFrame, policy: Policy, cutoffs: dict[str, list[float]]) -> DataFrame:
    """Full stochastic evaluation of each combination, put before the policy's own stages, which all stay.

    Default rates are calibrated anew on each combination's keep-ins. The draws of a
    row do not depend on the combination, so the curves are smooth. Rows are summed by
    the cutoffs that they reach, scores, and ``DRAWS`` equal ranges of their draw: below
    a combination's default rate a range counts whole, and only the rows of the
    range that holds the rate are compared one by one. With a custom or quantile stress
    the points (MAX_POINTS at most, broadcast) meet the rows.
    """
    named = policy.calibration_score or any(s.kind in ("cutoff", "segment") for s in policy.stages)
    policy = replace(policy, calibration_score=policy.score_for_calibration() if named else list(cutoffs)[-1])
    points = _points(df, cutoffs)
    whole = any(s.kind in ("custom", "quantile") for s in policy.stresses)
    out = (_stochastic_rows if whole else _stochastic_sums)(df, policy, points, cutoffs)
    return out.select("combination_id", *(F.col(f"_v{j}").alias(c) for j, c in enumerate(cutoffs)), "approval_rate", "default_rate")


def _drawn(df: DataFrame, policy: Policy, more: list[str]) -> DataFrame:
    """The evaluated rows with what the grid reads: scores and columns of stress, past decision, default, draw."""
    sim, default = simulate(df, policy, "stochastic"), quoted(policy.default).cast("double")
    read = {policy.calibration_score, *more, *(c for s in policy.stresses for c in (s.score, s.column) if c in df.columns)}
    read |= {policy.applicant_id} if any(s.kind == "quantile" for s in policy.stresses) else set()
    kept = [F.col("*")] if any(s.kind == "custom" for s in policy.stresses) else [quoted(c) for c in sorted(read)] + [F.col("new_approval"), F.col("approved_pre_rate")]
    return sim.select(
        *kept, F.coalesce(quoted(policy.approved), F.lit(0)).alias("_old"), F.lit(1).alias("_n"), default.isNotNull().cast("int").alias("_nd"),
        F.coalesce(default, F.lit(0.0)).alias("_bad"), uniform(f"{policy.seed}-default", quoted(policy.applicant_id)).alias("_draw"))


def _stochastic_rows(df: DataFrame, policy: Policy, points: DataFrame, cutoffs: dict[str, list[float]]) -> DataFrame:
    full = _drawn(df, policy, list(cutoffs)).crossJoin(F.broadcast(points))
    ok = all_of([F.coalesce(quoted(c) >= F.col(f"_v{j}"), F.lit(False)) for j, c in enumerate(cutoffs)])
    full = _with_pd(full, ok & (F.col("approved_pre_rate") > 0) & (F.col("_old") > 0), policy)
    full, stressed = _stressed(full, ok & (F.col("approved_pre_rate") > 0) & (F.col("_old") <= 0), policy)
    took = F.when(ok, F.col("new_approval")).otherwise(0).cast("double")
    bad = F.when(F.col("_old") > 0, F.col("_bad")).otherwise((F.col("_draw") < stressed).cast("double"))
    return full.groupBy(*points.columns).agg(F.avg(took).alias("approval_rate"), F.coalesce(F.try_divide(F.sum(took * bad), F.sum(took)), F.lit(0.0)).alias("default_rate"))


def _stochastic_sums(df: DataFrame, policy: Policy, points: DataFrame, cutoffs: dict[str, list[float]]) -> DataFrame:
    rows = _drawn(df, policy, list(cutoffs))

    def reached(score: str, values: list[float]) -> Column:
        value = F.array(*(F.lit(float(v)) for v in values))
        return F.filter(F.sequence(F.lit(0), F.lit(len(values) - 1)), lambda i: F.coalesce(quoted(score) >= F.get(value, i), F.lit(False)))

    places = {f"_v{j}": reached(c, v) for j, (c, v) in enumerate(cutoffs.items())}
    read = sorted({policy.calibration_score, *(c for s in policy.stresses for c in (s.score, s.column) if c in df.columns)})
    kept = F.col("_old") > 0
    # keep-ins calibrate whether they were hired or not; swap-ins count if they were drawn; written once, for the sums and for the rows that are compared
    some = staged(rows.where((F.col("approved_pre_rate") > 0) & (kept | (F.col("new_approval") > 0))).select(
        *map(quoted, read), kept.alias("_kept"), F.when(~kept, F.floor(F.col("_draw") * DRAWS).cast("int")).alias("_range"), "_draw", F.col("new_approval").alias("_take"), "_n",
        F.when(kept, F.col("_nd")).otherwise(0).alias("_nd"), F.when(kept, F.col("_bad")).otherwise(0.0).alias("_bad"), *(c.alias(k) for k, c in places.items()),
    ), "drawn")
    sums = ["_n", "_nd", "_bad", "_took", "_lost"]
    cells = some.withColumns({"_took": F.when(F.col("_kept"), F.col("_take")).otherwise(F.col("_n")).cast("double"), "_lost": F.col("_bad") * F.col("_take")})
    cells = cells.groupBy(*map(quoted, read), "_kept", "_range", *places).agg(*(F.sum(c).alias(c) for c in sums))
    full = _with_pd(_by_sets(cells, [*read, "_kept", "_range"], list(places), sums), F.col("_kept"), policy, rows)
    full, stressed = _stressed(full, ~F.col("_kept"), policy)
    full = full.withColumn("_rate", stressed).withColumn("_at", F.floor(F.col("_rate") * DRAWS).cast("int"))
    below = F.when(F.col("_kept"), F.col("_lost")).when(F.col("_range") < F.col("_at"), F.col("_n").cast("double")).otherwise(0.0)
    by_set = full.groupBy("combination_id").agg(F.sum("_took").alias("_took"), F.sum(below).alias("_lost"))
    edge = full.where(~F.col("_kept") & (F.col("_range") == F.col("_at"))).select("combination_id", "_rate", F.col("_range").alias("_e_range"), *(quoted(c).alias(f"_e_{c}") for c in read), *(F.col(k).alias(f"_e{k}") for k in places))
    on = all_of([F.col("_range") == F.col("_e_range"), *(quoted(c).eqNullSafe(quoted(f"_e_{c}")) for c in read), *(F.array_contains(k, F.col(f"_e{k}")) for k in places)])
    close = some.where(~F.col("_kept")).join(edge, on).where("_draw < _rate").groupBy(F.col("combination_id").alias("_c")).agg(F.count(F.lit(1)).alias("_more"))
    found = by_set.join(close, F.col("combination_id") == F.col("_c"), "left").select(F.col("combination_id").alias("_of"), "_took", (F.col("_lost") + F.coalesce("_more", F.lit(0))).alias("_lost"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    took = F.coalesce("_took", F.lit(0.0))
    placed = points.withColumn("_set", _set_of({f"_v{j}": v for j, v in enumerate(cutoffs.values())}))
    out = placed.join(found, F.col("_set") == F.col("_of"), "left").crossJoin(F.broadcast(total))  # one row
    return out.select(*points.columns, (took / F.col("_total")).alias("approval_rate"), F.coalesce(F.try_divide(F.col("_lost"), took), F.lit(0.0)).alias("default_rate"))


def outcome(sim: DataFrame) -> list[Column]:
    p = F.col("approved_pre_rate").cast("double")
    return [F.avg(p).alias("approval_rate"), F.coalesce(F.try_divide(F.sum(p * F.coalesce(F.col("simulated_default"), F.lit(0.0))), F.sum(p)), F.lit(0.0)).alias("default_rate")]


def vary(policy: Policy, name: str, value: float | Column) -> Policy:
    """The policy with one parameter changed: ``cutoff:<score>``, ``base_rate:<stage>`` or ``aggravation``."""
    kind, _, target = name.partition(":")
    if kind == "aggravation":
        return replace(policy, stresses=(Stress("aggravation", factor=value),))
    if kind == "base_rate":
        return replace(policy, stages=tuple(replace(s, base_rate=value) if s.kind == "rate" and s.name == target else s for s in policy.stages))
    new, found = [], False
    for s in policy.stages:
        if s.kind == "cutoff" and target in s.cutoffs:
            s, found = replace(s, cutoffs={**s.cutoffs, target: value}), True
        new.append(s)
    return replace(policy, stages=(*new, *([] if found else [cutoff_stage(f"cutoff {target}", {target: value})])))


def tradeoff(df: DataFrame, policy: Policy, params: dict[str, list[float]]) -> DataFrame:
    """Full evaluation of each grid point, calibration refitted: the parameters, approval_rate, default_rate.

    The table is read for a histogram of all that the evaluation reads, and that is summed
    by the cutoffs that its rows reach. What a set of cutoffs takes in follows from
    these sums, one cutoff after the other, so no row meets the grid; each set is
    calibrated once, whatever the stress. A custom stress may read any column, and
    a quantile stress tells rows of one score apart: with either, the points
    (MAX_POINTS at most, broadcast) meet the rows.
    """
    points = _points(df, params)
    varied = policy
    for j, name in enumerate(params):
        varied = vary(varied, name, F.col(f"_v{j}"))
    whole = any(s.kind in ("custom", "quantile") for s in varied.stresses)
    out = _tradeoff_rows(df, varied, points) if whole else _tradeoff_sums(df, varied, points, params)
    return out.select("combination_id", *(F.col(f"_v{j}").alias(n.replace(":", "_")) for j, n in enumerate(params)), "approval_rate", "default_rate")


def _tradeoff_rows(df: DataFrame, policy: Policy, points: DataFrame) -> DataFrame:
    full = _weighted(df, policy).crossJoin(F.broadcast(points))
    new = F.col("_fixed") & all_of([s.passes(full) > 0 for s in policy.stages if s.kind == "cutoff"])
    keep, swap = new & (F.col("_old") > 0), new & (F.col("_old") <= 0)
    full, stressed = _stressed(_with_pd(full, keep, policy), swap, policy)
    bad = F.sum(F.when(keep, F.col("_bad")).when(swap, stressed * F.col("_n")).otherwise(0.0))
    took = F.sum(F.when(new, F.col("_n")).otherwise(0).cast("double"))
    return full.groupBy(*points.columns).agg((took / F.sum("_n")).alias("approval_rate"), F.coalesce(F.try_divide(bad, took), F.lit(0.0)).alias("default_rate"))


def _reached(histogram: DataFrame, policy: Policy, params: dict[str, list[float]]) -> dict[str, Column]:
    """For each varied cutoff (by its column of points): the numbers of its values that a row reaches, as an array."""

    def reached(target: str, values: list[float]) -> Column:
        stages = [s for s in policy.stages if s.kind == "cutoff" and target in s.cutoffs]
        value = F.array(*(F.lit(float(v)) for v in values))
        passes = lambda i: all_of([replace(s, cutoffs={target: F.get(value, i)}).passes(histogram) > 0 for s in stages])
        return F.filter(F.sequence(F.lit(0), F.lit(len(values) - 1)), passes)

    return {f"_v{j}": reached(name[7:], values) for j, (name, values) in enumerate(params.items()) if name.startswith("cutoff:")}


def _by_sets(cells: DataFrame, keys: list[str], reached: list[str], sums: list[str]) -> DataFrame:
    """cells (keys, an array of the values reached of each cutoff, sums) -> combination_id, keys, a value number of each cutoff, sums: what each set of cutoffs takes in.

    One cutoff after the other, so that no step has more rows than the values of
    one times the cells of the others. The result is written once, as calibration and
    stress read it several times.
    """
    for k in reached:
        others = [F.col(x) for x in reached if x != k]
        one = cells.select(*map(quoted, keys), *others, F.explode(k).alias(k), *sums)
        cells = one.groupBy(*map(quoted, keys), *reached).agg(*(F.sum(c).alias(c) for c in sums))
    return staged(cells.withColumn("combination_id", F.concat_ws("-", *(F.col(k).cast("string") for k in reached)) if reached else F.lit("")), "sets")


def _set_of(values: dict[str, list[float]]) -> Column:
    """The combination_id of ``_by_sets`` from columns of values."""
    places = [F.array_position(F.array(*(F.lit(float(x)) for x in v)), F.col(k)).cast("int") - 1 for k, v in values.items()]
    return F.concat_ws("-", *(p.cast("string") for p in places)) if places else F.lit("")


def _tradeoff_sums(df: DataFrame, policy: Policy, points: DataFrame, params: dict[str, list[float]]) -> DataFrame:
    histogram = _weighted(df, policy)
    total = histogram.agg(F.sum("_n").alias("_total"))
    name = policy.score_for_calibration()
    free = [f"_v{j}" for j, n in enumerate(params) if not n.startswith("cutoff:")]
    fixed = [replace(s, cutoffs={c: v for c, v in s.cutoffs.items() if not isinstance(v, Column)}) for s in policy.stages if s.kind == "cutoff"]
    reached = _reached(histogram, policy, params)
    read = sorted({*([name] if name else []), *(c for s in policy.stresses for c in ([s.score] if s.kind == "monotonic" else [s.column] if s.column in df.columns else []))})
    passed = histogram.where(F.col("_fixed") & all_of([s.passes(histogram) > 0 for s in fixed]))
    keys = [*map(quoted, read), (F.col("_old") > 0).alias("_kept")]
    sums = [F.sum(c).alias(c) for c in ("_n", "_nd", "_bad")]
    taken = passed.groupBy(*keys, *(c.alias(k) for k, c in reached.items())).agg(*sums)
    full = _with_pd(_by_sets(taken, [*read, "_kept"], list(reached), ["_n", "_nd", "_bad"]), F.col("_kept"), policy, histogram)
    stress = [c for c in read if any(c in (s.score, s.column) for s in policy.stresses)]
    cells = full.groupBy("combination_id", "_kept", "_pd", *map(quoted, stress)).agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"))
    placed = points.withColumn("_set", _set_of({k: params[list(params)[int(k[2:])]] for k in reached}))
    free_points = points.select(*free).distinct() if free else None
    met = cells.crossJoin(F.broadcast(free_points)) if free else cells  # the values of rates and factors, not of cutoffs
    met, stressed = _stressed(met, ~F.col("_kept"), policy)
    n = F.col("_n").cast("double")
    by_set = met.groupBy(F.col("combination_id").alias("_of"), *(F.col(c).alias(f"_f{c}") for c in free)).agg(F.sum(n).alias("_took"), F.sum(F.when(F.col("_kept"), F.col("_bad")).otherwise(stressed * n)).alias("_lost"))
    on = all_of([F.col("_set") == F.col("_of"), *(F.col(c) == F.col(f"_f{c}") for c in free)])
    took = F.coalesce("_took", F.lit(0.0))
    out = placed.join(by_set, on, "left").crossJoin(F.broadcast(total))  # one row
    return out.select(*points.columns, (took / F.col("_total")).alias("approval_rate"), F.coalesce(F.try_divide(F.col("_lost"), took), F.lit(0.0)).alias("default_rate"))


def _weighted(df: DataFrame, p: Policy) -> DataFrame:
    """Filters and cutoffs by segment (_fixed) and past decision (_old) with the columns that cutoffs, calibration and stress read, and counts; rows with a custom stress."""
    fixed = all_of([s.passes(df) > 0 for s in p.stages if s.kind in ("filter", "segment")])
    old, default = F.coalesce(quoted(p.approved), F.lit(0)), quoted(p.default).cast("double")
    if any(s.kind in ("custom", "quantile") for s in p.stresses):
        return df.withColumns({"_fixed": fixed, "_old": old, "_n": F.lit(1), "_nd": default.isNotNull().cast("int"), "_bad": F.coalesce(default, F.lit(0.0))})
    cutoffs = [c for s in p.stages if s.kind == "cutoff" for c in s.cutoffs]
    stress = [c for s in p.stresses for c in ([s.score] if s.kind == "monotonic" else [s.column] if s.column in df.columns else [])]
    read = sorted({c for c in [p.score_for_calibration(), *cutoffs, *stress] if c})
    rows = df.select(fixed.alias("_fixed"), *map(quoted, read), old.alias("_old"), default.alias("_d"))
    return rows.groupBy("_fixed", *map(quoted, read), "_old").agg(F.count(F.lit(1)).alias("_n"), F.count("_d").alias("_nd"), F.sum(F.coalesce("_d", F.lit(0.0))).alias("_bad"))


def crash_test(df: DataFrame, policy: Policy, factors: list[float]) -> DataFrame:
    """Default rate of the new policy as swap-in PD is multiplied; funnel and baseline are computed once."""
    sim = simulate(df, replace(policy, stresses=()), fitted=fit(df, policy))
    p = F.col("approved_pre_rate").cast("double")
    table = sim.groupBy("scenario", "simulated_default").agg(F.sum(p).alias("v"), F.sum(p * F.coalesce("simulated_default", F.lit(0.0))).alias("b"))
    rows = table.withColumn("factor", F.explode(F.array(*map(F.lit, map(float, factors)))))
    stressed = F.least(F.col("simulated_default") * F.col("factor"), F.lit(1.0)) * F.col("v")
    return rows.groupBy("factor").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("scenario") == "swap_in", stressed).otherwise(F.col("b"))), F.sum("v")), F.lit(0.0)).alias("default_rate"))


def breakeven(curve: DataFrame, legacy_rate: float) -> DataFrame:
    """The first factor at which the default rate reaches the legacy rate (null if none does)."""
    return curve.agg(F.min(F.when(F.round("default_rate", 9) >= legacy_rate, F.col("factor"))).alias("breakeven_factor"))


def model_frontier(df: DataFrame, policy: Policy, cutoffs: dict[str, list[float]]) -> DataFrame:
    """One-score grids of several models side by side: one evaluation and one aggregate, whose rows are (model, cutoffs reached)."""
    width = max(map(len, cutoffs.values()))
    if width * len(cutoffs) > MAX_CELLS:
        raise ValueError("the grids have too many cells")
    places = [F.struct(F.lit(c).alias("model"), sum((F.when(F.col(c) >= F.lit(x), 1).otherwise(0) for x in sorted(v)), F.lit(0)).alias("place")) for c, v in cutoffs.items()]
    sums = evaluated(df, policy).select("_p", "_bad", F.explode(F.array(*places)).alias("at")).groupBy("at.model", "at.place").agg(F.sum("_p").alias("_p"), F.sum("_bad").alias("_bad"), F.count(F.lit(1)).alias("_n"))
    steps = [(c, i, float(x)) for c, v in cutoffs.items() for i, x in enumerate(sorted(v), 1)]
    lattice = df.sparkSession.createDataFrame(steps, "model string, place int, cutoff double")
    every = lattice.select("model", "place", "cutoff").join(sums, ["model", "place"], "full").fillna(0.0, ["_p", "_bad"]).fillna(0, ["_n"])  # rows below the first cutoff count in the total
    down = Window.partitionBy("model").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("_n").over(Window.partitionBy("model"))
    found = every.withColumns({"_p": F.sum("_p").over(down), "_bad": F.sum("_bad").over(down), "_total": whole}).where("cutoff is not null")
    rate = F.coalesce(F.try_divide(F.col("_bad"), F.col("_p")), F.lit(0.0))
    return found.select("model", F.col("place").alias("combination_id"), "cutoff", (F.col("_p") / F.col("_total")).alias("approval_rate"), rate.alias("default_rate"))


def proposals(frontier: DataFrame, approval: float, default: float) -> DataFrame:
    """Of one model's frontier: same approval as legacy, same default rate, and nearest to the mean of both cutoffs."""
    nearest = lambda rows, metric, value: rows.orderBy(F.round(F.abs(F.col(metric) - value), 9), "combination_id").limit(1)
    a = nearest(frontier, "approval_rate", approval).withColumn("proposal", F.lit("same_approval"))
    b = nearest(frontier, "default_rate", default).withColumn("proposal", F.lit("same_default"))
    mean = a.unionByName(b).agg(F.avg("cutoff").alias("_mean"))
    c = frontier.crossJoin(mean).orderBy(F.round(F.abs(F.col("cutoff") - F.col("_mean")), 9), "combination_id").limit(1).drop("_mean").withColumn("proposal", F.lit("between"))
    return a.unionByName(b).unionByName(c)

