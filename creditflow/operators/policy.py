"""Policy specifications: roles, funnel stages, stress, calibration; and their JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creditflow.functions.expressions import all_of, clipped, quoted, resolve, true

#: Lower-case names that mark a rate stage as the step from approved to hired (fixed values).
CONVERSION_NAMES = ("conversao", "conversion", "hired", "take_up", "take_up_rate")


@dataclass(frozen=True)
class Stage:
    """A funnel step: ``filter`` (condition), ``cutoff`` (column -> minimum or maximum), ``segment`` (minimum by segment), ``rate``."""

    kind: str
    name: str
    condition: Any = None
    cutoffs: dict[str, float] = field(default_factory=dict)
    direction: str = "gte"
    segment: str | None = None
    minimum: dict[str, float] = field(default_factory=dict)
    base_rate: float = 1.0
    variable: Any = None
    calibrate: bool = False

    def passes(self, df: DataFrame) -> Column:
        """1.0 or 0.0 for the hard stages; unknown is 0."""
        if self.kind == "filter":
            return true(resolve(self.condition, df)).cast("double")
        if self.kind == "cutoff":
            side = (lambda c, v: quoted(c) >= F.lit(v)) if self.direction == "gte" else (lambda c, v: quoted(c) <= F.lit(v))
            return all_of([true(side(c, v)) for c, v in self.cutoffs.items()]).cast("double")
        (score,) = self.cutoffs or {None: None}
        least = F.coalesce(*(F.when(quoted(self.segment) == s, F.lit(v)) for s, v in self.minimum.items()), F.lit(None).cast("double"))
        return true(quoted(score) >= least).cast("double")

    def rate(self, df: DataFrame, calibrated=None) -> Column:
        """Pass probability of a rate stage: base_rate x variable within 0..1, base_rate alone as it is."""
        if calibrated is not None:
            return clipped(F.lit(float(self.base_rate)) * calibrated)
        if self.variable is None:
            return F.lit(float(self.base_rate))
        return clipped(F.lit(float(self.base_rate)) * F.coalesce(resolve(self.variable, df).cast("double"), F.lit(0.0)))


def filter_stage(name: str, condition) -> Stage:
    return Stage("filter", name, condition=condition)


def cutoff_stage(name: str, cutoffs: dict[str, float], direction: str = "gte") -> Stage:
    return Stage("cutoff", name, cutoffs=dict(cutoffs), direction=direction)


def segment_cutoff_stage(name: str, score: str, segment: str, minimum: dict[str, float]) -> Stage:
    return Stage("segment", name, cutoffs={score: 0}, segment=segment, minimum=dict(minimum))


def rate_stage(name: str, base_rate: float = 1.0, variable=None, calibrate: bool = False) -> Stage:
    """variable: none, number, column, expression, function of the frame, or ("calibrated", expression).

    calibrate=True makes it the step from approved to hired, and averages an expression
    (a Column, or SQL text that is more than a column's name) by score, as ("calibrated", expression) does.
    """
    return Stage("rate", name, base_rate=base_rate, variable=variable, calibrate=calibrate)


#: Named stress functions (DataFrame, name of the PD column -> Column) that saved rules can refer to.
STRESSES: dict[str, Callable[[DataFrame, str], Column]] = {}


@dataclass(frozen=True)
class Stress:
    """``aggravation`` (factor, or a factor column if the table has it), ``monotonic`` (score, factor, baseline), ``quantile`` (score, factor, bins) or ``custom`` (function of frame and PD name, or "@" and its name in STRESSES).

    quantile multiplies the k-th of equal bins of the swap-ins, by score and then id, by
    factor * k. Its edges are found with the other calibrations and then stay as they are.
    """

    kind: str
    factor: float = 1.0
    column: str | None = None
    score: str | None = None
    baseline: float = 0.0
    fn: Any = None
    bins: int = 10

    def apply(self, df: DataFrame, pd: str, bin_: Column | None = None) -> Column:
        """The stressed PD; bin_ is the row's bin (from 0) of a quantile stress."""
        if self.kind == "aggravation":
            return clipped_or_null(F.col(pd) * (quoted(self.column) if self.column in df.columns else F.lit(self.factor).cast("double")))
        if self.kind == "monotonic":
            return clipped_or_null(F.lit(float(self.baseline)) - quoted(self.score) / F.lit(1000.0) * F.lit(float(self.factor)))
        if self.kind == "quantile":
            return clipped_or_null(F.col(pd) * F.lit(float(self.factor)) * (1 + bin_))
        return clipped_or_null((STRESSES[self.fn[1:]] if isinstance(self.fn, str) else self.fn)(df, pd))


def clipped_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


@dataclass(frozen=True)
class Policy:
    applicant_id: str
    score_cols: tuple[str, ...] | str
    approved: str
    default: str
    time: str | None = None
    hired: str | None = None
    stages: tuple[Stage, ...] = ()
    stresses: tuple[Stress, ...] = ()
    rating: Any = None
    calibration_score: str | None = None
    calibration_bins: int | tuple[float, ...] | None = None
    calibration_base: str = "keep_in"
    seed: int = 42

    def __post_init__(self):
        if isinstance(self.score_cols, str):
            object.__setattr__(self, "score_cols", (self.score_cols,))

    def bins_and_least(self) -> tuple[int | list[float], int]:
        """The calibration's bins (a number or inner edges), and the keep-ins that it takes: 50 for the ten bins that stand where none are given, else 5."""
        given = self.calibration_bins
        return (10 if given is None else given if isinstance(given, int) else list(given)), (50 if given is None else 5)

    def with_stages(self, *stages: Stage) -> Policy:
        return replace(self, stages=(*self.stages, *stages))

    def with_stress(self, *stresses: Stress) -> Policy:
        return replace(self, stresses=(*self.stresses, *stresses))

    def score_for_calibration(self) -> str | None:
        """The named score, else the last cutoff column, else the last score."""
        last = [c for s in self.stages if s.kind in ("cutoff", "segment") for c in s.cutoffs]
        return self.calibration_score or (last[-1] if last else self.score_cols[-1] if self.score_cols else None)

    def conversion_stages(self, columns: list[str]) -> set[int]:
        """The rate stages that take approved to hired: flagged, named so, or last; none without a hired column."""
        if (self.hired or "hired") not in columns:
            return set()
        rates = [i for i, s in enumerate(self.stages) if s.kind == "rate"]
        return {i for i in rates if self.stages[i].calibrate or self.stages[i].name.lower() in CONVERSION_NAMES or i == rates[-1]}

    def validate(self, df: DataFrame) -> None:
        """Raises for roles and cutoff columns that the table lacks; conditions are checked by the analyser."""
        named = [self.applicant_id, *self.score_cols, self.approved, self.default, *([self.time] if self.time else []), *([self.hired] if self.hired else [])]
        named += [c for s in self.stages for c in [*s.cutoffs, *([s.segment] if s.segment else [])]]
        if missing := sorted(set(named) - set(df.columns)):
            raise ValueError(f"missing columns: {', '.join(missing)}")


def _stage_dict(stage: Stage) -> dict:
    out = {f.name: getattr(stage, f.name) for f in fields(stage)}
    if not isinstance(out["condition"], (str, type(None))) or not isinstance(out["variable"], (str, int, float, tuple, list, type(None))):
        raise TypeError(f"stage {stage.name}: only SQL text, numbers and names can be saved")
    return out


def to_json(policy: Policy, rating_bands: list[dict] | None = None, clean: bool = False) -> str:
    """The rules as JSON; clean keeps filters and cutoffs only.

    Conditions must be SQL text, column or registered names (with @); so must the
    function of a custom stress, as it has no other form that can be saved.
    """
    stages = [_stage_dict(s) for s in policy.stages if not clean or s.kind != "rate"]
    if clean:
        return json.dumps({"funnel_stages": stages})
    roles = {k: getattr(policy, k) for k in ("applicant_id", "score_cols", "approved", "default", "time", "hired", "calibration_score", "calibration_bins", "calibration_base", "seed")}
    stress = [{f.name: getattr(s, f.name) for f in fields(s)} for s in policy.stresses]
    if any(not isinstance(s["fn"], (str, type(None))) for s in stress):
        raise TypeError("a custom stress can be saved by its registered name only")
    return json.dumps({"metadata": roles, "funnel_stages": stages, "stress": stress, "rating_classification": rating_bands or []})


def from_json(text: str) -> tuple[Policy, list[dict]]:
    """Policy and bands of ``to_json``'s text."""
    data = json.loads(text)
    roles = data.get("metadata") or {"applicant_id": "applicant_id", "score_cols": [], "approved": "approved", "default": "actual_default"}
    listed = lambda v: tuple(v) if isinstance(v, list) else v
    stages = tuple(Stage(**{k: listed(v) for k, v in s.items()}) for s in data["funnel_stages"])
    return Policy(**{k: listed(v) for k, v in roles.items()}, stages=stages, stresses=tuple(Stress(**s) for s in data.get("stress", []))), data.get("rating_classification", [])


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """Rules or a recipe (JSON on one line) as a text table, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()["value"]
