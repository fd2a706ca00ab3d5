"""Production rules: policies and ratings in the JSON shape that other systems exchange.

``export_rules`` writes the shape, ``import_rules`` reads it and its two older forms. Key
names and type names below are fixed values of that format.
"""

from __future__ import annotations

import json
import re
from typing import Any

from creditflow.functions.expressions import REGISTRY
from creditflow.operators.policy import Policy, Stage, Stress, cutoff_stage, filter_stage, rate_stage, segment_cutoff_stage
from creditflow.operators.ratings import Bands, Recipe, Segmented

#: Roles: name in the format -> field of a policy.
ROLES = {"applicant_id_col": "applicant_id", "score_cols": "score_cols", "current_approval_col": "approved", "actual_default_col": "default", "time_col": "time"}
#: Further roles of the older form.
OLD_ROLES = {**ROLES, "calibration_score_col": "calibration_score", "calibration_bins": "calibration_bins", "calibration_base": "calibration_base", "current_hired_col": "hired"}
#: Operators of conditions and what SQL calls them.
OPERATORS = {"&": "AND", "|": "OR", "~": "NOT", "==": "="}
#: What a policy has where the metadata leaves a role out.
MISSING = {"applicant_id": "applicant_id", "score_cols": (), "approved": "approved", "default": "defaulted"}

Rating = Recipe | Bands | Segmented | None


def sql_condition(text: str) -> str:
    """A condition with &, |, ~ and == as SQL; quoted text and names in backticks stay."""
    parts = re.split(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", text)
    return "".join(p if i % 2 else re.sub(r"==|[&|~]", lambda m: f" {OPERATORS[m[0]]} ", p) for i, p in enumerate(parts))


def _operand(x: Any) -> str:
    if isinstance(x, dict):
        return sql_expression(x)
    if x is None or isinstance(x, bool):
        return json.dumps(x)
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else repr(x)


def sql_expression(tree: dict) -> str:
    """A stored expression tree (column, binary, unary) as SQL text."""
    kind = tree["type"]
    if kind == "column":
        return "`" + tree["name"].replace("`", "``") + "`"
    op = OPERATORS.get(tree.get("op"), tree.get("op"))
    if kind == "binary":
        if op not in (*OPERATORS.values(), ">", ">=", "<", "<=", "!=", "+", "-", "*", "/"):
            raise ValueError(f"unknown operator: {op}")
        return f"({_operand(tree['left'])} {op} {_operand(tree['right'])})"
    if kind == "unary":
        return f"(NOT {_operand(tree['expr'])})"
    raise ValueError(f"unknown expression: {kind}")


def _registered(name: str) -> str:
    if name not in REGISTRY:
        raise ValueError(f"function {name} is not registered")
    return f"@{name}"


def _condition(x: Any) -> str:
    if isinstance(x, dict):
        return _registered(x["name"]) if x["type"] == "callable" else sql_expression(x)
    return _registered(x.removeprefix("callable:")) if x.startswith("callable:") else sql_condition(x)


def _variable(x: Any):
    if not isinstance(x, dict):
        return x
    if x["type"] == "callable":
        return _registered(x["name"])
    return ("calibrated", sql_expression(x["expression"])) if x["type"] == "calibrated" else sql_expression(x)


def _stage(d: dict) -> Stage:
    kind, name = d["type"], d["name"]
    if kind == "filter":
        return filter_stage(name, _condition(d["expression"] if "expression" in d else d["condition"]))
    if kind == "score_cutoff":
        return cutoff_stage(name, d["values"], "gte" if d["operator"] == ">=" else "lte")
    if kind == "cutoff":
        return cutoff_stage(name, d["cutoffs"], d.get("direction", "gte"))
    if kind == "segment_cutoff":
        return segment_cutoff_stage(name, d["column"], d["segmentation_column"], d["values"])
    if kind in ("rate_conversion", "rate"):
        variable = _variable(d.get("propensity_column", d.get("variable")))
        return rate_stage(name, d["base_rate"], variable, bool(d.get("calibrate", False)))
    raise ValueError(f"unknown stage type: {kind}")


def _stress(d: dict) -> Stress:
    if d["type"] == "aggravation":
        return Stress("aggravation", d.get("factor", 1.5), column=d.get("factor_col"))
    if d["type"] == "monotonic_increase":
        return Stress("monotonic", d["factor"], score=d["score_col"], baseline=d["baseline"])
    if d["type"] == "quantile":
        return Stress("quantile", d["factor"], score=d["score_col"], bins=d.get("bins", 10))
    raise ValueError(f"a stress of type {d['type']} cannot be read")


def _bands(score: str, rows: list[dict]) -> Bands:
    return Bands(score, tuple((r["rating"], r["min_score"], r["max_score"]) for r in rows))


def _recipe(scores: list[str], breaks: dict, cells: dict) -> Recipe:
    number = lambda v: ord(v.upper()) - 64 if isinstance(v, str) and len(v) == 1 else int(v)
    return Recipe({c: tuple(map(float, breaks[c])) for c in scores}, {str(k): number(v) for k, v in cells.items()})


def _rating(d: dict | None) -> Rating:
    if not d:
        return None
    if d.get("type") == "matrix":
        return _recipe(d["score_columns"], d["quantile_breaks"], d["cell_mapping"])
    if d.get("type") == "segmented_matrix":
        return Segmented(d.get("segmentation_column", "region"), {seg: _recipe(x["score_columns"], x["quantile_breaks"], x["cell_mapping"]) for seg, x in d["segments"].items()})
    if "segments" in d:
        return Segmented(d.get("segmentation_column", "region"), {seg: _bands(d["score_column"], rows) for seg, rows in d["segments"].items()})
    return _bands(d["score_column"], d["intervals"])


def _old_rating(d: dict | None) -> Rating:
    if not d:
        return None
    if d.get("type") == "segmented_recipes":
        parts = {seg: _old_rating(x) for seg, x in d["recipes"].items()}
        return Segmented(next((x["segment_col"] for x in d["recipes"].values() if x.get("segment_col")), "region"), parts)
    scores = [d["score_cols"]] if isinstance(d["score_cols"], str) else d["score_cols"]
    if d.get("intervals") is not None:
        return _bands(scores[0], d["intervals"])
    if d.get("segmented_intervals") is not None:
        return Segmented(d.get("segment_col") or "region", {seg: _bands(scores[0], rows) for seg, rows in d["segmented_intervals"].items()})
    return _recipe(scores, d["quantile_breaks"], d["cluster_mapping"])


def _policy(roles: dict, names: dict[str, str], stages: list[dict], stresses: list[dict]) -> Policy:
    given = {field: roles[key] for key, field in names.items() if roles.get(key) is not None}
    listed = {k: tuple(v) if isinstance(v, list) else v for k, v in {**MISSING, **given}.items()}
    return Policy(**listed, stages=tuple(map(_stage, stages)), stresses=tuple(map(_stress, stresses)))


def import_rules(rules: dict | str) -> tuple[Policy, Rating]:
    """Policy and rating of production rules, or of an older export (a policy with its recipe).

    Conditions become SQL; callables must be registered under their names. Clean rules
    have no roles: the policy then has the customary ones.
    """
    d = json.loads(rules) if isinstance(rules, str) else rules
    if "policy" in d or "stages" in d:
        p = d.get("policy", d)
        return _policy(p, OLD_ROLES, p.get("stages", []), p.get("stress_scenarios", [])), _old_rating(d.get("rating_recipe") or p.get("rating_recipe"))
    return _policy(d.get("metadata", {}), ROLES, d.get("funnel_stages", []), d.get("stress", [])), _rating(d.get("rating_classification"))


def _text(what: Any, stage: str) -> Any:
    """A saved condition or variable: SQL text, a name or a number; registered functions by name."""
    if what is not None and not isinstance(what, (str, int, float)):
        raise TypeError(f"stage {stage}: only SQL text, numbers and registered names can be saved")
    return f"callable:{what[1:]}" if isinstance(what, str) and what.startswith("@") else what


def _exported(stage: Stage, position: int) -> dict:
    head = {"position": position, "name": stage.name}
    if stage.kind == "filter":
        return {**head, "type": "filter", "expression": _text(stage.condition, stage.name)}
    if stage.kind == "cutoff":
        return {**head, "type": "score_cutoff", "columns": list(stage.cutoffs), "operator": ">=" if stage.direction == "gte" else "<=", "values": stage.cutoffs}
    if stage.kind == "segment":
        (score,) = stage.cutoffs
        return {**head, "type": "segment_cutoff", "column": score, "segmentation_column": stage.segment, "values": stage.minimum}
    v = stage.variable
    if isinstance(v, (tuple, list)):
        raise TypeError(f"stage {stage.name}: a calibrated rate is saved with what it learned, in a bundle")
    return {**head, "type": "rate_conversion", "base_rate": stage.base_rate, "propensity_column": {"type": "callable", "name": v[1:]} if isinstance(v, str) and v.startswith("@") else _text(v, stage.name)}


def _letter(group: int) -> str:
    return chr(64 + group) if 1 <= group <= 26 else "E"


def _cells(recipe: Recipe) -> dict:
    return {"score_columns": list(recipe.breaks), "quantile_breaks": {c: list(b) for c, b in recipe.breaks.items()}, "cell_mapping": {k: _letter(g) for k, g in recipe.mapping.items()}}


def whole_score_bands(part: Recipe | Bands, top: int = 1000) -> list[dict]:
    """Bands of a part with one score. A recipe's are the least and greatest whole score from 0 to top of each letter; all groups from the fifth on, and bins without one, are E."""
    if isinstance(part, Bands):
        return [{"rating": r, "min_score": a, "max_score": b} for r, a, b in part.bands]
    ((_, breaks),) = part.breaks.items()
    found: dict[str, list[int]] = {}
    for s in range(top + 1):
        group = part.mapping.get(str(sum(b <= s for b in breaks[1:-1])))
        rating = "ABCDE"[group - 1] if group is not None and 1 <= group <= 5 else "E"
        found[rating] = [min(s, *found.get(rating, [s])), s]
    return [{"rating": r, "min_score": a, "max_score": b} for r, (a, b) in sorted(found.items())]


def _score(part: Recipe | Bands) -> str:
    return part.score if isinstance(part, Bands) else next(iter(part.breaks))


def _classification(rating: Rating) -> dict | None:
    if rating is None:
        return None
    if isinstance(rating, Segmented):
        parts = rating.parts
        if any(isinstance(p, Recipe) and len(p.breaks) > 1 for p in parts.values()):
            if not all(isinstance(p, Recipe) for p in parts.values()):
                raise TypeError("bands and cells by segment cannot be saved together")
            return {"type": "segmented_matrix", "segmentation_column": rating.segment, "segments": {s: _cells(p) for s, p in parts.items()}}
        return {"score_column": _score(next(iter(parts.values()))), "segmentation_column": rating.segment, "segments": {s: whole_score_bands(p) for s, p in parts.items()}}
    if isinstance(rating, Recipe) and len(rating.breaks) > 1:
        return {"type": "matrix", **_cells(rating)}
    return {"score_column": _score(rating), "intervals": whole_score_bands(rating)}


def export_rules(policy: Policy, rating: Rating = None, clean: bool = False) -> dict:
    """The rules as a dictionary for JSON; clean keeps filters and cutoffs only.

    Ratings of one score become bands of whole scores, as the format has it; those of
    several keep their breaks and cells. Stresses and calibrations are no part of the
    format: a bundle has them.
    """
    stages = [s for s in policy.stages if not clean or s.kind != "rate"]
    funnel = [_exported(s, i) for i, s in enumerate(stages, 1)]
    if clean:
        return {"funnel_stages": funnel}
    roles = {key: list(v) if isinstance(v := getattr(policy, field), tuple) else v for key, field in ROLES.items()}
    return {"metadata": roles, "funnel_stages": funnel, "rating_classification": _classification(rating)}

