"""Scoring of new applicants with a saved policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from creditflow.operators.evaluate import Fitted, decisions, simulate
from creditflow.operators.policy import Policy


def score(df: DataFrame, policy: Policy, fitted: Fitted, rating: Column | None = None, simple: bool = True, method: str = "analytical") -> DataFrame:
    """Decisions for new rows: a narrow plan, batch or stream, as all that was learned is in ``fitted``.

    A missing id, approval or default column is filled (row number, 1, 0) for
    scoring and dropped again.
    """
    fill = {policy.applicant_id: F.monotonically_increasing_id(), policy.approved: F.lit(1), policy.default: F.lit(0)}
    missing = [c for c in fill if c not in df.columns]
    sim = simulate(df.withColumns({c: fill[c] for c in missing}) if missing else df, policy, method, fitted, rating)
    if simple:
        out = decisions(sim, policy, method, rating)
    else:
        out = sim.withColumn("Rating", F.chr(F.lit(64) + rating)) if rating is not None else sim
    return out.drop(*missing)
