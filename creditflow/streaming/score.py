"""A fitted policy on a stream: the plan is narrow and keeps no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from creditflow.operators import deploy
from creditflow.operators.evaluate import Fitted
from creditflow.operators.policy import Policy


def score_stream(stream: DataFrame, policy: Policy, fitted: Fitted, path: str, checkpoint: str, rating: Column | None = None) -> StreamingQuery:
    """Decisions for each micro-batch, appended as Parquet; exactly once by the file sink's log."""
    out = deploy.score(stream, policy, fitted, rating)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
