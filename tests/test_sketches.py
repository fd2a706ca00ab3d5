"""Sketches by vintage: rank error against exact ranks, merging, and vintages written again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.functions import sketches


def test_ranks_of_merged_vintages_are_within_the_stated_error(spark, tmp_path):
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.lognormal(3, 1, 40_000), draw.normal(20, 3, 20_000).round()])
    rows = spark.createDataFrame([(i % 5, float(v)) for i, v in enumerate(values)], "m int, v double").repartition(7)
    path = str(tmp_path / "sketches")
    for m in (0, 1, 2, 3, 4, 2):  # one vintage arrives twice
        sketches.keep(sketches.sketch(rows.where(f"m = {m}"), ["v"], F.col("m")), path)
    kept = sketches.kept(spark, path)
    assert kept.count() == 5
    points = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    for vintages, own in (("0,1,2,3,4", values), ("1,3", values[np.isin(np.arange(len(values)) % 5, (1, 3))])):
        (r,) = sketches.quantiles(kept.where(f"vintage in ({vintages})"), points).collect()
        assert r.n == len(own)
        for p, e in zip(points, r.edges, strict=True):
            low, high = (own < e).mean(), (own <= e).mean()
            assert low - sketches.rank_error() <= p <= high + sketches.rank_error()
    share = sketches.merged(kept).select(sketches.share_up_to("sketch", F.lit(20.0))).first()[0]
    assert share == pytest.approx((values <= 20).mean(), abs=sketches.rank_error())
    assert sketches.rank_error(4096) < 0.0015 and sketches.rank_error(200) < 0.02


def test_odd_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", float("nan"), None), ("b", None, None), (None, 5.0, 1.0)], "k string, v double, w double")
    out = sketches.sketch(df, ["v", "w"], F.col("k"))
    assert [(r.variable, r.vintage, r.n) for r in out.collect()] == [("v", "a", 1)]
    assert sketches.breaks(out, 4) == {"v": (1.0,)} and sketches.breaks(out.limit(0), 4) == {}
