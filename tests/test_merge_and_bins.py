import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.functions.binning import left_bin, position_bin, rank_bin, ranked, right_bin
from creditflow.operators._merge import merge_bins
from creditflow.operators.models import ks
from creditflow.operators.ratings import fit_ratings


def merge(v, b, groups=5, least=0.05, method="ward", vols=None, bads=None):
    none = np.zeros((len(v), 0))
    return merge_bins(v, b, none if vols is None else vols, none if bads is None else bads, groups, least, 1, method).tolist()


@pytest.mark.parametrize("method", ["ward", "distance", "iv"])
def test_merge_shapes(method):
    assert merge([10], [1], method=method) == [1]
    assert set(merge([100] * 4, [10] * 4, method=method)) == {1}
    assert merge([1000] * 3, [10, 50, 200], method=method) == [1, 2, 3]
    assert len(set(merge([100, 0, 100], [1, 0, 30], method=method))) <= 2
    assert merge([5, 1000, 1000], [0, 50, 200], method=method) == [1, 1, 2]


def test_crossing_months_merge():
    vols, bads = np.full((2, 4), 100.0), np.array([[1, 9, 1, 9], [5, 5, 5, 5.5]])
    assert merge(vols.sum(1), bads.sum(1), vols=vols, bads=bads) == [1, 1]


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (400, 500, 600)] + [(None,)], "x double")
    rows = df.select(left_bin(F.col("x"), [500]), right_bin(F.col("x"), [500])).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (1, 0), (1, 1), (1, None)]


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_ranks(spark, partitions):
    df = spark.createDataFrame([(i, 5) for i in range(7)], "id long, v int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = ranked(df, [], "v", "id").orderBy("id").select(position_bin(F.col("rank"), F.col("rank_total"), 5), rank_bin(F.col("rank"), F.col("rank_total"), 5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[0] for r in rows] == [0, 0, 1, 2, 2, 3, 4]
    assert [r[1] for r in rows] == [0, 0, 1, 2, 3, 4, 4]


def test_ks_of_one_class_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "s double, bad int")
    assert ks(df, ["s"], "bad").first()["ks"] == 0.0


def test_fitted_ratings_hold_their_rules(spark):
    rng = np.random.default_rng(5)
    score = rng.integers(300, 900, 5000)
    rows = [(int(s), int(rng.random() < 0.4 - s / 2500), f"2024-0{i % 3 + 1}") for i, s in enumerate(score)]
    df = spark.createDataFrame(rows, "score int, bad int, month string")
    groups = fit_ratings(df, ["score"], "bad", bins=10, min_vol_ratio=0.05, max_crossings=3, time="month").bins.toPandas()
    total = groups.groupby("rating")[["volume", "bads"]].sum()
    assert len(total) <= 5 and (total.volume / total.volume.sum() >= 0.05).all()
    assert (np.diff(total.bads / total.volume) > 0).all()
    with pytest.raises(ValueError):
        fit_ratings(df.withColumn("score", F.lit(1)), ["score"], "bad", bins=10)
    with pytest.raises(ValueError):
        fit_ratings(df, ["score"], "bad", bins=3, max_groups=5)
