"""Top-k search: clustered vectors at two sizes, against all products, with the pairs of nodes that were met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.llm import dual_tree


def clustered(n, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16)) * 400
    return np.floor(centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 16)) * 12)


@pytest.mark.parametrize("n", [600, 2400])
def test_fewer_pairs_than_all(spark, n):
    x = clustered(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("q", F.col("id") % 20 == 0).withColumn("d", F.size("v"))
    found, first, after, total = dual_tree.search_table(df, 5, nodes=12)
    assert 100 < total <= 144 and len(first) + len(after) < total / 2
    got = {}
    for r in found.distinct().collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q in range(0, n, 20):
        scores = x @ x[q]
        want = sorted((-int(scores[i]), i) for i in range(n) if i != q)[:5]
        assert sorted(got[q])[:5] == want


def test_blocks_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "DATA_BLOCK", 70)
    monkeypatch.setattr(dual_tree, "QUERY_BLOCK", 6)
    monkeypatch.setattr(dual_tree, "NODE_ROWS", 150)
    draw = np.random.default_rng(4)
    x = draw.integers(-50, 50, (500, 8))
    x[100:160] = x[7]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<long>")
    rows = dual_tree.top_k(df, F.col("vec_id") % 20 == 0, 4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 500, 20):
        scores = x @ x[q]
        assert got[q] == [(i, -s) for s, i in sorted((-int(scores[i]), i) for i in range(500) if i != q)[:4]]
