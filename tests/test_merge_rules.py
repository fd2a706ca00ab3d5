"""The merges against a plain version that goes by the rules one pair at a time, and rating fits against SQL-free counts."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditflow.jobs.queries import QUERIES
from creditflow.operators import screening
from creditflow.operators._merge import merge_bins
from creditflow.operators.ratings import fit_pairwise, fit_ratings
from creditflow.sources.applicants import applicants

SF = "/root/testdata/sf0.001"


def plain(volume, bads, months, most, least, crossings, method):
    """Groups of bins. months: for each bin a list of (volume, bads)."""
    groups = [([k], float(v), float(b), [tuple(map(float, m)) for m in ms]) for k, (v, b, ms) in enumerate(zip(volume, bads, months, strict=True))]
    all_v, all_b = float(sum(volume)), float(sum(bads))

    def iv(v, b):
        if all_b <= 0 or all_v - all_b <= 0 or b <= 0 or v - b <= 0:
            return 0.0
        x, y = b / all_b, (v - b) / (all_v - all_b)
        return (y - x) * math.log(y / x)

    def cost(left, right):
        _, v1, b1, m1 = left
        _, v2, b2, m2 = right
        p1, p2 = (b1 / v1 if v1 else 0.0), (b2 / v2 if v2 else 0.0)
        crossed = sum(1 for (x, a), (y, b) in zip(m1, m2, strict=True) if x > 0 and y > 0 and a / x >= b / y)
        small = v1 / all_v < least or v2 / all_v < least
        if method == "iv":
            if v1 == 0 or v2 == 0:
                return -1e9
            if p1 >= p2:
                return -1e6
            rates = [(a + b) / (x + y) for (x, a), (y, b) in zip(m1, m2, strict=True) if x + y > 0]
            return iv(v1, b1) + iv(v2, b2) - iv(v1 + v2, b1 + b2) + 0.5 * crossed + 0.2 * (float(np.std(rates)) if rates else 0.0) - (1000 if small else 0)
        gap = (v1 * v2 / (v1 + v2) if method == "ward" and v1 + v2 else 1.0) * (p1 - p2) ** 2
        if v1 == 0 or v2 == 0:
            return gap - 2e9
        if p1 >= p2:
            return gap - 1e9
        if small:
            return gap - 1e6
        return gap - 1e3 if crossed > crossings else gap

    while len(groups) > 1:
        costs = [cost(a, b) for a, b in zip(groups, groups[1:])]
        i = costs.index(min(costs))
        if len(groups) <= most and costs[i] >= (-100 if method == "iv" else 0):
            break
        (k1, v1, b1, m1), (k2, v2, b2, m2) = groups[i : i + 2]
        groups[i : i + 2] = [(k1 + k2, v1 + v2, b1 + b2, [(x + y, a + b) for (x, a), (y, b) in zip(m1, m2, strict=True)])]
    return [g for _, g in sorted((k, g) for g, (ks, *_) in enumerate(groups, 1) for k in ks)]


def merged(volume, bads, months, *rest):
    table = lambda j: np.array([[m[j] for m in ms] for ms in months], dtype=float).reshape(len(months), -1)
    return merge_bins(volume, bads, table(0), table(1), *rest).tolist()


@pytest.mark.parametrize("method", ["ward", "distance", "iv"])
def test_random_bins(method):
    draw = np.random.default_rng(8)
    sizes = set()
    for _ in range(200):
        n, m = int(draw.integers(1, 15)), int(draw.integers(0, 5))
        slope = draw.choice([0.0, 0.02, 0.05])
        if m:
            months = [[(int(v), int(draw.binomial(v, min(0.9, 0.03 + slope * k)))) for v in draw.integers(0, 120, m)] for k in range(n)]
            volume, bads = [sum(x for x, _ in ms) for ms in months], [sum(y for _, y in ms) for ms in months]
        else:
            months, volume = [[]] * n, draw.integers(0, 500, n).tolist()
            bads = [int(draw.binomial(v, min(0.9, 0.03 + slope * k))) for k, v in enumerate(volume)]
        if not sum(volume):
            continue
        args = (int(draw.integers(1, 7)), float(draw.choice([0.0, 0.05, 0.15])), int(draw.integers(0, 3)), method)
        got = merged(volume, bads, months, *args)
        assert got == plain(volume, bads, months, *args)
        sizes.add(max(got))
    assert len(sizes) > 2


def test_equal_months_count_as_crossing():
    months = [[(100, 5), (100, 5)], [(100, 5), (100, 9)]]
    assert merged([200, 200], [10, 14], months, 5, 0.0, 0, "ward") == [1, 1]
    assert merged([200, 200], [10, 14], months, 5, 0.0, 1, "ward") == [1, 2]


def rows_of(spark):
    return applicants(spark, SF).where("actual_default is not null").select("score_4", "score_5", "legacy_score", "income", "age", "vl_negativacao", "actual_default", F.substring("safra", 1, 4).alias("year")).toPandas()


def binned(values, points):
    edges = np.unique(np.round(np.quantile(values, np.linspace(0, 1, points + 1)), 9))
    return np.digitize(values, edges[1:-1])


@pytest.mark.parametrize("method", ["ward", "distance", "iv"])
def test_rating_fit(spark, method):
    rows = rows_of(spark)
    rows = rows[rows.year < "2000"]
    every = applicants(spark, SF).where("substr(safra, 1, 4) < '2000'").select("score_5").toPandas()["score_5"]
    edges = np.unique(np.round(np.quantile(every, np.linspace(0, 1, 21)), 9))
    rows = rows.assign(key=np.digitize(rows.score_5, edges[1:-1]))
    keys, years = sorted(rows.key.unique(), reverse=True), sorted(rows.year.unique())
    part = lambda k, y: rows[(rows.key == k) & (rows.year == y)].actual_default
    months = [[(len(part(k, y)), int(part(k, y).sum())) for y in years] for k in keys]
    volume, bads = [sum(x for x, _ in m) for m in months], [sum(y for _, y in m) for m in months]
    want = {(str(k), v, b, g) for k, v, b, g in zip(keys, volume, bads, plain(volume, bads, months, 5, 0.02, 2, method), strict=True)}
    assert {tuple(r) for r in QUERIES[f"rating_fit_{method}"](spark, SF).collect()} == want


def test_pairwise_fit(spark):
    rows = rows_of(spark)
    full = applicants(spark, SF).select("score_4", "score_5", "legacy_score").toPandas()
    inner = {c: np.unique(np.round(np.quantile(full[c], np.linspace(0, 1, 7)), 9))[1:-1] for c in full}
    want = set()
    for other in ("score_4", "legacy_score"):
        keys = [f"{a}-{b}" for a, b in zip(np.digitize(rows.score_5, inner["score_5"]), np.digitize(rows[other], inner[other]), strict=True)]
        counts = rows.assign(key=keys).groupby("key").actual_default.agg(["count", "sum"]).reset_index()
        counts = counts.assign(pd=counts["sum"] / counts["count"]).sort_values(["pd", "key"])
        groups = plain(counts["count"].tolist(), counts["sum"].tolist(), [[]] * len(counts), 5, 0.02, 1, "ward")
        want |= {(f"score_5_vs_{other}", k, int(v), int(b), g) for k, v, b, g in zip(counts.key, counts["count"], counts["sum"], groups, strict=True)}
    assert {tuple(r) for r in QUERIES["rating_pairwise"](spark, SF).collect()} == want
    with pytest.raises(ValueError):
        fit_pairwise(applicants(spark, SF).withColumn("score_4", F.lit(1)), "score_5", ["score_4"], "actual_default")


def test_pairs_predict_and_report(spark):
    """A fit of pairs before a date: recipes and tables give the same ratings, and periods add up."""
    from creditflow.operators.ratings import rate_by_recipe_table

    df = applicants(spark, SF)
    pairs = fit_pairwise(df, "score_5", ["score_4", "legacy_score"], "actual_default", bins=6, min_vol_ratio=0.02, time="safra", oot_date="1996-01")
    alone = fit_ratings(df, ["score_5", "score_4"], "actual_default", bins=6, min_vol_ratio=0.02, time="safra", oot_date="1996-01")
    assert pairs.recipe("score_4") == alone.recipe
    by_pair = {(r.applicant_id, r.pair): r.rating for r in pairs.predict(df, "applicant_id").collect()}
    for c in ("score_4", "legacy_score"):
        assert {r.applicant_id: r.rating for r in df.select("applicant_id", pairs.recipe(c).predict().alias("rating")).collect()} == {i: g for (i, p), g in by_pair.items() if p == pairs.pair(c)}
    joined = rate_by_recipe_table(df.withColumn("pair", F.lit(pairs.pair("score_4"))), *pairs.tables(), "pair")
    assert {r.applicant_id: r.rating for r in joined.collect()} == {i: g for (i, p), g in by_pair.items() if p == pairs.pair("score_4")}
    rows = pairs.report(df, "actual_default").collect()
    volume = lambda pair, *periods: sum(r.volume for r in rows if r.pair == pair and r.period in periods)
    assert all(volume(pairs.pair(c), "All") == volume(pairs.pair(c), "Train", "OOT") > 0 for c in ("score_4", "legacy_score"))
    for wrong in ({"max_groups": 7}, {"oot_date": "0000"}):
        with pytest.raises(ValueError):
            fit_pairwise(df, "score_5", ["score_4"], "actual_default", **{"bins": 6, "time": "safra", "oot_date": "1996-01", **wrong})


def test_many_cells_merge_quickly():
    draw = np.random.default_rng(8)
    vols = draw.integers(0, 60, (8000, 18))
    bads = np.minimum(vols, draw.integers(0, 20, (8000, 18)))
    order = np.argsort(bads.sum(1) / np.maximum(vols.sum(1), 1), kind="stable")
    began = time.time()
    for method in ("ward", "iv"):
        groups = merge_bins(vols.sum(1)[order], bads.sum(1)[order], vols[order], bads[order], 5, 0.05, 1, method)
        assert len(groups) == 8000 and groups.max() <= 5 and (np.diff(groups) >= 0).all()
    assert time.time() - began < 30


def test_rating_report(spark):
    df = applicants(spark, SF).withColumn("year", F.substring("safra", 1, 4))
    fitted = fit_ratings(df, ["score_5"], "actual_default", bins=20, min_vol_ratio=0.02, time="year", oot_date="2000")
    rows = df.select("score_5", "year", "actual_default").toPandas()
    inner = fitted.recipe.breaks["score_5"][1:-1]
    rows["rating"] = [fitted.recipe.mapping.get(str(k)) for k in np.digitize(rows.score_5, inner)]
    rows["period"] = np.where(rows.year < "2000", "Train", "OOT")
    want = pd.concat([rows, rows.assign(period="All")]).groupby(["period", "rating"]).actual_default.agg(["count", "mean"])
    got = {(r.period, r.rating): (r.volume, r.default_rate) for r in QUERIES["rating_report"](spark, SF).collect()}
    assert got.keys() == set(want.index) and all(got[k][0] == want.loc[k, "count"] and (got[k][0] == 0 or abs(got[k][1] - want.loc[k, "mean"]) < 1e-6) for k in got)


@pytest.mark.parametrize("method", ["ward", "iv"])
def test_subsegments(spark, method):
    rows = rows_of(spark)
    rows["tier"] = np.select([rows.score_5.between(600, 749), rows.score_5.between(750, 899), rows.score_5.between(900, 1000)], [3, 2, 1], 0)
    want = set()
    for c in ("income", "age", "vl_negativacao"):
        for tier in (1, 2, 3):
            own = rows[rows.tier == tier]
            edges = np.unique(np.round(np.quantile(own[c], np.linspace(0, 1, 11)), 9)) if len(own) else []
            if len(own) < 10 or len(edges) < 2:
                continue
            counts = own.assign(bin=np.digitize(own[c], edges[1:-1])).groupby("bin").actual_default.agg(["count", "sum"])
            groups = plain(counts["count"].tolist(), counts["sum"].tolist(), [[]] * len(counts), 3, 0.1, 1, method)
            want |= {(c, tier, int(k), g) for k, g in zip(counts.index, groups, strict=True)}
    from creditflow.jobs.queries import CANDIDATES, RATING, _screen

    df, edges = _screen(spark, SF)
    got = screening.subsegments(screening.bin_counts(df, edges, RATING(), CANDIDATES, "actual_default", "applicant_id"), method)
    assert {tuple(r) for r in got.collect()} == want
