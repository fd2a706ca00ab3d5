"""Running sums by ranges, the skyline and the nearest point against plain versions."""

import random
from itertools import accumulate

import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditflow.functions.order import placed_in_ranges, running
from creditflow.operators import search


@pytest.mark.parametrize("ranges", [2, 32])
def test_running_sums(spark, ranges):
    draw = random.Random(4)
    rows = [(k, v, t, draw.randint(0, 9)) for k in ("a", "b", None) for v in [None, *draw.sample(range(-50, 400), 90)] for t in (0, 1)]
    rows += [("c", 7, t, 1) for t in range(20)]  # one value
    df = spark.createDataFrame(rows, "k string, v int, t int, n int").repartition(5)
    got = {(r.k, r.v, r.t): (r.n_to, r.n_all) for r in running(df, ["k"], ["v", "t"], ["n"], ranges=ranges).collect()}
    before = {(r.k, r.v, r.t): r.n_to for r in running(df, ["k"], ["v", "t"], ["n"], least=True, before=True, ranges=ranges).collect()}
    for k in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        sums = list(accumulate(r[3] for r in own))
        assert [got[r[:3]] for r in own] == [(s, sums[-1]) for s in sums]
        assert [before[r[:3]] for r in own] == [None, *list(accumulate((r[3] for r in own), min))[:-1]]
    assert running(df.limit(0), [], ["v"], ["n"]).count() == 0


def test_sums_do_not_depend_on_the_order_of_arrival(spark):
    def shuffled(batches):
        for pdf in batches:
            v = [1000.0 * i + j for i in pdf["id"] for j in range(1000)]
            random.Random().shuffle(v)
            yield pd.DataFrame({"v": v, "n": 1})

    # a sketch sorts 50,000 values at a time, so fewer in a task are always cut alike
    rows = spark.range(800, numPartitions=4).mapInPandas(shuffled, "v double, n int")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = running(rows, [], ["v"], ["n"]).where("n_to != v + 1 or n_all != 800000").count()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == 0


def test_no_range_holds_much_of_a_continuous_column(spark):
    df = spark.range(60_000).select(F.lit("x").alias("k"), (F.rand(3) * F.rand(4) * 1e6).alias("v"), F.lit(1).alias("n"))
    sizes = [r["count"] for r in placed_in_ranges(df, ["k"], "v", {"all": F.sum("n")}).groupBy("_range").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 60_000 / 32 * 1.5


def test_skyline_and_nearest(spark):
    draw = random.Random(9)
    rows = [(i, draw.randint(0, 200) / 200, draw.randint(0, 60) / 100) for i in range(1, 600)]
    points = spark.createDataFrame(rows, "combination_id int, approval_rate double, default_rate double")
    front = {i for i, a, d in rows if not any(x >= a and y <= d and (x > a or y < d) for _, x, y in rows)}
    assert {r.combination_id for r in search.pareto(points).collect()} == front
    for tolerance in (0.0, 0.02):
        near = sorted((round(abs(a - 0.3333), 9), i) for i, a, _ in rows)
        want = [i for d, i in near if d <= tolerance] or [near[0][1]]
        got = search.equivalent(points, "approval_rate", 0.3333, tolerance).orderBy("position").collect()
        assert [r.combination_id for r in got] == want and [r.position for r in got] == list(range(1, len(want) + 1))
    judged = search.judged(points, 0.2, 0.1)
    met = [(-a, i) for i, a, d in rows if d <= 0.2 and a >= 0.1]
    assert search.best(judged).collect()[0].combination_id == min(met)[1] and search.best(judged).columns == judged.columns
    assert search.best(judged.limit(0)).count() == search.pareto(points.limit(0)).count() == search.equivalent(points.limit(0), "approval_rate", 0.5).count() == 0
