from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from creditflow.functions.expressions import differs, ratio, register, true
from creditflow.operators import deploy, evaluate
from creditflow.operators.policy import Policy, Stress, cutoff_stage, filter_stage, from_json, rate_stage, segment_cutoff_stage, to_json
from creditflow.operators.search import evaluated, grid, grid_stochastic, outcome, tradeoff, vary
from creditflow.streaming.score import score_stream

ROLES = Policy("id", "score", "approved", "bad")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(f"`{column}`").collect()]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1, 300, 17, 1, 0), (2, 500, 25, 1, 0), (3, 700, 40, 1, 0)], "id long, score int, age int, approved int, bad int")


def test_predicates(spark):
    df = spark.createDataFrame([(1, 17, 400, "A"), (2, 18, 500, "A"), (3, 25, 600, "B"), (4, 60, 700, "C")], "id long, age int, score int, status string")
    adult, high, a = F.col("age") >= 18, F.col("score") > 500, F.col("status") == "A"
    rows = df.orderBy("id").select(adult, adult & high, ~true(a) | (F.col("score") < 500)).collect()
    assert [r[0] for r in rows] == [False, True, True, True]
    assert [r[1] for r in rows] == [False, False, True, True]
    assert [r[2] for r in rows] == [True, False, True, True]


def test_unknown_is_false_and_its_negation_true(spark):
    row = spark.range(1).select(~true(F.lit(None).cast("int") > 5), differs(F.lit(None), F.lit(1)), ratio(F.lit(0), F.lit(0)), ratio(F.lit(5), F.lit(0))).first()
    assert tuple(row) == (True, True, 0.0, 1.0)


def test_filter_forms_agree(spark, tiny):
    register("adult", lambda df: F.col("age") >= 18)
    for condition in ("age >= 18", lambda df: F.col("age") >= 18, "@adult"):
        assert values(tiny.withColumn("x", filter_stage("f", condition).passes(tiny)), "x") == [0.0, 1.0, 1.0]


def test_end_to_end(tiny):
    policy = ROLES.with_stages(cutoff_stage("c", {"score": 400}), filter_stage("adult", "age >= 18"), rate_stage("r", 1.0))
    assert values(evaluate.simulate(tiny, policy), "new_approval") == [0.0, 1.0, 1.0]


def test_replaced_cutoff(tiny):
    policy = vary(ROLES.with_stages(cutoff_stage("c", {"score": 600})), "cutoff:score", 400)
    assert sum(values(evaluate.simulate(tiny, policy), "new_approval")) / 3 == pytest.approx(2 / 3)


def test_keep_in_bypass(spark):
    df = spark.createDataFrame([(1, 800, 1, 1, 0), (2, 750, 1, 0, 0), (3, 600, 0, 0, 0)], "id long, score int, approved int, hired int, bad int")
    policy = ROLES.with_stages(rate_stage("Anti-fraude", 0.85), rate_stage("Conversao", 1.0, ("calibrated", "hired / approved"), calibrate=True))
    for method in ("analytical", "stochastic"):
        sim = evaluate.simulate(df, policy, method)
        assert values(sim, "stage_0_Anti-fraude")[:2] == [1, 1]
        assert values(sim, "stage_1_Conversao")[:2] == [1, 0]
        assert values(sim, "new_approval")[:2] == [1, 0]


def test_stress_factor_column(spark):
    df = spark.createDataFrame([(0.1, 1.5), (0.2, 2.0), (0.3, 1.0)], "p double, f double")
    got = [round(r[0], 9) for r in df.select(Stress("aggravation", factor=9.0, column="f").apply(df, "p")).collect()]
    assert got == [0.15, 0.4, 0.3]
    fixed = df.drop("f")
    assert [round(r[0], 9) for r in fixed.select(Stress("aggravation", factor=5.0, column="f").apply(fixed, "p")).collect()] == [0.5, 1.0, 1.0]


def test_all_or_nobody_approved(spark, tiny):
    assert set(values(evaluate.simulate(tiny, ROLES), "scenario")) == {"keep_in"}
    sim = evaluate.simulate(tiny.withColumn("approved", F.lit(0)), ROLES.with_stages(cutoff_stage("c", {"score": 400})))
    assert set(values(sim, "scenario")) == {"swap_in", "keep_out"}


def test_reason_uses_the_running_product(tiny):
    df = tiny.withColumn("approved", F.lit(0))
    policy = ROLES.with_stages(rate_stage("r", 0.3), filter_stage("adult", "age >= 18"))
    assert values(evaluate.decisions(evaluate.simulate(df, policy), policy), "reason") == ["2: adult"] * 3


def test_calibration_needs_fifty(spark):
    rows = [(i, 10 * i, 1, int(i % 5 == 0)) for i in range(1, 51)] + [(100, 1, 0, None)]
    df = spark.createDataFrame(rows, "id long, score int, approved int, bad int")
    assert len(evaluate.fit(df, ROLES).pd.means) == 10
    assert evaluate.fit(df.where("id <> 7"), ROLES).pd.means == ()


def test_json_round_trip(tiny):
    policy = ROLES.with_stages(cutoff_stage("c", {"score": 400}), filter_stage("adult", "age >= 18"), rate_stage("r", 0.5)).with_stress(Stress("aggravation", factor=2.0))
    back, bands = from_json(to_json(policy, [{"rating": "A", "min": 900, "max": 1000}]))
    assert (back, len(bands)) == (policy, 1)
    assert len(from_json(to_json(policy, clean=True))[0].stages) == 2


def test_missing_columns(tiny):
    with pytest.raises(ValueError, match="nope"):
        evaluate.simulate(tiny, replace(ROLES, score_cols=("nope",)))


def test_scoring_without_labels_and_on_a_stream(spark, tiny, tmp_path):
    policy = ROLES.with_stages(cutoff_stage("c", {"score": 400}))
    fitted = evaluate.fit(tiny, policy)
    new = tiny.select("id", "score", "age")
    batch = deploy.score(new, policy, fitted)
    assert batch.columns == ["id", "score", "age", "decision", "reason", "hired", "defaulted", "scenario", "rating"][: len(batch.columns)]
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, policy, fitted, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")), "decision") == values(batch, "decision") == ["Rejected", "Approved", "Approved"]


@pytest.fixture(scope="module")
def applicants(spark):
    """400 rows, one score in eleven missing, with a segment, a risk column and a stress factor."""
    rows = [(i, None if i % 11 == 0 else (i * 37) % 1000, (i * 53) % 1000, "A" if i % 3 else "B", 1 + i % 4 / 2, int(i % 5 > 1), int((i * 37) % 1000 < 300 + i % 90), 0 if i % 7 else 1) for i in range(1, 401)]
    return spark.createDataFrame(rows, "id long, score int, risk int, seg string, factor double, approved int, bad int, flag int")


SEGMENT = segment_cutoff_stage("by segment", "risk", "seg", {"A": 300, "B": 600})
POLICIES = {
    "factor column": ROLES.with_stress(Stress("aggravation", factor=9.0, column="factor")),
    "monotonic": ROLES.with_stress(Stress("monotonic", factor=0.8, score="risk", baseline=0.9)),
    "worst of several": ROLES.with_stress(Stress("aggravation", factor=0.5), Stress("aggravation", factor=2.0), Stress("monotonic", factor=0.4, score="risk", baseline=0.3)),
    "quantile": ROLES.with_stress(Stress("quantile", factor=0.6, score="risk", bins=4), Stress("aggravation", factor=1.1)),
    "quantile of the varied score": ROLES.with_stress(Stress("quantile", factor=0.4, score="score", bins=7)),
    "ten bins asked for": replace(ROLES.with_stages(filter_stage("f", "id % 9 = 0")), calibration_bins=10),
    "custom": ROLES.with_stress(Stress("custom", fn=lambda df, pd: F.col(pd) + F.col("flag") * 0.3)),
    "segment": ROLES.with_stages(filter_stage("f", "flag = 0"), SEGMENT),
    "base": replace(ROLES.with_stages(filter_stage("f", "risk > 400")), calibration_base="global"),
    "edges": replace(ROLES, calibration_bins=(200.0, 400.0, 600.0)),
    "other cutoff": ROLES.with_stages(cutoff_stage("r", {"risk": 700}, "lte")),
    "plain": ROLES.with_stages(filter_stage("f", "flag = 0")),
}


@pytest.mark.parametrize("name", sorted(POLICIES))
def test_tradeoff_is_the_simulation(name, applicants):
    policy = POLICIES[name]
    for row in tradeoff(applicants, policy, {"cutoff:score": [150.0, 400.0]}).collect():
        sim = evaluate.simulate(applicants, vary(policy, "cutoff:score", row["cutoff_score"]))
        assert (row["approval_rate"], row["default_rate"]) == pytest.approx(tuple(sim.agg(*outcome(sim)).first()), abs=1e-12)


def test_tradeoff_of_several_cutoffs_and_factors(applicants):
    """Cutoffs of one stage and of two directions, values in any order, with a factor, a rate and sets that take nobody in."""
    policy = ROLES.with_stages(filter_stage("f", "flag = 0"), cutoff_stage("c", {"score": 1, "risk": 1}), cutoff_stage("top", {"factor": 3}, "lte"), rate_stage("r", 0.5))
    for base, some in (("keep_in", slice(0, 32, 9)), ("global", slice(3, 4))):
        own = replace(policy, calibration_bins=4, calibration_base=base)
        grid_ = {"cutoff:score": [400.0, 150.0], "aggravation": [1.0, 1.7], "cutoff:risk": [300.0, 5000.0], "cutoff:factor": [1.5, 3.0], "base_rate:r": [0.2, 0.4]}
        rows = tradeoff(applicants, own, grid_).orderBy("combination_id").collect()
        assert [r.combination_id for r in rows] == list(range(1, 33)) and [r.cutoff_score for r in rows[:17]] == [400.0] * 16 + [150.0]
        for r in rows[some]:
            one = own
            for name in grid_:
                one = vary(one, name, r[name.replace(":", "_")])
            sim = evaluate.simulate(applicants, one)
            assert (r.approval_rate, r.default_rate) == pytest.approx(tuple(sim.agg(*outcome(sim)).first()), abs=1e-12)


def test_grids_keep_cutoffs_by_segment(applicants):
    policy = ROLES.with_stages(SEGMENT, cutoff_stage("c", {"score": 900}))
    passed = applicants.where("score >= 400 and risk >= if(seg = 'A', 300, 600)").count() / 400
    assert grid(evaluated(applicants, policy), {"score": [400.0]}).first()["approval_rate"] == pytest.approx(passed)
    kept = applicants.where("score >= 900 and risk >= if(seg = 'A', 300, 600)").count() / 400  # the policy's own cutoff stays
    assert grid_stochastic(applicants, policy, {"score": [400.0]}).first()["approval_rate"] == pytest.approx(kept)


def test_calibrate_flag_averages_expressions_only(spark):
    rows = [(i, 10 * i, 1, i % 3 % 2, int(i % 5 == 0)) for i in range(1, 61)] + [(100 + i, 10 * i, 0, None, None) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "id long, score int, approved int, hired int, bad int")
    wrapped = evaluate.fit(df, ROLES.with_stages(rate_stage("r", 1.0, ("calibrated", "hired / approved"))))
    for variable in (F.col("hired") / F.col("approved"), "hired / approved"):
        assert evaluate.fit(df, ROLES.with_stages(rate_stage("r", 1.0, variable, calibrate=True))).rates == wrapped.rates != {}
        assert evaluate.fit(df, ROLES.with_stages(rate_stage("r", 1.0, variable))).rates == {}
    for variable in ("hired", 0.5, lambda d: F.col("hired") * 1.0):
        assert evaluate.fit(df, ROLES.with_stages(rate_stage("r", 1.0, variable, calibrate=True))).rates == {}


def test_saved_rules_and_recipes(spark, tmp_path):
    from creditflow.operators.policy import STRESSES, load_text, save_text
    from creditflow.operators.ratings import Recipe

    STRESSES["half"] = lambda df, pd: F.col(pd) * 0.5
    policy = ROLES.with_stages(segment_cutoff_stage("s", "score", "seg", {"A": 1.5}), rate_stage("r", 0.5, "age / 100", calibrate=True)).with_stress(Stress("custom", fn="@half"), Stress("monotonic", factor=2.0, score="score"))
    save_text(spark, to_json(policy), str(tmp_path / "rules"))
    assert from_json(load_text(spark, str(tmp_path / "rules")))[0] == policy
    with pytest.raises(TypeError):
        to_json(ROLES.with_stress(Stress("custom", fn=lambda df, pd: F.col(pd))))
    recipe = Recipe({"a": (1.0, 2.0, 3.0), "b": (0.0, 9.0)}, {"0-0": 2, "1-0": 1})
    assert Recipe.from_json(recipe.to_json()) == recipe
    df = spark.createDataFrame([(0.4,), (None,)], "p double")
    assert [r[0] for r in df.select(policy.stresses[0].apply(df, "p")).collect()] == [0.2, None]


def test_search_arguments(spark, tiny):
    from creditflow.operators.search import cutoff_ranges, judged

    for wrong in (lambda: cutoff_ranges(tiny, ["score"], 0), lambda: cutoff_ranges(tiny, []), lambda: cutoff_ranges(tiny, ["nope"]), lambda: cutoff_ranges(tiny.limit(0), ["score"]),
                  lambda: cutoff_ranges(tiny.withColumn("score", F.lit(None).cast("int")), ["score"]), lambda: judged(tiny, 1.5), lambda: judged(tiny, 0.5, -0.1)):
        with pytest.raises(ValueError):
            wrong()
    assert cutoff_ranges(tiny, ["score"], 1) == {"score": [500.0]}


def test_one_plan_for_any_grid(applicants):
    """A thousand points take one plan, no larger than that of a single point but for the values themselves."""
    values = [float(x) for x in range(0, 1000, 100)]
    policy = ROLES.with_stress(Stress("aggravation", factor=2.0))
    large, small = (tradeoff(applicants, policy, {"cutoff:score": v, "aggravation": v, "cutoff:risk": v}) for v in (values, values[:1]))
    plan = [df._jdf.queryExecution().optimizedPlan().toString() for df in (large, small)]
    assert large.count() == 1000 and len(plan[0]) < 1.25 * len(plan[1])
    assert plan[0].count("Join Cross") <= 3  # the total, the factors, and no rows


@pytest.mark.parametrize(("stress", "ranges"), [(Stress("aggravation", factor=1.5), 256), (Stress("monotonic", factor=0.7, score="score", baseline=0.8), 3), (Stress("quantile", factor=0.8, score="risk", bins=3), 256)])
def test_stochastic_grid_is_the_simulation(applicants, stress, ranges, monkeypatch):
    from creditflow.operators import search

    monkeypatch.setattr(search, "DRAWS", ranges)
    policy = ROLES.with_stages(filter_stage("f", "flag = 0"), cutoff_stage("c", {"risk": 300}), rate_stage("r", 0.6)).with_stress(stress)
    for row in grid_stochastic(applicants, policy, {"score": [150.0, 400.0, 2000.0]}).collect():
        sim = evaluate.simulate(applicants, replace(policy, stages=(*policy.stages, cutoff_stage("grid", {"score": row["score"]})), calibration_score="risk"), "stochastic")
        took = F.col("new_approval").cast("double")
        want = sim.agg(F.avg(took), F.coalesce(F.try_divide(F.sum(took * F.coalesce("simulated_default", F.lit(0.0))), F.sum(took)), F.lit(0.0))).first()
        assert (row["approval_rate"], row["default_rate"]) == pytest.approx(tuple(want), abs=1e-12)


def test_quantiles_are_interpolated(spark):
    import numpy as np

    from creditflow.functions.binning import equal_width_edges, quantile_edges, quantiles

    draw = np.random.default_rng(2)
    rows = [("a", int(x)) for x in draw.integers(0, 9, 40)] + [("b", int(x)) for x in draw.integers(0, 900, 41)] + [("b", None), ("c", None), ("d", 7)]
    df = spark.createDataFrame(rows, "k string, v int")
    points = [i / 10 for i in range(11)]
    got = {r.k: r.edges for r in quantiles(df, ["k"], "v", points).collect()}
    for k in "abd":
        assert got[k] == pytest.approx(np.quantile([v for n, v in rows if n == k and v is not None], points), abs=1e-9)
    assert set(got) == {"a", "b", "d"} and quantile_edges(df.where("k = 'c'"), ["v"], points) == {"v": []}
    twice = spark.createDataFrame([("a", 1, 3), ("a", 5, 1), ("a", 9, 0)], "k string, v int, n int")
    assert quantiles(twice, ["k"], "v", [0.5, 1.0], "n").first().edges == [1.0, 5.0]
    assert equal_width_edges(5.0, 5.0, 2) == pytest.approx([4.995, 5.0, 5.005]) and equal_width_edges(0.0, 10.0, 2) == pytest.approx([-0.01, 5.0, 10.0])


def test_bins_that_are_asked_for_take_five_keep_ins(spark):
    df = spark.createDataFrame([(i, 10 * i, int(i % 2), int(i > 20)) for i in range(1, 41)], "id long, score int, approved int, bad int")
    assert evaluate.fit(df, ROLES).pd.means == () and evaluate.fit(df, ROLES).pd.inner == ()
    for bins in (10, 4):
        assert len(evaluate.fit(df, replace(ROLES, calibration_bins=bins)).pd.means) == bins
    assert evaluate.fit(df.where("id < 9"), replace(ROLES, calibration_bins=4)).pd.means == ()


def test_quantile_stress_by_its_bins(spark):
    """Equal bins of the swap-ins by score and then id; other rows are placed by the same edges, and a row without a score has no stress."""
    from creditflow.functions.binning import rank_bin, ranked

    rows = [(i, (i * 7) % 5 * 100 if i % 13 else None, 0, 0) for i in range(1, 60)] + [(i, 100, 1, int(i % 2)) for i in range(60, 80)]
    df = spark.createDataFrame(rows, "id long, score int, approved int, bad int")
    policy = ROLES.with_stress(Stress("quantile", factor=0.1, score="score", bins=6))
    fitted = evaluate.fit(df, policy)
    assert len(fitted.stress[0]) == 5
    want = {r.id: r.b for r in ranked(df.where("approved = 0 and score is not null"), [], "score", "id").select("id", rank_bin(F.col("rank"), F.col("rank_total"), 6).alias("b")).collect()}
    got = {r.id: r.simulated_default for r in evaluate.simulate(df, policy, fitted=fitted).where("approved = 0").collect()}
    assert all(got[i] is None if s is None else got[i] == pytest.approx(0.5 * 0.1 * (1 + want[i])) for i, s, _, _ in rows[:59])
    assert evaluate.fit(df.where("approved = 1"), policy).stress == {0: ()}
    assert [len(evaluate.fit(df.where(f"id <= {n}"), policy).stress[0]) for n in (1, 3)] == [5, 5]  # one row may end several bins


def test_columns_named_as_internal_ones_are_kept(tiny):
    sim = evaluate.simulate(tiny.withColumn("_pd", F.lit("mine")), ROLES.with_stages(cutoff_stage("c", {"score": 400})))
    assert values(sim, "_pd") == ["mine"] * 3


def test_columns_of_other_policies_are_left_out(tiny):
    df = tiny.withColumns({"stage_3_old": F.lit(1), "stage_x": F.lit(2), "motivo": F.lit("m")})
    out = evaluate.decisions(evaluate.simulate(df, ROLES.with_stages(cutoff_stage("c", {"score": 400}))), ROLES)
    assert "stage_x" in out.columns and not {"stage_3_old", "motivo", "stage_0_c"} & set(out.columns)


def test_grid_by_a_key_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 0.5), (None, 5, 1.0, 0.0), ("a", 5, 1.0, 1.0)], "k string, s int, _p double, _bad double")
    rows = {(r.k, r.s): (r.approval_rate, r.default_rate) for r in grid(df, {"s": [0.0, 3.0]}, ["k"]).collect()}
    assert rows == {(None, 0.0): (1.0, 0.25), (None, 3.0): (0.5, 0.0), ("a", 0.0): (1.0, 1.0), ("a", 3.0): (1.0, 1.0)}


@pytest.mark.parametrize(("job", "most"), [("grid", 3), ("fit", 2)])
def test_jobs_of_many_branches_read_the_table_few_times(applicants, spark, job, most):
    rows, read = applicants.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = applicants.mapInPandas(counted, applicants.schema)
    policy = ROLES.with_stages(filter_stage("f", "flag = 0"), rate_stage("r", 0.6))
    if job == "grid":  # the fit, the draws and the total
        grid_stochastic(df, policy.with_stress(Stress("aggravation", factor=1.5)), {"score": [150.0, 400.0]}).collect()
    else:  # the histogram and the swap-ins
        evaluate.fit(df, policy.with_stress(Stress("quantile", factor=0.8, score="risk", bins=3)))
    assert 0 < read.value <= most * rows
