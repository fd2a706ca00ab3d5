"""Bundles, production rules, recipe tables and repeated writes."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from creditflow.functions.expressions import register
from creditflow.operators import bundle, evaluate, production, ratings
from creditflow.operators.policy import Policy, Stress, cutoff_stage, filter_stage, rate_stage, segment_cutoff_stage
from creditflow.sources.tables import write_decisions

ROLES = Policy("id", ("risk", "score"), "approved", "bad", hired="hired")
ONE = ratings.Recipe({"score": (0.0, 300.0, 600.0, 1000.0)}, {"0": 3, "1": 2, "2": 1})
TWO = ratings.Recipe({"score": (0.0, 500.0, 1000.0), "risk": (0.0, 200.0, 700.0, 1000.0)}, {"0-0": 4, "0-1": 3, "1-1": 2, "1-2": 1})
POLICY = ROLES.with_stages(filter_stage("f", "flag = 0"), cutoff_stage("c", {"score": 200}), segment_cutoff_stage("s", "risk", "seg", {"A": 100, "B": 50}), rate_stage("r", 0.9), rate_stage("Take_up", 0.8, ("calibrated", "hired")))
POLICY = POLICY.with_stress(Stress("aggravation", factor=1.2), Stress("quantile", factor=0.3, score="risk", bins=5))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 17 == 0 else (i * 37) % 1000, (i * 53) % 1000, "A" if i % 3 else "B", int(i % 5 > 1), int(i % 4 > 0 and i % 5 > 1), int((i * 37) % 1000 < 300 + i % 90), int(i % 7 == 0)) for i in range(1, 501)]
    return spark.createDataFrame(rows, "id long, score int, risk int, seg string, approved int, hired int, bad int, flag int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("rating", "by_rating"), [(None, False), (ONE, True), (ONE, False), (ratings.Segmented("seg", {"A": TWO, "B": ONE}), True), (ratings.Bands("score", (("A", 500, 1000), ("C", 100, 499))), True)])
def test_a_loaded_bundle_scores_as_the_session_that_fitted_it(spark, table, tmp_path, rating, by_rating):
    fitted = bundle.Bundle.fit(table.where("id <= 300"), POLICY, rating, by_rating, "v1")
    fitted.save(spark, str(tmp_path))
    replace(fitted, version="v2", policy=ROLES).save(spark, str(tmp_path))
    with pytest.raises(ValueError):
        fitted.save(spark, str(tmp_path))
    assert bundle.versions(spark, str(tmp_path)) == ["v1", "v2"] and bundle.load(spark, str(tmp_path)).version == "v2"
    loaded = bundle.load(spark, str(tmp_path), "v1")
    assert (loaded.policy, loaded.rating) == (POLICY, rating)
    new = table.drop("bad")
    for simple in (True, False):
        a, b = fitted.score(new, simple), loaded.score(new, simple)
        assert a.columns == b.columns and rows_of(a) == rows_of(b) and "risk_rating" not in a.columns
    assert loaded.score(new).where("scenario = 'Swap In' and defaulted > 0").count() > 0
    assert loaded.score(new, method="stochastic").count() == 500


def test_a_bundle_on_a_stream(spark, table, tmp_path):
    b = bundle.Bundle.fit(table, POLICY, ratings.Segmented("seg", {"A": TWO, "B": ONE}))
    b.save(spark, str(tmp_path / "bundle"))
    new = table.drop("bad")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    bundle.load(spark, str(tmp_path / "bundle")).score_stream(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(b.score(new))


def test_versions_joined_to_rows(spark, table):
    one, two = (bundle.Bundle.fit(table.where(w), ROLES, version=v) for w, v in (("id <= 250", "a"), ("id > 250", "b")))
    learned = spark.createDataFrame([(b.version, *r) for b in (one, two) for r in bundle.learned_rows(b.fitted)], bundle.LEARNED)
    rows = table.withColumn("v", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("?")), (F.col("id") % 3 + 1).cast("int"))).withColumn("_bins", F.lit(1))
    got = {r.id: r.pd for r in bundle.calibrated_by_version(rows, learned, "v", "score").collect()}
    want = {r.id: (r.a, r.b, None)[r.id % 3] for r in table.select("id", one.fitted.pd.at(F.col("score")).alias("a"), two.fitted.pd.at(F.col("score")).alias("b")).collect()}
    assert got == want and len(set(got.values())) > 5
    with pytest.raises(ValueError):
        bundle.load(spark, "/tmp/there-is-no-such-bundle")


@pytest.mark.parametrize("rating", [None, ONE, TWO, ratings.Segmented("seg", {"A": TWO, "B": TWO}), ratings.Segmented("seg", {"A": ONE, "B": ratings.Bands("score", (("A", 400, 1000),))}), ratings.Bands("score", (("A", 500, 1000), ("C", 100, 499)))])
def test_production_rules_round_trip(spark, table, rating):
    policy = ROLES.with_stages(filter_stage("f", "flag = 0"), cutoff_stage("c", {"score": 200}), cutoff_stage("m", {"risk": 950}, "lte"), rate_stage("r", 0.9, "hired"), rate_stage("n", 0.5, 0.7), rate_stage("p", 1.0, "@half"))
    register("half", lambda df: F.lit(0.5))
    rules = json.loads(json.dumps(production.export_rules(policy, rating)))
    read, again = production.import_rules(rules)
    assert replace(read, hired="hired") == policy
    whole = table.where("score is not null")
    assert rows_of(ratings.rated(whole, again, "g").select("id", "g")) == rows_of(ratings.rated(whole, rating, "g").select("id", "g"))
    clean = production.export_rules(policy, rating, clean=True)
    assert set(clean) == {"funnel_stages"} and [s["type"] for s in clean["funnel_stages"]] == ["filter", "score_cutoff", "score_cutoff"]
    assert [s.kind for s in production.import_rules(json.dumps(clean))[0].stages] == ["filter", "cutoff", "cutoff"]


def test_groups_beyond_the_fifth_are_e_in_bands():
    seven = ratings.Recipe({"score": tuple(float(x) for x in range(0, 900, 100))}, {str(i): 7 - i for i in range(7)})
    bands = production.whole_score_bands(seven)
    assert [(b["rating"], b["min_score"], b["max_score"]) for b in bands] == [("A", 600, 699), ("B", 500, 599), ("C", 400, 499), ("D", 300, 399), ("E", 0, 1000)]


def test_bands_table_has_the_same_letters(spark):
    seven = ratings.Recipe({"score": tuple(float(x) for x in range(0, 900, 100))}, {str(i): 7 - i for i in range(7)})
    got = {(r.rating, int(r.min_score), int(r.max_score)) for r in ratings.bands(spark, {"x": seven}, "score").collect()}
    assert got == {(b["rating"], b["min_score"], b["max_score"]) for b in production.whole_score_bands(seven)}


def test_conditions_become_sql(spark):
    df = spark.createDataFrame([(1, 20, "a & b"), (2, 70, "x"), (3, 40, None)], "id long, `age now` int, s string")
    keep = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert keep(production.sql_condition("(`age now` >= 30) & ~(s == 'x')")) == []
    assert keep(production.sql_condition("(s == 'a & b') | (`age now` == 40)")) == [1, 3]
    tree = {"type": "binary", "op": "&", "left": {"type": "binary", "op": ">", "left": {"type": "column", "name": "age now"}, "right": 30}, "right": {"type": "unary", "op": "~", "expr": {"type": "binary", "op": "==", "left": {"type": "column", "name": "id"}, "right": 3}}}
    assert keep(production.sql_expression(tree)) == [2]
    with pytest.raises(ValueError):
        production.sql_expression({**tree, "op": "; drop"})


def test_older_forms_are_read(spark, table):
    register("flagless", lambda df: F.col("flag") == 0)
    column = lambda c: {"type": "column", "name": c}
    stages = [
        {"type": "filter", "name": "f", "condition": {"type": "callable", "name": "flagless"}},
        {"type": "filter", "name": "g", "condition": {"type": "binary", "op": ">=", "left": column("risk"), "right": 10}},
        {"type": "cutoff", "name": "c", "cutoffs": {"score": 200}},
        {"type": "rate", "name": "r", "base_rate": 0.8, "variable": {"type": "calibrated", "expression": {"type": "binary", "op": "/", "left": column("hired"), "right": column("approved")}}, "calibrate": True},
    ]
    roles = {"applicant_id_col": "id", "score_cols": ["score"], "current_approval_col": "approved", "actual_default_col": "bad", "time_col": None, "calibration_bins": 5, "calibration_base": "keep_in"}
    stress = [{"type": "aggravation", "factor": 1.4, "factor_col": None}, {"type": "monotonic_increase", "score_col": "score", "baseline": 0.3, "factor": 0.2}]
    recipes = {"type": "segmented_recipes", "recipes": {"A": {"score_cols": ["score"], "quantile_breaks": {"score": [0, 300, 600, 1000]}, "cluster_mapping": {"0": 3, "1": 2, "2": 1}, "segment_col": "seg"}, "B": {"score_cols": ["score"], "intervals": [{"rating": "A", "min_score": 500, "max_score": 1000}]}}}
    policy, rating = production.import_rules(json.dumps({"policy": {**roles, "stages": stages, "stress_scenarios": stress}, "rating_recipe": recipes}))
    want = Policy("id", ("score",), "approved", "bad", calibration_bins=5).with_stages(
        filter_stage("f", "flag = 0"), filter_stage("g", "risk >= 10"), cutoff_stage("c", {"score": 200}), rate_stage("r", 0.8, ("calibrated", "hired / approved"), calibrate=True))
    want = want.with_stress(Stress("aggravation", 1.4), Stress("monotonic", 0.2, score="score", baseline=0.3))
    assert rows_of(evaluate.simulate(table, policy)) == rows_of(evaluate.simulate(table, want))
    assert rating == ratings.Segmented("seg", {"A": ONE, "B": ratings.Bands("score", (("A", 500, 1000),))})
    with pytest.raises(ValueError, match="not registered"):
        production.import_rules({"funnel_stages": [{"type": "filter", "name": "x", "expression": "callable:nobody"}]})


def test_plan_of_recipe_tables_does_not_hold_the_cells(spark, table):
    def recipes(n):
        cells = {f"{i}-{j}": 1 + (i + j) % 5 for i in range(n) for j in range(n)}
        breaks = tuple(1000.0 * i / n for i in range(n + 1))
        return {s: ratings.Recipe({"score": breaks, "risk": breaks}, cells) for s in ("A", "B")}

    sizes = []
    for n in (2, 60):
        parts = recipes(n)
        tables = [t.repartition(2) for t in ratings.recipe_tables(spark, parts)]
        rated = ratings.rate_by_recipe_table(table.withColumns({"row": F.lit(1), "key": F.lit("k"), "cell": F.lit("c")}), *tables, "seg")
        sizes.append(len(rated._jdf.queryExecution().optimizedPlan().toString()))
        want = {r.id: r.g for r in table.select("id", ratings.predict_by_segment("seg", parts).alias("g")).collect()}
        assert {r.id: r.rating for r in rated.collect()} == want
        assert ratings.recipes_from_tables(*tables) == parts
    assert sizes[1] < 1.1 * sizes[0]
    none = ratings.rate_by_recipe_table(table.withColumn("seg", F.lit(None).cast("string")), *tables, "seg")
    assert none.where("rating is not null").count() == 0
    all_rows = ratings.rate_by_recipe_table(table, *ratings.recipe_tables(spark, {None: TWO}))
    assert {r.id: r.rating for r in all_rows.collect()} == {r.id: r.g for r in table.select("id", TWO.predict().alias("g")).collect()}


def test_a_month_written_twice(spark, tmp_path):
    path = str(tmp_path / "decisions")
    rows = spark.createDataFrame([(i, f"2024-0{1 + i % 3}") for i in range(30)], "id long, month string")
    write_decisions(rows, path, "month", "first")
    for _ in range(2):
        write_decisions(rows.where("month = '2024-02'"), path, "month", "again")
    got = spark.read.parquet(path)
    assert {(r.month, r.batch_id): r["count"] for r in got.groupBy("month", "batch_id").count().collect()} == {("2024-01", "first"): 10, ("2024-02", "again"): 10, ("2024-03", "first"): 10}
