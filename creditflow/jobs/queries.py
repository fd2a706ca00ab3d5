"""One query per operator over the test tables, with the DuckDB SQL that has the same rows."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from creditflow.functions import sketches
from creditflow.functions.binning import equal_width_edges, left_bin, position_bin, quantiles, rank_bin, ranked, right_bin
from creditflow.functions.expressions import ratio, true
from creditflow.operators import bundle, deploy, evaluate, models, production, ratings, reports, screening, search
from creditflow.operators.policy import Policy, Stress, cutoff_stage, filter_stage, from_json, load_text, rate_stage, save_text, segment_cutoff_stage, to_json
from creditflow.sources.applicants import SQL as APP
from creditflow.sources.applicants import applicants
from creditflow.sources.tables import read_applications, staged, write_decisions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL (None: rows only)."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = "WITH " + sql.strip()
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


# The policy of most queries: two filters and a cutoff, swap-in PD by score decile.
BASE = Policy("applicant_id", ("score_4", "score_5"), "approved", "actual_default", time="safra", hired="hired").with_stages(
    filter_stage("cpf", "cpf_valido"), filter_stage("negativacao", "vl_negativacao <= 1500"), cutoff_stage("score", {"score_5": 600}))
TAKE_UP = rate_stage("Take_up", 0.9)
FULL = BASE.with_stages(TAKE_UP).with_stress(Stress("aggravation", factor=1.3))
BANDS = [("A", 900, 1000), ("B", 750, 899), ("C", 600, 749)]


def RATING():  # noqa: N802  a column needs a session
    return ratings.predict_by_bands("score_5", BANDS)


def DEV():  # noqa: N802
    return F.col("safra") < "2000-01"


PASS = "(cpf_valido AND vl_negativacao<=1500 AND score_5>=600)"


def scen(new: str) -> str:
    return f"CASE WHEN approved>0 AND {new} THEN 'keep_in' WHEN {new} THEN 'swap_in' WHEN approved>0 THEN 'swap_out' ELSE 'keep_out' END"


def edges_sql(score: str, where: str, name: str = "e") -> str:
    points = ",".join(str(i / 10) for i in range(11))
    return f"{name} AS (SELECT list_sort(list_distinct(list_transform(quantile_cont({score}::DOUBLE, [{points}]), lambda x: round(x, 9))))[2:-2] AS inn FROM q WHERE {where})"


RB = "len(list_filter(inn, lambda x: x < {score}))"
Q = f"{APP}, q AS (SELECT *, {scen(PASS)} AS scenario, CASE WHEN {PASS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pre FROM a)"
DECILE_PD = f"""{Q}, {edges_sql('score_5', "scenario='keep_in'")},
b AS (SELECT q.*, {RB.format(score='score_5')} AS bin FROM q, e),
m AS (SELECT bin, avg(actual_default) AS m FROM b WHERE scenario='keep_in' GROUP BY bin),
k AS (SELECT avg(actual_default) AS k FROM q WHERE scenario='keep_in'),
w AS (SELECT b.*, coalesce(m.m, k.k) AS pd FROM b LEFT JOIN m USING (bin), k)"""
RATE = "CASE WHEN approved=1 THEN hired::DOUBLE ELSE 0.9::DOUBLE END"
SIM = f"""{DECILE_PD}, s AS (SELECT *, pre*{RATE} AS na, CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN least(pd*1.3::DOUBLE, 1.0::DOUBLE) END AS sd,
CASE WHEN score_5 BETWEEN 600 AND 749 THEN 3 WHEN score_5 BETWEEN 750 AND 899 THEN 2 WHEN score_5 BETWEEN 900 AND 1000 THEN 1 END AS rating FROM w)"""
WEIGHTS = f"""{SIM}, v AS (SELECT *, CASE WHEN scenario IN ('keep_in','swap_in') THEN na WHEN scenario='swap_out' THEN hired::DOUBLE ELSE 0 END AS vol,
CASE scenario WHEN 'keep_in' THEN coalesce(actual_default,0)*na WHEN 'swap_in' THEN coalesce(sd,0)*na WHEN 'swap_out' THEN coalesce(actual_default,0)*hired::DOUBLE ELSE 0 END AS bad FROM s)"""
OUT = "round(coalesce(sum(coalesce(sd,0)*pre)/nullif(sum(pre),0),0),6)"


def evaluated_rows(spark, sf):
    """What a policy's evaluation reads of the applicants, written once for jobs that read it several times."""
    return staged(applicants(spark, sf).select("applicant_id", "safra", "cpf_valido", "vl_negativacao", "score_4", "score_5", "approved", "hired", "actual_default"), "applicants")


def base_sim(spark, sf):
    return evaluate.simulate(applicants(spark, sf), FULL)


# --- applicants, stages, funnel -------------------------------------------------


@query(f"{APP} SELECT * FROM a")
def applicant_table(spark, sf):
    return applicants(spark, sf)


@query(f"""{APP}, n AS (SELECT count(*)::DOUBLE AS n0, sum(CASE WHEN cpf_valido THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN cpf_valido AND vl_negativacao<=1500 THEN 1 ELSE 0 END)::DOUBLE AS n2,
sum(CASE WHEN {PASS} THEN 1 ELSE 0 END)::DOUBLE AS n3 FROM a),
r AS (SELECT unnest([0,1,2,3])::INTEGER AS step, unnest(['all','cpf','negativacao','score']) AS stage, unnest([n0,n1,n2,n3]) AS remaining, n0 FROM n)
SELECT step, stage, remaining, round(remaining/n0,6) AS share, remaining-lag(remaining) OVER (ORDER BY step) AS change FROM r""")
def funnel_report(spark, sf):
    return rounded(reports.funnel(evaluate.simulate(applicants(spark, sf), BASE), BASE))


@query(f"{APP} SELECT count(*)::BIGINT AS applicants, sum(approved)::BIGINT AS approved, sum(hired)::BIGINT AS hired, round(avg(actual_default),6) AS bad_rate, round(sum(hired)::DOUBLE/sum(approved),6) AS take_up FROM a")
def legacy_panorama(spark, sf):
    return rounded(reports.legacy_panorama(applicants(spark, sf), BASE))


@query(f"{APP} SELECT applicant_id, CASE WHEN NOT coalesce(CASE WHEN applicant_id%97=0 THEN NULL ELSE score_5 END >= 500, false) OR age>=60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS passed FROM a")
def filter_stage_nulls(spark, sf):
    df = applicants(spark, sf).withColumn("s", F.when(F.col("applicant_id") % 97 != 0, F.col("score_5")))
    return df.select("applicant_id", filter_stage("f", ~true(F.col("s") >= 500) | (F.col("age") >= 60)).passes(df).alias("passed"))


@query(f"{APP} SELECT applicant_id, CASE WHEN score_4>=500 AND score_5>=600 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS at_least, CASE WHEN age<=60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS at_most FROM a")
def cutoff_stage_rows(spark, sf):
    df = applicants(spark, sf)
    return df.select("applicant_id", cutoff_stage("c", {"score_4": 500, "score_5": 600}).passes(df).alias("at_least"), cutoff_stage("m", {"age": 60}, "lte").passes(df).alias("at_most"))


@query(f"{APP} SELECT applicant_id, CASE WHEN score_5 >= CASE region WHEN 'ASIA' THEN 650 WHEN 'EUROPE' THEN 600 WHEN 'AFRICA' THEN 700 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS passed FROM a")
def segment_cutoff(spark, sf):
    df = applicants(spark, sf)
    return df.select("applicant_id", segment_cutoff_stage("r", "score_5", "region", {"ASIA": 650, "EUROPE": 600, "AFRICA": 700}).passes(df).alias("passed"))


@query(f"{APP} SELECT applicant_id, round(greatest(least(0.7::DOUBLE*CASE WHEN income>=2000 THEN 1.0::DOUBLE ELSE 0 END,1),0),6) AS p, round(CASE WHEN vl_protestos=0 AND vl_vencido_scr>0 THEN 1.0::DOUBLE WHEN vl_protestos=0 THEN 0.0::DOUBLE ELSE least(vl_vencido_scr::DOUBLE/vl_protestos,1) END,6) AS r FROM a")
def rate_column(spark, sf):
    df = applicants(spark, sf)
    p = rate_stage("x", 0.7, F.when(F.col("income") >= 2000, 1.0).otherwise(0.0)).rate(df)
    return rounded(df.select("applicant_id", p.alias("p"), ratio(F.col("vl_vencido_scr"), F.col("vl_protestos")).alias("r")))


ANTI = BASE.with_stages(rate_stage("Anti-fraude", 0.85), rate_stage("Conversao", 0.5, calibrate=True))


@query(f"{Q} SELECT applicant_id, round(pre*CASE WHEN approved=1 THEN 1 ELSE 0.85::DOUBLE END,6) AS antifraud, round(pre*CASE WHEN approved=1 THEN hired::DOUBLE ELSE 0.85::DOUBLE*0.5::DOUBLE END,6) AS new_approval FROM q")
def rate_keep_in_bypass(spark, sf):
    return rounded(evaluate.simulate(applicants(spark, sf), ANTI).select("applicant_id", F.col("`stage_3_Anti-fraude`").alias("antifraud"), "new_approval"))


def _uniform(salt: str) -> str:
    return f"(('0x'||substr(md5(concat('{salt}|',applicant_id)),1,8))::UBIGINT::DOUBLE/4294967296.0::DOUBLE)"


STOCHASTIC = f"""{DECILE_PD}, s AS (SELECT *, (pre*CASE WHEN approved=1 THEN hired::DOUBLE WHEN {_uniform('42-3')}<0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)::INTEGER AS na, pre::INTEGER AS pre_i,
CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN CASE WHEN {_uniform('42-default')}<least(pd*1.3::DOUBLE,1.0::DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS sd FROM w)"""


@query(f"{STOCHASTIC} SELECT applicant_id, na AS new_approval, pre_i AS approved_pre_rate, scenario, sd AS simulated_default FROM s")
def stochastic_rate(spark, sf):
    return evaluate.simulate(applicants(spark, sf), FULL, "stochastic").select("applicant_id", "new_approval", "approved_pre_rate", "scenario", "simulated_default")


CALIBRATED = BASE.with_stages(rate_stage("Conversao", 1.0, ("calibrated", lambda df: ratio(F.col("hired"), F.col("approved"))), calibrate=True))


@query(f"""{Q}, {edges_sql('score_5', 'approved=1')}, b AS (SELECT q.*, {RB.format(score='score_5')} AS bin FROM q, e), m AS (SELECT bin, avg(hired::DOUBLE) AS m FROM b WHERE approved=1 GROUP BY bin),
k AS (SELECT avg(hired::DOUBLE) AS k FROM q WHERE approved=1) SELECT applicant_id, round(pre*CASE WHEN approved=1 THEN hired::DOUBLE ELSE coalesce(m, k) END,6) AS new_approval FROM b LEFT JOIN m USING (bin), k""")
def calibrated_rate(spark, sf):
    return rounded(evaluate.simulate(applicants(spark, sf), CALIBRATED).select("applicant_id", "new_approval"))


@query(ORACLE_SQL["calibrated_rate"].removeprefix("WITH "))
def calibrated_flag(spark, sf):
    policy = BASE.with_stages(rate_stage("Conversao", 1.0, ratio(F.col("hired"), F.col("approved")), calibrate=True))
    return rounded(evaluate.simulate(applicants(spark, sf), policy).select("applicant_id", "new_approval"))


# --- quadrants, default rates, stress -------------------------------------------


@query(f"{Q} SELECT scenario, count(*)::BIGINT AS n FROM q GROUP BY scenario")
def quadrants(spark, sf):
    return evaluate.simulate(applicants(spark, sf), BASE).groupBy("scenario").agg(F.count("*").alias("n"))


def _swap_pd(spark, sf, policy, **options):
    sim = evaluate.simulate(evaluated_rows(spark, sf), policy, **options)
    return rounded(sim.where("scenario = 'swap_in'").select("applicant_id", F.col("simulated_default").alias("pd")))


@query(f"{DECILE_PD} SELECT applicant_id, round(pd,6) AS pd FROM w WHERE scenario='swap_in'")
def swap_in_pd_score_bins(spark, sf):
    return _swap_pd(spark, sf, BASE)


CUSTOM = DECILE_PD.replace(edges_sql("score_5", "scenario='keep_in'"), "e AS (SELECT [0,500,750,850,1000] AS inn)")


@query(f"{CUSTOM} SELECT applicant_id, round(pd,6) AS pd FROM w WHERE scenario='swap_in'")
def swap_in_pd_custom_edges(spark, sf):
    return _swap_pd(spark, sf, replace(BASE, calibration_bins=(0, 500, 750, 850, 1000)))


GLOBAL = DECILE_PD.replace(edges_sql("score_5", "scenario='keep_in'"), edges_sql("score_5", "true"))


@query(f"{GLOBAL} SELECT applicant_id, round(pd,6) AS pd FROM w WHERE scenario='swap_in'")
def swap_in_pd_global_base(spark, sf):
    return _swap_pd(spark, sf, replace(BASE, calibration_base="all"))


BY_BAND = "CASE WHEN score_5 BETWEEN 600 AND 749 THEN 3 WHEN score_5 BETWEEN 750 AND 899 THEN 2 WHEN score_5 BETWEEN 900 AND 1000 THEN 1 END"


@query(f"""{Q}, r AS (SELECT *, {BY_BAND} AS rating FROM q), m AS (SELECT rating, avg(actual_default) AS m FROM r WHERE scenario='keep_in' GROUP BY rating), k AS (SELECT avg(actual_default) AS k FROM q WHERE scenario='keep_in')
SELECT applicant_id, round(coalesce(m,k),6) AS pd FROM r LEFT JOIN m USING (rating), k WHERE scenario='swap_in'""")
def swap_in_pd_rating(spark, sf):
    return _swap_pd(spark, sf, BASE, rating=RATING())


def _stressed(expression: str, where: str = "scenario='swap_in'") -> str:
    return f"{DECILE_PD} SELECT applicant_id, round(greatest(least({expression},1.0::DOUBLE),0.0::DOUBLE),6) AS pd FROM w WHERE {where}"


@query(_stressed("pd*1.5::DOUBLE"))
def stress_aggravation(spark, sf):
    return _swap_pd(spark, sf, BASE.with_stress(Stress("aggravation", factor=1.5)))


@query(_stressed("pd*(1+(age%5)::DOUBLE)"))
def stress_factor_col(spark, sf):
    df = applicants(spark, sf).withColumn("factor", 1 + (F.col("age") % 5).cast("double"))
    sim = evaluate.simulate(df, BASE.with_stress(Stress("aggravation", factor=9.0, column="factor")))
    return rounded(sim.where("scenario = 'swap_in'").select("applicant_id", F.col("simulated_default").alias("pd")))


@query(_stressed("0.5::DOUBLE-score_5/1000.0::DOUBLE*0.4::DOUBLE"))
def stress_monotonic(spark, sf):
    return _swap_pd(spark, sf, BASE.with_stress(Stress("monotonic", factor=0.4, score="score_5", baseline=0.5)))


@query(_stressed(f"pd*CASE coalesce({BY_BAND},0) WHEN 1 THEN 1.1::DOUBLE WHEN 2 THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END"))
def stress_by_rating(spark, sf):
    factor = lambda df, pd: F.col(pd) * F.coalesce(F.when(RATING() == 1, 1.1).when(RATING() == 2, 1.5), F.lit(2.0))
    return _swap_pd(spark, sf, BASE.with_stress(Stress("custom", fn=factor)))


@query(f"""{DECILE_PD}, o AS (SELECT *, row_number() OVER (ORDER BY score_5, applicant_id) AS r, count(*) OVER () AS n FROM w WHERE scenario='swap_in')
SELECT applicant_id, round(least(pd*1.2::DOUBLE*(1+greatest(ceil((r-1)*10/greatest(n-1,1)::DOUBLE)-1,0)),1.0::DOUBLE),6) AS pd FROM o""")
def stress_by_decile(spark, sf):
    return _swap_pd(spark, sf, BASE.with_stress(Stress("quantile", factor=1.2, score="score_5")))


NARROW = replace(BASE, stages=(*BASE.stages, filter_stage("few", "applicant_id % 97 = 0")), calibration_bins=4)
_QUARTERS = DECILE_PD.replace(PASS, "(cpf_valido AND vl_negativacao<=1500 AND score_5>=600 AND applicant_id%97=0)").replace(",".join(str(i / 10) for i in range(11)), "0.0,0.25,0.5,0.75,1.0")


@query(f"{_QUARTERS} SELECT applicant_id, round(CASE WHEN (SELECT count(*) FROM q WHERE scenario='keep_in')>=5 THEN pd ELSE (SELECT coalesce(k,0) FROM k) END,6) AS pd FROM w WHERE scenario='swap_in'")
def swap_in_pd_few_keep_ins(spark, sf):
    """Four bins that were asked for are fitted on few keep-ins."""
    return _swap_pd(spark, sf, NARROW)


@query(_stressed("greatest(least(pd*1.5::DOUBLE,1),0.3::DOUBLE-score_5/1000.0::DOUBLE*0.2::DOUBLE)"))
def stress_worst_case(spark, sf):
    return _swap_pd(spark, sf, BASE.with_stress(Stress("aggravation", factor=1.5), Stress("monotonic", factor=0.2, score="score_5", baseline=0.3)))


@query(f"""{SIM} SELECT applicant_id, CASE WHEN pre>=0.5 THEN 'Approved' ELSE 'Rejected' END AS decision,
CASE WHEN NOT cpf_valido THEN '1: cpf' WHEN vl_negativacao>1500 THEN '2: negativacao' WHEN score_5<600 THEN '3: score' ELSE 'Approved' END AS reason, round(na,6) AS hired, round(sd,6) AS defaulted,
CASE scenario WHEN 'keep_in' THEN 'Keep In' WHEN 'swap_in' THEN 'Swap In' WHEN 'swap_out' THEN 'Swap Out' ELSE 'Keep Out' END AS scenario, chr(64+rating) AS rating FROM s""")
def decision_table(spark, sf):
    out = evaluate.decisions(base_sim(spark, sf), FULL, rating=RATING())
    return rounded(out.select("applicant_id", "decision", "reason", "hired", "defaulted", "scenario", "rating"))


@query(f"{SIM} SELECT applicant_id, CASE WHEN pre>=0.5 THEN 'Approved' ELSE 'Rejected' END AS decision, 9 AS stage_count, 9 AS kept FROM s")
def decision_columns(spark, sf):
    """Columns named as results, or as stages of another policy, are not passed through; others are."""
    foreign = ("stage_7_other policy", "quadrant", "motivo", "Rating", "risk_rating", "stage_count", "kept")
    df = applicants(spark, sf).select("applicant_id", "cpf_valido", "vl_negativacao", "score_4", "score_5", "approved", "hired", "actual_default", "safra", *(F.lit(9).alias(c) for c in foreign))
    out = evaluate.decisions(evaluate.simulate(df, FULL), FULL)
    return out.drop("cpf_valido", "vl_negativacao", "score_4", "score_5", "actual_default", "safra", "reason", "hired", "defaulted", "scenario", "rating")


def _folder(spark, name: str) -> str:
    """A new folder in the session's shared one, or in its warehouse."""
    import uuid

    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["decision_table"].removeprefix("WITH "))
def saved_rules(spark, sf):
    """The decision table of rules and a rating recipe that were saved and loaded."""
    rules, recipe = _folder(spark, "rules"), _folder(spark, "recipe")
    save_text(spark, to_json(FULL), rules)
    save_text(spark, ratings.Recipe({"score_5": (0, 600, 750, 900, 1000)}, {"1": 3, "2": 2, "3": 1}).to_json(), recipe)
    policy, rating = from_json(load_text(spark, rules))[0], ratings.Recipe.from_json(load_text(spark, recipe)).predict()
    out = evaluate.decisions(evaluate.simulate(applicants(spark, sf), policy), policy, rating=rating)
    return rounded(out.select("applicant_id", "decision", "reason", "hired", "defaulted", "scenario", "rating"))


@query("a AS (SELECT o_orderkey, CASE WHEN o_orderkey%7<>0 THEN o_totalprice::DOUBLE END AS o_totalprice FROM orders) SELECT * FROM a")
def applications_read(spark, sf):
    """A table with NaN, read with nulls."""
    path = _folder(spark, "applications")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", price.alias("o_totalprice"), F.lit(1).alias("unused")).write.parquet(path)
    return read_applications(spark, path, ["o_orderkey", "o_totalprice"])


@query(f"{SIM} SELECT region, CASE WHEN pre>=0.5 THEN 'Approved' ELSE 'Rejected' END AS decision, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def decisions_written(spark, sf):
    """Decisions written by region and read again."""
    path = _folder(spark, "decisions")
    write_decisions(evaluate.decisions(base_sim(spark, sf), FULL).select("region", "decision"), path, "region")
    return spark.read.parquet(path).groupBy("region", "decision").agg(F.count("*").alias("n"))


@query(f"{SIM} SELECT substr(safra,1,4) AS year, CASE WHEN substr(safra,1,4)='1995' THEN 'second' ELSE 'first' END AS batch_id, CASE WHEN pre>=0.5 THEN 'Approved' ELSE 'Rejected' END AS decision, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def decisions_written_again(spark, sf):
    """One year of the decisions is written twice: its rows are there once, and other years stay."""
    path = _folder(spark, "decisions")
    rows = evaluate.decisions(base_sim(spark, sf), FULL).select(F.substring("safra", 1, 4).alias("year"), "decision")
    write_decisions(rows, path, "year", "first")
    write_decisions(rows.where("year = '1995'"), path, "year", "second")
    return spark.read.parquet(path).groupBy(F.col("year").cast("string").alias("year"), "batch_id", "decision").agg(F.count("*").alias("n"))


STRESSED = BASE.with_stages(rate_stage("Antifraud", 0.9), rate_stage("Take_up", 0.8, ("calibrated", "hired"))).with_stress(Stress("aggravation", factor=1.3), Stress("quantile", factor=0.5, score="score_4", bins=4))
_DEV_EDGES = "e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(score_5::DOUBLE, [" + ",".join(str(i / 10) for i in range(11)) + "]), lambda x: round(x, 9))))[2:-2] AS inn FROM q WHERE scenario='keep_in' AND safra<'1996-01')"
_BUNDLE = f"""{Q}, {_DEV_EDGES}, {_DEV_EDGES.replace("e AS", "t AS", 1).replace("AS inn", "AS tinn").replace("scenario='keep_in'", "approved=1")},
b AS (SELECT q.*, {RB.format(score='score_5')} AS bin, len(list_filter(tinn, lambda x: x < score_5)) AS tbin FROM q, e, t),
m AS (SELECT bin, avg(actual_default) AS m FROM b WHERE scenario='keep_in' AND safra<'1996-01' GROUP BY bin), k AS (SELECT avg(actual_default) AS k, count(*) AS kn FROM q WHERE scenario='keep_in' AND safra<'1996-01'),
tm AS (SELECT tbin, avg(hired::DOUBLE) AS tm FROM b WHERE approved=1 AND safra<'1996-01' GROUP BY tbin), tk AS (SELECT avg(hired::DOUBLE) AS tk FROM q WHERE approved=1 AND safra<'1996-01'),
o AS (SELECT score_4, applicant_id AS id, row_number() OVER (ORDER BY score_4, applicant_id) AS r, count(*) OVER () AS n FROM q WHERE scenario='swap_in' AND safra<'1996-01'),
l AS (SELECT list(struct_pack(s := score_4, i := id)) AS edges FROM o WHERE r IN (floor((n-1)/4.0)+1, floor(2*(n-1)/4.0)+1, floor(3*(n-1)/4.0)+1)),
w AS (SELECT b.*, coalesce(CASE WHEN kn>=50 THEN m END, k, 0) AS pd, coalesce(tm, tk) AS rate, len(list_filter(edges, lambda x: x.s < score_4 OR (x.s = score_4 AND x.i < applicant_id))) AS sbin FROM b LEFT JOIN m USING (bin) LEFT JOIN tm USING (tbin), k, tk, l),
s AS (SELECT *, pre*CASE WHEN approved=1 THEN hired::DOUBLE ELSE 0.9::DOUBLE*least(0.8::DOUBLE*rate,1.0::DOUBLE) END AS na,
CASE scenario WHEN 'keep_in' THEN 0.0::DOUBLE WHEN 'swap_in' THEN greatest(least(pd*1.3::DOUBLE,1.0::DOUBLE), least(pd*0.5::DOUBLE*(1+sbin),1.0::DOUBLE)) END AS sd FROM w)"""


def _dev_bundle(spark, sf):
    """Fitted on the applications of some years, saved, and loaded from its folder."""
    path = _folder(spark, "bundle")
    rating = ratings.Bands("score_5", tuple(BANDS))
    bundle.Bundle.fit(applicants(spark, sf).where("safra < '1996-01'"), STRESSED, rating, version="dev").save(spark, path)
    return path, bundle.load(spark, path, "dev")


@query(f"""{_BUNDLE} SELECT applicant_id, CASE WHEN pre>=0.5 THEN 'Approved' ELSE 'Rejected' END AS decision, round(na,6) AS hired, round(sd,6) AS defaulted, scenario AS new_scenario,
CASE WHEN score_5 BETWEEN 600 AND 749 THEN 'C' WHEN score_5 BETWEEN 750 AND 899 THEN 'B' WHEN score_5 BETWEEN 900 AND 1000 THEN 'A' END AS rating FROM s""")
def scored_from_bundle(spark, sf):
    """All applications without their defaults, by the stored rules, calibrations, stress edges and ratings."""
    out = _dev_bundle(spark, sf)[1].score(applicants(spark, sf).drop("actual_default"))
    return rounded(out.select("applicant_id", "decision", "hired", "defaulted", F.lower(F.replace("scenario", F.lit(" "), F.lit("_"))).alias("new_scenario"), "rating"))


@query(f"{_BUNDLE} SELECT applicant_id, CASE WHEN applicant_id%3=0 THEN NULL ELSE round(pd,6) END AS pd FROM w")
def calibrated_by_version(spark, sf):
    """Each row's default rate by the stored version that it names; unknown versions have none."""
    path, _ = _dev_bundle(spark, sf)
    rows = applicants(spark, sf).select("applicant_id", "score_5", F.when(F.col("applicant_id") % 3 == 0, "other").otherwise("dev").alias("v"))
    learned = spark.read.schema(bundle.LEARNED).parquet(f"{path}/learned")
    return rounded(bundle.calibrated_by_version(rows, learned, "v", "score_5").select("applicant_id", "pd"))


# --- reports --------------------------------------------------------------------

_SUMMARY = """count(*)::BIGINT AS applicants, sum(pre) AS approved, round(sum(na),6) AS hired,
round(CASE WHEN scenario IN ('keep_in','swap_in') THEN coalesce(sum(coalesce(sd,0)*na)/nullif(sum(na),0),0) WHEN scenario='swap_out' THEN coalesce(avg(actual_default),0) END,6) AS bad_rate"""


@query(f"{SIM} SELECT scenario, {_SUMMARY} FROM s GROUP BY scenario")
def summary_analytical(spark, sf):
    return rounded(reports.summary(base_sim(spark, sf), FULL))


@query(f"{SIM} SELECT region, scenario, {_SUMMARY} FROM s GROUP BY region, scenario")
def summary_by_region(spark, sf):
    return rounded(reports.summary(base_sim(spark, sf), FULL, ["region"]))


@query(f"""{STOCHASTIC} SELECT scenario, count(applicant_id)::BIGINT AS applicants, sum(pre_i)::DOUBLE AS approved, sum(na)::DOUBLE AS hired,
round(CASE WHEN scenario='swap_out' THEN avg(actual_default) WHEN scenario<>'keep_out' THEN avg(sd) END,6) AS bad_rate FROM s GROUP BY scenario""")
def summary_stochastic(spark, sf):
    return rounded(reports.summary(evaluate.simulate(applicants(spark, sf), FULL, "stochastic"), FULL, method="stochastic"))


@query(f"""{SIM}, n AS (SELECT avg(pre) AS an, sum(coalesce(sd,0)*pre)/sum(pre) AS bn, avg(approved::DOUBLE) AS ao, sum(coalesce(actual_default,0)*approved)/sum(approved)::DOUBLE AS bo FROM s),
r AS (SELECT unnest(['Approval Rate','Bad Rate']) AS metric, unnest([ao,bo]) AS old, unnest([an,bn]) AS new FROM n)
SELECT metric, round(old,6) AS old, round(new,6) AS new, round(new-old,6) AS delta_abs, round((new-old)/greatest(old,1e-6::DOUBLE),6) AS delta_rel FROM r""")
def compare_policies(spark, sf):
    df = applicants(spark, sf)
    old = evaluate.simulate(df, replace(BASE, stages=(filter_stage("legacy", "approved = 1"),)))
    return rounded(reports.compare(evaluate.simulate(df, FULL), old))


@query(f"{SIM} SELECT round(sum(CASE WHEN scenario='swap_in' THEN pre ELSE 0 END)/sum(CASE WHEN scenario='keep_in' THEN pre ELSE 0 END),6) AS swap_in_ratio FROM s")
def swap_ratio(spark, sf):
    return rounded(reports.swap_ratio(base_sim(spark, sf)))


@query(f"""{SIM}, n AS (SELECT avg((approved>0)::INT::DOUBLE) AS al, avg((pre>0)::INT::DOUBLE) AS an, sum(CASE WHEN hired=1 THEN coalesce(actual_default,0) END)::DOUBLE/sum(hired) AS dl,
sum(coalesce(sd,0)*na)/sum(na) AS dn, sum(hired)::DOUBLE AS vl, sum(na) AS vn FROM s), r AS (SELECT unnest(['approval','default_rate','hired']) AS metric, unnest([al,dl,vl]) AS legacy, unnest([an,dn,vn]) AS new FROM n)
SELECT metric, round(legacy,6) AS legacy, round(new,6) AS new, round(new-legacy,6) AS delta FROM r""")
def delta_table(spark, sf):
    return rounded(reports.delta_table(base_sim(spark, sf), FULL))


@query(f"{WEIGHTS} SELECT scenario, round(sum(vol),6) AS volume, round(CASE WHEN scenario<>'keep_out' THEN coalesce(sum(bad)/nullif(sum(vol),0),0) END,6) AS default_rate FROM v GROUP BY scenario")
def quadrant_summary(spark, sf):
    return rounded(reports.quadrant_summary(base_sim(spark, sf), FULL))


@query(f"""{SIM}, g AS (SELECT rating, sum(na) AS volume, coalesce(sum(coalesce(sd,0)*na)/nullif(sum(na),0),0) AS stressed_rate FROM s WHERE scenario='swap_in' GROUP BY rating)
SELECT rating, round(volume,6) AS volume, round(stressed_rate,6) AS stressed_rate, round(volume/sum(volume) OVER (),6) AS share FROM g""")
def swap_in_by_rating(spark, sf):
    return rounded(reports.swap_in_by_rating(base_sim(spark, sf), RATING()))


@query(f"""{WEIGHTS} SELECT rating, scenario, sum(CASE WHEN scenario='swap_out' THEN approved::DOUBLE ELSE pre END) AS approved_volume, round(sum(vol),6) AS hired_volume,
round(CASE WHEN scenario<>'keep_out' THEN coalesce(sum(bad)/nullif(sum(vol),0),0) END,6) AS bad_rate FROM v GROUP BY rating, scenario""")
def rating_quadrant(spark, sf):
    return rounded(reports.rating_quadrant(base_sim(spark, sf), FULL, RATING()))


@query(f"{SIM} SELECT safra, rating, round(avg(actual_default),6) AS default_rate FROM s WHERE na>0 GROUP BY safra, rating")
def vintage_stability(spark, sf):
    return rounded(reports.vintage(base_sim(spark, sf), FULL, RATING()))


@query(f"{SIM} SELECT region, round(avg(pre),6) AS approval_rate, {OUT} AS weighted_pd FROM s GROUP BY region")
def segment_outcome(spark, sf):
    return rounded(reports.segment_outcome(base_sim(spark, sf), "region"))


@query(f"""{APP} SELECT {BY_BAND} AS rating, sum(CASE WHEN safra<'2000-01' THEN 1 ELSE 0 END)::BIGINT AS n_dev, sum(CASE WHEN safra<'2000-01' THEN 0 ELSE 1 END)::BIGINT AS n_oot,
round(avg(CASE WHEN safra<'2000-01' THEN actual_default END),6) AS bad_dev, round(avg(CASE WHEN safra>='2000-01' THEN actual_default END),6) AS bad_oot FROM a GROUP BY 1""")
def dev_oot_validation(spark, sf):
    return rounded(reports.dev_oot(applicants(spark, sf), RATING(), DEV(), "actual_default"))


@query(f"""{SIM} SELECT rating, {', '.join(f"round(coalesce(sum(na) FILTER (region='{r}'),0),6) AS {r.replace(' ', '_')}" for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))} FROM s WHERE scenario='swap_in' GROUP BY rating""")
def swap_in_rating_region(spark, sf):
    return rounded(reports.swap_in_matrix(base_sim(spark, sf), RATING(), "region", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]))


@query(f"""{SIM}, o AS (SELECT *, row_number() OVER (ORDER BY score_5, applicant_id) AS r, count(*) OVER () AS n FROM s WHERE actual_default IS NOT NULL)
SELECT rating, count(*)::BIGINT AS volume, round(avg(actual_default),6) AS default_rate, round(avg(actual_default*1.2::DOUBLE*greatest(ceil((r-1)*10/greatest(n-1,1)::DOUBLE)-1,0)),6) AS stressed_rate FROM o GROUP BY rating""")
def rating_summary_stressed(spark, sf):
    rows = ranked(applicants(spark, sf).where("actual_default is not null").withColumn("rating", RATING()), [], "score_5", "applicant_id")
    d = F.col("actual_default").cast("double")
    return rounded(rows.groupBy("rating").agg(F.count("*").alias("volume"), F.avg(d).alias("default_rate"), F.avg(d * 1.2 * rank_bin(F.col("rank"), F.col("rank_total"), 10)).alias("stressed_rate")))


@query(f"{APP} SELECT {BY_BAND} AS rating, min(score_5) AS min_score, max(score_5) AS max_score, sum(CASE WHEN safra<'2000-01' THEN 1 ELSE 0 END)::BIGINT AS n_dev, sum(CASE WHEN safra<'2000-01' THEN 0 ELSE 1 END)::BIGINT AS n_oot FROM a GROUP BY 1")
def rating_ranges(spark, sf):
    return reports.rating_ranges(applicants(spark, sf), "score_5", RATING(), DEV())


@query(f"{APP} SELECT count(DISTINCT safra)::BIGINT AS safra_values, count(DISTINCT region)::BIGINT AS region_values, count(DISTINCT score_5)::BIGINT AS score_5_values FROM a")
def cardinality(spark, sf):
    return reports.cardinality(applicants(spark, sf), ["safra", "region", "score_5"])


# --- score power ----------------------------------------------------------------

SCORES = ["legacy_score", "score_4", "score_5"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS score_name, {c}::DOUBLE AS score, actual_default AS d FROM a WHERE actual_default IS NOT NULL" for c in SCORES)
KS = f"""{APP}, l AS ({_LONG}), g AS (SELECT score_name, score, sum(d)::DOUBLE AS b, sum(1-d)::DOUBLE AS g FROM l GROUP BY ALL),
c AS (SELECT score_name, abs(sum(b) OVER w/sum(b) OVER (PARTITION BY score_name)-sum(g) OVER w/sum(g) OVER (PARTITION BY score_name)) AS gap FROM g WINDOW w AS (PARTITION BY score_name ORDER BY score DESC)),
k AS (SELECT score_name, max(gap) AS ks FROM c GROUP BY score_name)"""


@query(f"{KS} SELECT score_name, round(ks,6) AS ks FROM k")
def ks(spark, sf):
    return rounded(models.ks(applicants(spark, sf), SCORES, "actual_default"))


@query(f"""{APP}, q AS (SELECT * FROM a WHERE actual_default IS NOT NULL), {edges_sql('score_5', 'true')}, b AS (SELECT {RB.format(score='score_5')} AS bin, count(*)::BIGINT AS volume, sum(actual_default)::DOUBLE AS bads, avg(score_5) AS mean_score FROM q, e GROUP BY 1)
SELECT row_number() OVER w::INTEGER AS bucket, volume, bads, round(mean_score,6) AS mean_score, round(sum(bads) OVER w/sum(bads) OVER (),6) AS cum_bad, round(sum(volume-bads) OVER w/sum(volume-bads) OVER (),6) AS cum_good,
round(abs(sum(bads) OVER w/sum(bads) OVER ()-sum(volume-bads) OVER w/sum(volume-bads) OVER ()),6) AS ks FROM b WINDOW w AS (ORDER BY bin DESC)""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER"))
def ks_table(spark, sf):
    return rounded(models.ks_table(applicants(spark, sf), "score_5", "actual_default"))


@query(f"{KS} SELECT score_name, round(ks,6) AS ks, CASE WHEN ks<0.2 THEN 'weak' WHEN ks<0.3 THEN 'fair' WHEN ks<0.45 THEN 'good' ELSE 'strong' END AS strength, (row_number() OVER (ORDER BY round(ks,9) DESC, score_name))::INTEGER AS position FROM k")
def model_ranking(spark, sf):
    return rounded(models.model_ranking(applicants(spark, sf), SCORES, "actual_default"))


@query(f"""{APP}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS challenger, {c} AS v, applicant_id, actual_default AS d FROM a WHERE score_5>=600 AND actual_default IS NOT NULL" for c in ('legacy_score', 'score_4'))}),
o AS (SELECT *, row_number() OVER (PARTITION BY challenger ORDER BY v, applicant_id) AS r, count(*) OVER (PARTITION BY challenger) AS n FROM l),
g AS (SELECT challenger, greatest(ceil((r-1)*10/greatest(n-1,1)::DOUBLE)-1,0) AS bin, avg(d) AS rate FROM o GROUP BY 1,2) SELECT challenger, round(max(rate)-min(rate),6) AS amplitude FROM g GROUP BY challenger""")
def challenger_amplitude(spark, sf):
    rows = applicants(spark, sf).where("score_5 >= 600 and actual_default is not null")
    return rounded(models.amplitude(rows, ["legacy_score", "score_4"], "actual_default", "applicant_id"))


@query(f"""{APP} SELECT sum((score_5>=600)::INT)::BIGINT AS passed_first, round(1-avg((score_5>=600)::INT),6) AS calls_saved, round(avg(CASE WHEN score_5>=600 THEN actual_default END),6) AS bad_before,
round(avg(CASE WHEN score_5>=600 AND score_4>=650 THEN actual_default END),6) AS bad_after FROM a""")
def sequential_cutoff(spark, sf):
    return rounded(models.sequential(applicants(spark, sf), F.col("score_5") >= 600, F.col("score_4") >= 650, "actual_default"))


@query(f"{APP}, e AS (SELECT min(score_5)::DOUBLE AS lo, max(score_5)::DOUBLE AS hi FROM a) SELECT applicant_id, len(list_filter([lo+(hi-lo)*i/10.0::DOUBLE for i in range(1,10)], lambda x: x < score_5))::INTEGER AS bin FROM a, e")
def equal_width_bins(spark, sf):
    df = applicants(spark, sf)
    low, high = df.agg(F.min("score_5").cast("double"), F.max("score_5").cast("double")).first()
    return df.select("applicant_id", right_bin(F.col("score_5"), equal_width_edges(low, high, 10)[1:-1]).cast("int").alias("bin"))


@query(f"{APP}, q AS (SELECT actual_default AS d FROM a WHERE actual_default IS NOT NULL) SELECT 1 AS bucket, count(*)::BIGINT AS volume, sum(d)::DOUBLE AS bads, 500.0::DOUBLE AS mean_score, 1.0::DOUBLE AS cum_bad, 1.0::DOUBLE AS cum_good, 0.0::DOUBLE AS ks FROM q")
def ks_table_constant(spark, sf):
    """A score of one value: bins of equal width, of which one has rows."""
    return rounded(models.ks_table(applicants(spark, sf).withColumn("constant", F.lit(500.0)), "constant", "actual_default"))


@query(f"{APP}, q AS (SELECT * FROM a), {edges_sql('score_5', 'true')} SELECT applicant_id, {RB.format(score='score_5')}::INTEGER AS decile FROM q, e")
def value_deciles(spark, sf):
    from creditflow.functions.binning import quantile_edges, unique

    df = applicants(spark, sf)
    inner = unique(quantile_edges(df, ["score_5"], [i / 10 for i in range(11)])["score_5"])[1:-1]
    return df.select("applicant_id", right_bin(F.col("score_5"), inner).cast("int").alias("decile"))


@query(f"{APP}, o AS (SELECT applicant_id, row_number() OVER (ORDER BY score_5, applicant_id) AS r, count(*) OVER () AS n FROM a) SELECT applicant_id, greatest(ceil((r-1)*10/greatest(n-1,1)::DOUBLE)-1,0)::INTEGER AS decile, floor((r-1)*7/n::DOUBLE)::INTEGER AS part FROM o")
def rank_deciles(spark, sf):
    rows = ranked(applicants(spark, sf).select("applicant_id", "score_5"), [], "score_5", "applicant_id", id_buckets=4)
    return rows.select("applicant_id", rank_bin(F.col("rank"), F.col("rank_total"), 10).alias("decile"), position_bin(F.col("rank"), F.col("rank_total"), 7).alias("part"))


# --- ratings --------------------------------------------------------------------

ONE = ratings.Recipe({"score_5": (750, 800, 900, 1000)}, {"0": 3, "1": 2, "2": 1})
TWO = ratings.Recipe({"score_5": (500, 800, 1000), "score_4": (500, 750, 1000)}, {"0-0": 2, "1-1": 1})
OTHER = ratings.Recipe({"score_5": (750, 820, 910, 1000)}, {"0": 3, "1": 2, "2": 1})


@query(f"{APP} SELECT applicant_id, CASE WHEN s IS NULL THEN 2 ELSE (s>=800)::INT+(s>=900)::INT END AS bin FROM (SELECT applicant_id, CASE WHEN applicant_id%97=0 THEN NULL ELSE score_5 END AS s FROM a)")
def rating_bins(spark, sf):
    s = F.when(F.col("applicant_id") % 97 != 0, F.col("score_5"))
    return applicants(spark, sf).select("applicant_id", left_bin(s, [800, 900]).alias("bin"))


_KEY = "((score_5>=800)::INT)||'-'||((score_4>=750)::INT)"


@query(f"{APP} SELECT {_KEY} AS key, count(*)::BIGINT AS volume, sum(actual_default)::BIGINT AS bads FROM a WHERE actual_default IS NOT NULL GROUP BY 1")
def rating_microbins(spark, sf):
    return ratings.micro_bins(applicants(spark, sf), TWO, "actual_default")


@query(f"{APP} SELECT {_KEY} AS key, substr(safra,1,4) AS month, count(*)::BIGINT AS volume, sum(actual_default)::BIGINT AS bads FROM a WHERE actual_default IS NOT NULL GROUP BY 1,2")
def rating_bin_months(spark, sf):
    return ratings.micro_bins(applicants(spark, sf).withColumn("year", F.substring("safra", 1, 4)), TWO, "actual_default", "year")


def _fit(spark, sf, method):
    df = applicants(spark, sf).withColumn("year", F.substring("safra", 1, 4))
    return ratings.fit_ratings(df, ["score_5"], "actual_default", bins=20, max_groups=5, min_vol_ratio=0.02, max_crossings=2, time="year", method=method, oot_date="2000").bins


@query()
def rating_fit_ward(spark, sf):
    return _fit(spark, sf, "ward")


@query()
def rating_fit_distance(spark, sf):
    return _fit(spark, sf, "distance")


@query()
def rating_fit_iv(spark, sf):
    return _fit(spark, sf, "iv")


@query()
def rating_pairwise(spark, sf):
    return ratings.fit_pairwise(applicants(spark, sf), "score_5", ["score_4", "legacy_score"], "actual_default", bins=6, min_vol_ratio=0.02).bins


@query()
def rating_report(spark, sf):
    df = applicants(spark, sf).withColumn("year", F.substring("safra", 1, 4))
    fitted = ratings.fit_ratings(df, ["score_5"], "actual_default", bins=20, min_vol_ratio=0.02, time="year", oot_date="2000")
    return rounded(fitted.report(df, "actual_default"))


@query(f"""{APP}, r AS (SELECT 3-((score_5>=800)::INT+(score_5>=900)::INT) AS rating, actual_default AS d, CASE WHEN applicant_id%5=0 THEN NULL ELSE safra<'1996-01' END AS train FROM a),
p AS (SELECT 'All' AS period, rating, d FROM r UNION ALL SELECT CASE WHEN train THEN 'Train' ELSE 'OOT' END, rating, d FROM r WHERE train IS NOT NULL)
SELECT period, rating, count(d)::BIGINT AS volume, round(avg(d),6) AS default_rate FROM p GROUP BY period, rating""")
def rating_report_periods(spark, sf):
    """Rows of no month count in the summary over all rows only."""
    df = applicants(spark, sf).withColumn("safra", F.when(F.col("applicant_id") % 5 != 0, F.col("safra")))
    return rounded(ratings.FittedRatings(ONE, None, "safra", "1996-01").report(df, "actual_default"))


@query(f"""{APP}, q3 AS (SELECT list_transform(quantile_cont(score_5::DOUBLE, [0.0, 0.5, 1.0]), lambda x: round(x, 9)) AS e5, list_transform(quantile_cont(score_4::DOUBLE, [0.0, 0.5, 1.0]), lambda x: round(x, 9)) AS e4,
list_transform(quantile_cont(legacy_score::DOUBLE, [0.0, 0.5, 1.0]), lambda x: round(x, 9)) AS el FROM a WHERE safra<'1996-01'),
k AS (SELECT 'score_5_vs_score_4' AS pair, (score_5>=e5[2])::INT||'-'||(score_4>=e4[2])::INT AS key, * FROM a, q3 UNION ALL SELECT 'score_5_vs_legacy_score', (score_5>=e5[2])::INT||'-'||(legacy_score>=el[2])::INT, * FROM a, q3),
c AS (SELECT pair, key, count(*)::BIGINT AS volume, sum(actual_default)::BIGINT AS bads FROM k WHERE safra<'1996-01' AND actual_default IS NOT NULL GROUP BY ALL),
g AS (SELECT pair, key, 1 AS rating FROM c),
p AS (SELECT k.pair, 'All' AS period, rating, actual_default AS d FROM k JOIN g USING (pair, key) UNION ALL SELECT k.pair, CASE WHEN safra<'1996-01' THEN 'Train' ELSE 'OOT' END, rating, actual_default FROM k JOIN g USING (pair, key))
SELECT pair, period, rating::INTEGER AS rating, count(d)::BIGINT AS volume, round(avg(d),6) AS default_rate FROM p GROUP BY ALL""")
def rating_pairwise_report(spark, sf):
    """Pairs fitted before a date, reported by period; one group each, as the SQL has no merge."""
    df = applicants(spark, sf)
    pairs = ratings.fit_pairwise(df, "score_5", ["score_4", "legacy_score"], "actual_default", bins=2, max_groups=1, time="safra", oot_date="1996-01")
    return rounded(pairs.report(df, "actual_default"))


@query(f"{APP} SELECT applicant_id, 3-((score_5>=800)::INT+(score_5>=900)::INT) AS rating, CASE {_KEY} WHEN '0-0' THEN 2 WHEN '1-1' THEN 1 END AS rating_two FROM a")
def rating_predict_breaks(spark, sf):
    return applicants(spark, sf).select("applicant_id", ONE.predict().alias("rating"), TWO.predict().alias("rating_two"))


@query(f"{APP} SELECT applicant_id, {BY_BAND} AS rating FROM a")
def rating_predict_intervals(spark, sf):
    return applicants(spark, sf).select("applicant_id", RATING().alias("rating"))


@query(f"""{APP} SELECT applicant_id, CASE region WHEN 'ASIA' THEN 3-((score_5>=800)::INT+(score_5>=900)::INT) WHEN 'EUROPE' THEN 3-((score_5>=820)::INT+(score_5>=910)::INT) END AS by_breaks,
CASE region WHEN 'ASIA' THEN CASE WHEN score_5 BETWEEN 700 AND 1000 THEN 1 WHEN score_5 BETWEEN 400 AND 699 THEN 2 END WHEN 'EUROPE' THEN CASE WHEN score_5 BETWEEN 600 AND 1000 THEN 1 END END AS by_bands FROM a""")
def rating_predict_segmented(spark, sf):
    df = applicants(spark, sf).withColumn("by_breaks", ratings.predict_by_segment("region", {"ASIA": ONE, "EUROPE": OTHER}))
    table = spark.createDataFrame([("ASIA", 1, 700, 1000), ("ASIA", 2, 400, 699), ("EUROPE", 1, 600, 1000)], "segment string, rating int, min_score int, max_score int")
    return ratings.rate_by_band_table(df, "score_5", table, "region").select("applicant_id", "by_breaks", F.col("rating").alias("by_bands"))


@query(f"{APP}, g AS (SELECT 3-((score_5>=800)::INT+(score_5>=900)::INT) AS rating, avg(actual_default) AS rate FROM a GROUP BY 1) SELECT rating, chr((64+row_number() OVER (ORDER BY rate, rating))::INTEGER) AS label, round(rate,6) AS rate FROM g")
def rating_relabel(spark, sf):
    return rounded(ratings.relabel(applicants(spark, sf), ONE.predict(), "actual_default"))


@query(f"""{APP}, e AS (SELECT region AS segment, list_sort(list_distinct(list_transform(quantile_cont(score_5::DOUBLE, [0.0, 0.5, 0.8, 1.0]), lambda x: round(x, 9)))) AS b FROM a GROUP BY region),
s AS (SELECT segment, v::DOUBLE AS v, 3-((v>=b[2])::INT+(v>=b[3])::INT) AS r FROM e, range(0,1001) t(v)) SELECT segment, chr(64+r) AS rating, min(v) AS min_score, max(v) AS max_score FROM s GROUP BY segment, r""")
def rating_bands(spark, sf):
    """Score bands by region, of recipes whose breaks are that region's quantiles."""
    rows = quantiles(applicants(spark, sf), ["region"], "score_5", [0.0, 0.5, 0.8, 1.0]).collect()
    recipes = {r["region"]: ratings.Recipe({"score_5": tuple(r["edges"])}, {"0": 3, "1": 2, "2": 1}) for r in rows}
    return ratings.bands(spark, recipes, "score_5")


@query(f"""{APP}, e AS (SELECT list_transform(quantile_cont(score_5::DOUBLE, [0.0, 0.5, 1.0]), lambda x: round(x, 9)) AS x, list_transform(quantile_cont(score_4::DOUBLE, [0.0, 0.5, 1.0]), lambda x: round(x, 9)) AS y FROM a),
c AS (SELECT (score_5>=x[2])::INT AS i, (score_4>=y[2])::INT AS j, avg(actual_default) AS pd FROM a, e WHERE actual_default IS NOT NULL GROUP BY 1,2)
SELECT i||'-'||j AS key, i AS bin_score_5, j AS bin_score_4, chr((64+row_number() OVER (ORDER BY pd, i||'-'||j))::INTEGER) AS rating FROM c""")
def rating_matrix(spark, sf):
    """Cells of a two-score recipe, rated by their default rate."""
    df = applicants(spark, sf)
    recipe = ratings.Recipe(ratings.breaks_of(df, ["score_5", "score_4"], 2), {})
    cells = ratings.micro_bins(df, recipe, "actual_default").orderBy(F.col("bads") / F.col("volume"), "key").collect()
    return ratings.matrix(spark, replace(recipe, mapping={r["key"]: i for i, r in enumerate(cells, 1)}))


REGIONS = {"ASIA": 0, "EUROPE": 50, "AFRICA": 100}


def _cells(shift: int):
    """A recipe of two scores for a region: 20 by 20 bins, rated 1 to 5 from high to low."""
    breaks = tuple(float(x) for x in range(shift, 1001 + shift, 50))
    return ratings.Recipe({"score_5": breaks, "score_4": breaks}, {f"{i}-{j}": 5 - min(4, (i + j) // 8) for i in range(20) for j in range(20) if (i + j) % 7})


def _bin_sql(score: str) -> str:
    return f"greatest(least(floor(({score}-shift)/50.0),19),0)::INTEGER"


@query(f"""{APP}, r AS (SELECT *, CASE region {' '.join(f"WHEN '{k}' THEN {v}" for k, v in REGIONS.items())} END AS shift FROM a), b AS (SELECT *, {_bin_sql('score_5')} AS i, {_bin_sql('score_4')} AS j FROM r)
SELECT applicant_id, CASE WHEN shift IS NOT NULL AND (i+j)%7<>0 THEN 5-least(4,(i+j)//8) END::INTEGER AS rating, CASE WHEN {PASS} THEN 'Approved' ELSE 'Rejected' END AS decision FROM b""")
def segmented_matrix_scored(spark, sf):
    """Cells of two scores by region, exported as production rules, imported, and joined as tables."""
    rules = _folder(spark, "production")
    policy = replace(BASE, stages=(filter_stage("cpf", "cpf_valido"), filter_stage("negativacao", "(vl_negativacao <= 1500)"), BASE.stages[2]))
    save_text(spark, json.dumps(production.export_rules(policy, ratings.Segmented("region", {k: _cells(v) for k, v in REGIONS.items()}))), rules)
    policy, rating = production.import_rules(load_text(spark, rules))
    rows = ratings.rated(applicants(spark, sf), rating, "rating")
    return evaluate.simulate(rows, policy, fitted=evaluate.Fitted()).select("applicant_id", "rating", F.when(F.col("approved_pre_rate") > 0, "Approved").otherwise("Rejected").alias("decision"))


@query(f"{APP} SELECT applicant_id, CASE WHEN {BY_BAND} IS DISTINCT FROM 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS passed FROM a")
def exclude_riskiest(spark, sf):
    df = applicants(spark, sf)
    return df.select("applicant_id", filter_stage("not C", ratings.not_rating(RATING(), 3)).passes(df).alias("passed"))


_SKETCHED = ("score_5", "income")


@query(f"{APP}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, {c}::DOUBLE AS v FROM a WHERE {c} IS NOT NULL AND substr(safra,1,4) BETWEEN '1994' AND '1996'" for c in _SKETCHED)}) SELECT variable, count(*)::BIGINT AS n, unnest([0.0,0.1,0.5,0.9,1.0]::DOUBLE[]) AS point, true AS within FROM l GROUP BY variable")
def sketched_quantiles(spark, sf):
    """Quantiles of three years from kept sketches by year: whether the exact rank of each lies within the stated error."""
    df, path = applicants(spark, sf).withColumn("year", F.substring("safra", 1, 4)), _folder(spark, "sketches")
    sketches.keep(sketches.sketch(df, list(_SKETCHED), F.col("year")), path)
    points = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = sketches.quantiles(sketches.kept(spark, path).where("vintage between '1994' and '1996'"), points)
    edges = found.select("variable", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("point"), F.col("edges").alias("edge"))).alias("e")).select("variable", "n", "e.*")
    rows = models.unpivoted(df.where("year between '1994' and '1996'"), list(_SKETCHED), [], "variable", "value").where("value is not null")
    ranks = rows.join(F.broadcast(edges), "variable").groupBy("variable", "n", "point", "edge")  # ten edges
    shares = ranks.agg(F.avg((F.col("value") < F.col("edge")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("edge")).cast("double")).alias("up_to"))
    error = sketches.rank_error()
    return shares.select("variable", "n", "point", ((F.col("below") - error <= F.col("point")) & (F.col("point") <= F.col("up_to") + error)).alias("within"))


# --- screening ------------------------------------------------------------------

CANDIDATES = ["income", "age", "vl_negativacao"]
_TIERS = f"""{APP}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, {BY_BAND} AS tier, applicant_id, {c}::DOUBLE AS v, actual_default AS d FROM a WHERE actual_default IS NOT NULL" for c in CANDIDATES)}), t AS (SELECT * FROM l WHERE tier IS NOT NULL),
e AS (SELECT variable, tier, list_sort(list_distinct(list_transform(quantile_cont(v, [{','.join(str(i / 10) for i in range(11))}]), lambda x: round(x, 9)))) AS edges, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT * FROM e WHERE n>=10 AND len(edges)>=2)"""


def _screen(spark, sf):
    df = applicants(spark, sf)
    return df, screening.boundaries(df, RATING(), CANDIDATES, "actual_default", "applicant_id")


@query(f"{_TIERS} SELECT variable, tier, len(edges)::INTEGER AS n_edges, round(edges[1],6) AS low, round(edges[-1],6) AS high, round(list_sum(edges),6) AS total FROM f")
def tier_boundaries(spark, sf):
    edges = _screen(spark, sf)[1]
    total = F.aggregate("edges", F.lit(0.0), lambda a, x: a + x)
    return rounded(edges.select("variable", "tier", F.size("edges").alias("n_edges"), F.element_at("edges", 1).alias("low"), F.element_at("edges", -1).alias("high"), total.alias("total")))


@query(f"""{_TIERS}, o AS (SELECT *, row_number() OVER (PARTITION BY variable, tier ORDER BY v, applicant_id) AS r, count(*) OVER (PARTITION BY variable, tier) AS n FROM t),
g AS (SELECT variable, tier, floor((r-1)*10/n::DOUBLE) AS bin, count(*)::DOUBLE AS n, sum(d)::DOUBLE AS b FROM o GROUP BY 1,2,3),
h AS (SELECT *, (b+0.5)/(sum(b) OVER w+1.0) AS sb, (n-b+0.5)/(sum(n-b) OVER w+1.0) AS sg FROM g WINDOW w AS (PARTITION BY variable, tier))
SELECT variable, tier, round(sum((sb-sg)*ln(sb/sg)),6) AS iv, round(min(b/n),6) AS pd_min, round(max(b/n),6) AS pd_max, round(max(b/n)-min(b/n),6) AS pd_spread, sum(n)::BIGINT AS tier_vol FROM h GROUP BY variable, tier""")
def tier_metrics(spark, sf):
    return rounded(screening.tier_metrics(applicants(spark, sf), RATING(), CANDIDATES, "actual_default", "applicant_id"))


_BINS = f"{_TIERS}, c AS (SELECT variable, tier, len(list_filter(edges[2:-2], lambda x: x <= v))::INTEGER AS bin, count(*)::BIGINT AS volume, sum(d)::BIGINT AS bads FROM t JOIN f USING (variable, tier) GROUP BY ALL), u AS (SELECT *, (dense_rank() OVER (PARTITION BY variable, tier ORDER BY bin))::INTEGER AS subsegment FROM c)"


@query(f"{_BINS} SELECT variable, tier, bin, subsegment FROM u")
def tier_subsegments(spark, sf):
    df, edges = _screen(spark, sf)
    return screening.subsegments(screening.bin_counts(df, edges, RATING(), CANDIDATES, "actual_default", "applicant_id"))


@query()
def tier_subsegments_ward(spark, sf):
    df, edges = _screen(spark, sf)
    return screening.subsegments(screening.bin_counts(df, edges, RATING(), CANDIDATES, "actual_default", "applicant_id"), "ward")


@query(f"""{_BINS}, z AS (SELECT applicant_id, income, {BY_BAND} AS tier FROM a), y AS (SELECT z.applicant_id, z.tier, len(list_filter(edges[2:-2], lambda x: x <= income))::INTEGER AS bin, edges FROM z LEFT JOIN (SELECT * FROM f WHERE variable='income') ff USING (tier))
SELECT applicant_id, CASE WHEN y.tier IS NOT NULL THEN coalesce(subsegment,1) END::INTEGER AS subsegment FROM y LEFT JOIN (SELECT * FROM u WHERE variable='income') uu ON uu.tier=y.tier AND uu.bin=y.bin""")
def tier_predict(spark, sf):
    df, edges = _screen(spark, sf)
    groups = screening.subsegments(screening.bin_counts(df, edges, RATING(), CANDIDATES, "actual_default", "applicant_id"))
    return screening.predict(df, "income", RATING(), edges, groups).select("applicant_id", "subsegment")


@query(ORACLE_SQL["tier_predict"].removeprefix("WITH "))
def tier_recipe_saved(spark, sf):
    """Sub-segments by a screening recipe that was written and read again."""
    df, edges = _screen(spark, sf)
    groups = screening.subsegments(screening.bin_counts(df, edges, RATING(), CANDIDATES, "actual_default", "applicant_id"))
    path = _folder(spark, "screening")
    screening.recipe_table(edges, groups).write.parquet(path)
    edges, groups = screening.from_recipe_table(spark.read.parquet(path))
    return screening.predict(df, "income", RATING(), edges, groups).select("applicant_id", "subsegment")


# --- search ---------------------------------------------------------------------

CUTS = {"score_4": [400.0, 500.0, 600.0, 700.0], "score_5": [450.0, 550.0, 650.0, 750.0, 850.0]}
OPEN = "(cpf_valido AND vl_negativacao<=1500)"
_FREE = DECILE_PD.replace(PASS, OPEN)
_POINTS = f"""{_FREE}, s AS (SELECT *, CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN pd END AS sd FROM w),
p AS (SELECT (row_number() OVER (ORDER BY x, y))::INTEGER AS combination_id, x, y FROM unnest({CUTS['score_4']}::DOUBLE[]) t(x), unnest({CUTS['score_5']}::DOUBLE[]) v(y)),
g AS (SELECT combination_id, x AS score_4, y AS score_5, sum(CASE WHEN s.score_4>=x AND s.score_5>=y THEN pre ELSE 0 END)/count(*) AS approval_rate,
coalesce(sum(CASE WHEN s.score_4>=x AND s.score_5>=y THEN pre*coalesce(sd,actual_default,0) ELSE 0 END)/nullif(sum(CASE WHEN s.score_4>=x AND s.score_5>=y THEN pre ELSE 0 END),0),0) AS default_rate FROM s, p GROUP BY ALL),
j AS (SELECT *, round(default_rate,9)<=0.04 AND round(approval_rate,9)>=0.0 AS constraints_met, approval_rate-5*default_rate AS tradeoff_score FROM g)"""
_POINT = "combination_id, score_4, score_5, round(approval_rate,6) AS approval_rate, round(default_rate,6) AS default_rate"


def _points(spark, sf):
    return search.grid(search.evaluated(applicants(spark, sf), BASE), CUTS)



@query(f"""{APP}, r AS (SELECT floor(quantile_cont(score_4::DOUBLE,0.05)) AS a4, ceil(quantile_cont(score_4::DOUBLE,0.95)) AS b4, floor(quantile_cont(score_5::DOUBLE,0.05)) AS a5, ceil(quantile_cont(score_5::DOUBLE,0.95)) AS b5 FROM a),
s AS (SELECT 'score_4' AS score, i, a4+(b4-a4)*i/9 AS cutoff FROM r, range(0,10) t(i) UNION ALL SELECT 'score_5', i, a5+(b5-a5)*i/9 FROM r, range(0,10) t(i)) SELECT score, i::INTEGER AS step, round(cutoff,6) AS cutoff FROM s""")
def cutoff_ranges(spark, sf):
    found = search.cutoff_ranges(applicants(spark, sf), ["score_4", "score_5"], 10)
    return rounded(spark.createDataFrame([(c, i, float(x)) for c, v in found.items() for i, x in enumerate(v)], "score string, step int, cutoff double"))


@query(f"{_POINTS} SELECT {_POINT} FROM g")
def grid_analytical(spark, sf):
    return rounded(_points(spark, sf))


@query(f"""{Q}, p AS (SELECT (row_number() OVER (ORDER BY x, y))::INTEGER AS combination_id, x, y FROM unnest({CUTS['score_4']}::DOUBLE[]) t(x), unnest({CUTS['score_5']}::DOUBLE[]) v(y)),
h AS (SELECT p.*, q.* FROM q JOIN p ON pre>0 AND score_4>=x AND score_5>=y),
e AS (SELECT combination_id, list_sort(list_distinct(list_transform(quantile_cont(score_5::DOUBLE, [{','.join(str(i / 10) for i in range(11))}]), lambda x: round(x, 9))))[2:-2] AS inn, count(*) AS k, avg(actual_default) AS mean FROM h WHERE approved>0 GROUP BY 1),
b AS (SELECT h.*, k, mean, {RB.format(score='score_5')} AS bin FROM h LEFT JOIN e USING (combination_id)), m AS (SELECT combination_id, bin, avg(actual_default) AS m FROM b WHERE approved>0 GROUP BY ALL),
w AS (SELECT b.*, coalesce(CASE WHEN k>=50 THEN m END, mean, 0) AS pd FROM b LEFT JOIN m USING (combination_id, bin)),
s AS (SELECT combination_id, CASE WHEN approved=1 THEN hired WHEN {_uniform('42-3')}<0.9::DOUBLE THEN 1 ELSE 0 END AS took, CASE WHEN approved>0 THEN coalesce(actual_default,0)::DOUBLE WHEN {_uniform('42-default')}<least(pd*1.3::DOUBLE,1.0::DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM w)
SELECT p.combination_id, x AS score_4, y AS score_5, round(coalesce(sum(took),0)::DOUBLE/(SELECT count(*) FROM q),6) AS approval_rate, round(coalesce(sum(took*d)/nullif(sum(took),0),0),6) AS default_rate FROM p LEFT JOIN s USING (combination_id) GROUP BY p.combination_id, x, y""")
def grid_stochastic(spark, sf):
    return rounded(search.grid_stochastic(evaluated_rows(spark, sf), FULL, CUTS))


@query(f"{_POINTS} SELECT {_POINT}, constraints_met, round(tradeoff_score,6) AS tradeoff_score FROM j ORDER BY constraints_met DESC, round(CASE WHEN constraints_met THEN approval_rate ELSE tradeoff_score END,9) DESC, combination_id LIMIT 1")
def grid_best(spark, sf):
    return rounded(search.best(search.judged(_points(spark, sf), 0.04)))


@query(f"""{_POINTS} SELECT {_POINT} FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE round(o.approval_rate,9)>=round(g.approval_rate,9) AND round(o.default_rate,9)<=round(g.default_rate,9)
AND (round(o.approval_rate,9)>round(g.approval_rate,9) OR round(o.default_rate,9)<round(g.default_rate,9)))""")
def pareto_frontier(spark, sf):
    return rounded(search.pareto(_points(spark, sf)))


@query(f"""{_POINTS}, d AS (SELECT *, round(abs(approval_rate-0.2),9) AS diff, row_number() OVER (ORDER BY round(abs(approval_rate-0.2),9), combination_id) AS r FROM g)
SELECT {_POINT}, round(diff,6) AS diff, r::INTEGER AS position FROM d WHERE diff<=0.05 OR r=1""")
def find_equivalent(spark, sf):
    return rounded(search.equivalent(_points(spark, sf), "approval_rate", 0.2, 0.05))


def _tradeoff_sql(points: list[tuple[dict[str, float], str, str]], chain: str = DECILE_PD) -> str:
    """A chain of full evaluations: the values, the conditions and the stressed default rate of each point."""
    parts = []
    for i, (values, passes, stressed) in enumerate(points, 1):
        shown = ", ".join(f"{v}::DOUBLE AS {k}" for k, v in values.items())
        own = chain.replace(APP + ", ", "").replace(PASS, passes)
        parts.append(f"SELECT * FROM (WITH {own} SELECT {i} AS combination_id, {shown}, round(avg(pre),6) AS approval_rate, round(coalesce(sum(pre*coalesce(CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN {stressed} END,0))/nullif(sum(pre),0),0),6) AS default_rate FROM w)")
    return f"{APP} " + " UNION ALL ".join(parts)


def _at(cut: int) -> str:
    return PASS.replace("600", str(cut))


THREE = [500.0, 650.0, 800.0]


@query(_tradeoff_sql([({"cutoff_score_5": v}, _at(int(v)), "pd") for v in THREE]))
def tradeoff_cutoff(spark, sf):
    return rounded(search.tradeoff(applicants(spark, sf), BASE, {"cutoff:score_5": THREE}))


@query(_tradeoff_sql([({"base_rate_Take_up": v}, PASS, "least(pd*1.3::DOUBLE,1)") for v in (0.5, 0.8)]))
def tradeoff_base_rate(spark, sf):
    return rounded(search.tradeoff(applicants(spark, sf), FULL, {"base_rate:Take_up": [0.5, 0.8]}))


@query(_tradeoff_sql([({"cutoff_score_5": c, "aggravation": f}, _at(int(c)), f"least(pd*{f}::DOUBLE,1)") for c in (500.0, 700.0) for f in (1.0, 1.5)]))
def tradeoff_grid(spark, sf):
    return rounded(search.tradeoff(applicants(spark, sf), FULL, {"cutoff:score_5": [500.0, 700.0], "aggravation": [1.0, 1.5]}))


@query(_tradeoff_sql([({"cutoff_score_5": v}, _at(int(v)), "greatest(least(0.5::DOUBLE-score_4/1000.0::DOUBLE*0.4::DOUBLE,1),0)") for v in THREE]))
def tradeoff_monotonic(spark, sf):
    return rounded(search.tradeoff(applicants(spark, sf), BASE.with_stress(Stress("monotonic", factor=0.4, score="score_4", baseline=0.5)), {"cutoff:score_5": THREE}))


@query(_tradeoff_sql([({"cutoff_score_5": v}, _at(int(v)), "pd") for v in THREE], CUSTOM))
def tradeoff_given_edges(spark, sf):
    return rounded(search.tradeoff(applicants(spark, sf), replace(BASE, calibration_bins=(0, 500, 750, 850, 1000)), {"cutoff:score_5": THREE}))


@query(_tradeoff_sql([({"cutoff_score_5": v}, f"({_at(int(v))} AND score_4>=CASE region WHEN 'ASIA' THEN 500 WHEN 'EUROPE' THEN 450 WHEN 'AMERICA' THEN 400 END)", "pd") for v in THREE]))
def tradeoff_segment(spark, sf):
    policy = replace(BASE.with_stages(segment_cutoff_stage("region", "score_4", "region", {"ASIA": 500, "EUROPE": 450, "AMERICA": 400})), calibration_score="score_5")
    return rounded(search.tradeoff(applicants(spark, sf), policy, {"cutoff:score_5": THREE}))


FACTORS = [1 + 0.25 * i for i in range(37)]
_CRASH = f"""{DECILE_PD}, f AS (SELECT (1+0.25*i)::DOUBLE AS factor FROM range(0,37) t(i)),
c AS (SELECT factor, sum(pre*coalesce(CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN least(pd*factor,1) END,0))/sum(pre) AS default_rate FROM w, f GROUP BY factor)"""


@query(f"{_CRASH} SELECT factor, round(default_rate,6) AS default_rate FROM c")
def crash_test(spark, sf):
    return rounded(search.crash_test(applicants(spark, sf), BASE, FACTORS))


@query(f"{_CRASH} SELECT min(CASE WHEN round(default_rate,9)>=0.06 THEN factor END) AS breakeven_factor FROM c")
def breakeven(spark, sf):
    return search.breakeven(search.crash_test(applicants(spark, sf), BASE, FACTORS), 0.06)


_REGION_CUTS = [400.0 + 4 * i for i in range(150)]


@query(f"""{_FREE}, s AS (SELECT *, CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN pd END AS sd FROM w), p AS (SELECT (i+1)::INTEGER AS combination_id, (400+4*i)::DOUBLE AS x FROM range(0,150) t(i)),
g AS (SELECT region, combination_id, x AS score_5, sum(CASE WHEN score_5>=x THEN pre ELSE 0 END)/count(*) AS approval_rate,
coalesce(sum(CASE WHEN s.score_5>=x THEN pre*coalesce(sd,actual_default,0) ELSE 0 END)/nullif(sum(CASE WHEN s.score_5>=x THEN pre ELSE 0 END),0),0) AS default_rate FROM s, p GROUP BY region, combination_id, x),
j AS (SELECT *, round(default_rate,9)<=0.04 AND round(approval_rate,9)>=0 AS constraints_met, approval_rate-5*default_rate AS tradeoff_score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY constraints_met DESC, round(CASE WHEN constraints_met THEN approval_rate ELSE tradeoff_score END,9) DESC, combination_id) AS r FROM j)
SELECT region, combination_id, score_5, round(approval_rate,6) AS approval_rate, round(default_rate,6) AS default_rate, constraints_met, round(tradeoff_score,6) AS tradeoff_score FROM r WHERE r=1""".replace("sum(CASE WHEN score_5>=x", "sum(CASE WHEN s.score_5>=x"))
def regional_flat_pd(spark, sf):
    rows = search.evaluated(applicants(spark, sf), BASE)
    return rounded(search.best(search.judged(search.grid(rows, {"score_5": _REGION_CUTS}, ["region"]), 0.04), ["region"]))


_MODEL_CUTS = [300.0 + 20 * i for i in range(35)]
_FRONT = f"""{_FREE}, s AS (SELECT *, CASE scenario WHEN 'keep_in' THEN actual_default::DOUBLE WHEN 'swap_in' THEN pd END AS sd FROM w), p AS (SELECT (i+1)::INTEGER AS combination_id, (300+20*i)::DOUBLE AS x FROM range(0,35) t(i)),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS model, {c} AS v, pre, coalesce(sd,actual_default,0) AS d FROM s" for c in SCORES)}),
g AS (SELECT model, combination_id, x AS cutoff, sum(CASE WHEN v>=x THEN pre ELSE 0 END)/count(*) AS approval_rate, coalesce(sum(CASE WHEN v>=x THEN pre*d ELSE 0 END)/nullif(sum(CASE WHEN v>=x THEN pre ELSE 0 END),0),0) AS default_rate FROM u, p GROUP BY model, combination_id, x)"""


@query(f"{_FRONT} SELECT model, combination_id, cutoff, round(approval_rate,6) AS approval_rate, round(default_rate,6) AS default_rate FROM g")
def model_frontier(spark, sf):
    return rounded(search.model_frontier(applicants(spark, sf), BASE, dict.fromkeys(SCORES, _MODEL_CUTS)))


@query(f"""{_FRONT}, h AS (SELECT * FROM g WHERE model='score_5'), x1 AS (SELECT *, 'same_approval' AS proposal FROM h ORDER BY round(abs(approval_rate-0.25),9), combination_id LIMIT 1), x2 AS (SELECT *, 'same_default' AS proposal FROM h ORDER BY round(abs(default_rate-0.06),9), combination_id LIMIT 1),
x3 AS (SELECT *, 'between' AS proposal FROM h ORDER BY round(abs(cutoff-(SELECT avg(cutoff) FROM (SELECT cutoff FROM x1 UNION ALL SELECT cutoff FROM x2))),9), combination_id LIMIT 1)
SELECT model, combination_id, cutoff, round(approval_rate,6) AS approval_rate, round(default_rate,6) AS default_rate, proposal FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)""")
def proposals(spark, sf):
    front = search.model_frontier(applicants(spark, sf), BASE, {"score_5": _MODEL_CUTS})
    return rounded(search.proposals(front, 0.25, 0.06))


# --- scoring --------------------------------------------------------------------


@query(ORACLE_SQL["decision_table"].removeprefix("WITH "))
def deploy_predict(spark, sf):
    df = applicants(spark, sf)
    out = deploy.score(df, FULL, evaluate.fit(df, FULL), RATING())
    return rounded(out.select("applicant_id", "decision", "reason", "hired", "defaulted", "scenario", "rating"))
