"""The applicant table over the test tables: one row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creditflow.functions.expressions import uniform


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = (
        read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(read("nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(read("region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    u = lambda salt: uniform(salt, F.col("o_orderkey"))
    whole = lambda x: F.floor(x).cast("bigint")
    amount = lambda share, salt, top: F.when(u(salt) < share, whole(u(salt + "2") * top)).otherwise(F.lit(0)).cast("bigint")
    score = lambda a, b, salt: whole(1000 * (a * u("y") + b * u(salt)))
    rows = rows.select(
        F.col("o_orderkey").cast("bigint").alias("applicant_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("safra"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("employment"),
        (F.lit(16) + (F.col("o_custkey") * 37) % 60).cast("bigint").alias("age"),
        whole(F.col("o_totalprice") / 50).alias("income"),
        (u("c") < 0.998).alias("cpf_valido"),
        amount(0.22, "n", 8000).alias("vl_negativacao"),
        amount(0.17, "v", 9000).alias("vl_vencido_scr"),
        amount(0.11, "p", 2000).alias("vl_protestos"),
        score(0.55, 0.45, "l").alias("legacy_score"),
        score(0.65, 0.35, "s4").alias("score_4"),
        score(0.75, 0.25, "s5").alias("score_5"),
        u("y").alias("_y"), u("h").alias("_h"), u("d").alias("_d"),
    )
    rows = rows.withColumn("approved", F.when((F.col("age") >= 18) & (F.col("vl_negativacao") <= 5000) & (F.col("legacy_score") >= 600), 1).otherwise(0))
    rows = rows.withColumn("hired", F.when((F.col("approved") == 1) & (F.col("_h") < 0.65), 1).otherwise(0))
    bad = F.col("_d") < F.lit(0.5) * (1 - F.col("_y")) * (1 - F.col("_y")) + 0.02
    return rows.withColumn("actual_default", F.when(F.col("hired") == 1, F.when(bad, 1).otherwise(0))).drop("_y", "_h", "_d")


def _u(salt: str, key: str = "o_orderkey") -> str:
    return f"(('0x'||substr(md5(concat('{salt}|',{key})),1,8))::UBIGINT::DOUBLE/4294967296.0::DOUBLE)"


def _amount(share: float, salt: str, top: int) -> str:
    return f"CASE WHEN {_u(salt)}<{share}::DOUBLE THEN CAST(FLOOR({_u(salt + '2')}*{top}) AS BIGINT) ELSE 0::BIGINT END"


def _score(a: float, b: float, salt: str) -> str:
    return f"CAST(FLOOR(1000*({a}::DOUBLE*{_u('y')}+{b}::DOUBLE*{_u(salt)})) AS BIGINT)"


#: The same table as a chain of common table expressions, named ``a``.
SQL = f"""a0 AS (SELECT CAST(o_orderkey AS BIGINT) AS applicant_id, strftime(o_orderdate,'%Y-%m') AS safra, r_name AS region, c_mktsegment AS employment,
  CAST(16+(o_custkey*37)%60 AS BIGINT) AS age, CAST(FLOOR(o_totalprice/50) AS BIGINT) AS income, {_u('c')}<0.998::DOUBLE AS cpf_valido,
  {_amount(0.22, 'n', 8000)} AS vl_negativacao, {_amount(0.17, 'v', 9000)} AS vl_vencido_scr, {_amount(0.11, 'p', 2000)} AS vl_protestos,
  {_score(0.55, 0.45, 'l')} AS legacy_score, {_score(0.65, 0.35, 's4')} AS score_4, {_score(0.75, 0.25, 's5')} AS score_5,
  {_u('y')} AS y, {_u('h')} AS h, {_u('d')} AS d
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
a1 AS (SELECT *, CASE WHEN age>=18 AND vl_negativacao<=5000 AND legacy_score>=600 THEN 1 ELSE 0 END AS approved FROM a0),
a2 AS (SELECT *, CASE WHEN approved=1 AND h<0.65::DOUBLE THEN 1 ELSE 0 END AS hired FROM a1),
a AS (SELECT * EXCLUDE (y,h,d), CASE WHEN hired=1 THEN (CASE WHEN d < 0.5::DOUBLE*(1-y)*(1-y)+0.02::DOUBLE THEN 1 ELSE 0 END) END AS actual_default FROM a2)"""
