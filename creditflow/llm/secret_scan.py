"""Incremental secret scan over content-addressed texts, with built-in functions only.

Every version of a file is a row (path, text); its *blob* is the SHA-256 of the
text. A ledger of (blob, rule_version) says what has been scanned. ``scan``
takes the blobs that the ledger lacks at this rule version, each once however
many paths hold it, and ``report`` joins the findings of all blobs back to the paths.
``scan_increment`` keeps ledger and findings in a folder, to which each increment of
versions appends: a text that is known there is not scanned again.

Spans come from cutting: what lies between the matches of a pattern and the
matches themselves alternate, so running sums of their lengths (in code points)
give every start and end. Each match is a row of its own while these are summed,
so the work grows with the matches of a text, not with their square.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from creditflow.llm.storage import shared_dir

#: Name -> (pattern, least length, group whose length counts). Matching is leftmost and non-overlapping for each.
#: The header of a jwt has a greatest length, as every "eyJ" in a long run of its characters begins a search for the dot.
RULES = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
    "private_key": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 1, 0),
    "hub_token": (r"gh[opsu]_[A-Za-z0-9]{36,}", 40, 0),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 36, 0),
}
BASE = ("assign", "access", "hex")
#: Changes with RULES, so that old ledgers ask for a new scan.
RULE_VERSION = 2
LEDGER = "blob string, rule_version int, spans array<struct<start:int,kind:int,end:int>>"


def _steps(text: Column, kind: str) -> Column:
    """The matches of a rule in order: kind, number, lengths of the text before it (since the match before) and of itself, and whether it is long enough."""
    pattern, least, group = RULES[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # zipped, so that a lambda needs nothing but its element; what lies behind the last match has none
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1), whole, counted), lambda z: z["1"].isNotNull())
    steps = F.transform(rows, lambda z, i: F.struct(F.lit(list(RULES).index(kind)).alias("kind"), i.alias("i"), F.length(z["0"]).alias("gap"), F.length(z["1"]).alias("size"), (F.length(z["2"]) >= least).alias("ok")))
    return F.when(text.rlike(pattern), steps).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """blob, rule_version, spans (sorted by start, then rule) of every blob that the ledger has not at this version.

    The result is appended to the ledger (its first two columns) after it is kept.
    A null text is the empty text.
    """
    blobs = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    unseen = blobs.dropDuplicates(["blob"])
    steps = unseen.select("blob", F.explode_outer(F.concat(*(_steps(F.col("text"), kind) for kind in RULES))).alias("s")).select("blob", "s.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = steps.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    return ends.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def report(versions: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per version: id, blob, spans; a blob without a stored finding has none."""
    paths = versions.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    some = findings.where(F.size("spans") > 0).select("blob", "spans")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return paths.join(some, "blob", "left").select(id_col, "blob", F.coalesce("spans", empty).alias("spans"))


def kept_findings(spark: SparkSession, folder: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """The stored ledger's rows of this rule version; none if nothing is stored yet."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = spark.createDataFrame([], LEDGER)
    return ledger.where(F.col("rule_version") == rule_version)


def scan_increment(versions: DataFrame, folder: str, text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Scans what the ledger in folder lacks of versions, appends it, and gives all findings of the rule version.

    One writer at a time; a run that fails appends nothing.
    """
    spark = versions.sparkSession
    scan(versions, kept_findings(spark, folder, rule_version), text_col, rule_version).write.mode("append").parquet(folder)
    return kept_findings(spark, folder, rule_version)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1  # the table arrives in two increments
    scan_increment(docs.where(~second), ledger)
    found = report(docs, scan_increment(docs.where(second), ledger))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == list(RULES).index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(n(kind).alias(f"n_{kind}") for kind in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _oracle() -> str:
    kinds = []
    for i, (kind, (pattern, least, group)) in enumerate(RULES.items()):
        quoted = pattern.replace("'", "''")
        kinds.append(f"""SELECT doc_id, {i} AS k, '{kind}' AS kind, m, g, b FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS g, string_split_regex(t, '{quoted}') AS b FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(kinds)}),
x AS (SELECT doc_id, k, kind, unnest(range(1, len(m) + 1)) AS i, m, g, b FROM r WHERE len(m) > 0),
p AS (SELECT doc_id, k, kind, list_sum(list_transform(b[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS a, length(m[i]) AS n, length(g[i]) AS c FROM x),
o AS (SELECT doc_id, k, kind, a::BIGINT AS a, (a + n)::BIGINT AS e FROM p WHERE c >= list_extract([{", ".join(str(r[1]) for r in RULES.values())}], k + 1)),
s AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""


ORACLE_SQL = _oracle()
