"""Quality scores from a sparse ensemble of rules over text statistics.

Statistics of whole texts are built-in expressions. Shallow trees are grown on
labelled rows; every path from a root to a node below it is a rule, a conjunction of
intervals of statistics. A logistic model with lasso weights over all rules keeps the few
that matter, and these are compiled into one column expression, so scoring is a
narrow plan without Python.

Learning uses at most about ``SAMPLE`` labelled rows (drawn by the hash of their id).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from creditflow.llm.storage import broadcast_if_small, stored

#: Labelled rows at most (expected), trees, their depth, least labelled rows behind a node, and the lasso penalty.
SAMPLE, TREES, DEPTH, LEAST, LASSO = 40_000, 24, 3, 10, 1e-3
SEED = 11
#: The same characters as in other operators.
_SPACE = r"[ \t\n\x0B\f\r]"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns of ``STATISTICS`` (double, never null; null text is empty) and drops the text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c) for c in docs.columns if c != text_col]
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    rows = docs.select(*kept, t.alias("t"))
    rows = rows.select(*kept, "t", F.filter(F.split("t", f"{_SPACE}+"), lambda w: w != "").alias("words"), F.split("t", "\n").alias("lines"))
    rows = rows.select(
        *kept, F.length("t").alias("n"), left(r"\P{L}+").alias("letters"), left(r"\P{Lu}+").alias("upper"), left(r"\P{N}+").alias("digits"), left(f"{_SPACE}+").alias("solid"),
        F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("different"),
        F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: a == b), lambda same: same)).alias("again"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("short"), F.size(F.filter("words", lambda w: F.length(w) >= 16)).alias("long"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("other_lines"),
        F.regexp_count("t", F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")).alias("bare"), F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\s]{2,}")).alias("runs"), F.regexp_count("t", F.lit(r"[.?!](?!\S)")).alias("stops"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    found = {
        "log_words": F.log1p(F.col("n_words").cast("double")), "word_size": share("solid", "n_words"), "letter_share": share("letters", "solid"), "upper_share": share("upper", "letters"),
        "digit_share": share("digits", "solid"), "distinct_share": share("different", "n_words"), "again_share": share("again", "n_words"), "short_share": share("short", "n_words"),
        "long_share": share("long", "n_words"), "line_words": share("n_words", "n_lines"), "line_share": share("other_lines", "n_lines"), "bare_share": share("bare", "n_words"),
        "run_share": share("runs", "n_words"), "stop_share": share("stops", "n_words"),
    }
    return rows.select(*kept, *(found[s].alias(s) for s in STATISTICS))


STATISTICS = (
    "log_words", "word_size", "letter_share", "upper_share", "digit_share", "distinct_share", "again_share", "short_share",
    "long_share", "line_words", "line_share", "bare_share", "run_share", "stop_share",
)


@dataclass(frozen=True)
class Rule:
    """Holds where every statistic lies above ``low`` and up to ``high``."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        sides = [side for name, low, high in self.bounds for side in ([F.col(name) > low] if low > -math.inf else []) + ([F.col(name) <= high] if high < math.inf else [])]
        return reduce(and_, sides)

    def __str__(self) -> str:
        return " and ".join(f"{low:.6g} < {name} <= {high:.6g}" for name, low, high in self.bounds)


@dataclass
class Model:
    """log-odds = intercept + weights of the rules that hold."""

    intercept: float
    rules: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        z = reduce(add, [F.when(rule.column(), F.lit(w)).otherwise(0.0) for rule, w in self.rules.items()], F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


def rules_of(trees: Iterable[str], names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The paths of trees, as Spark prints them, to all nodes below the roots; equal ones once, in order."""
    found: dict[Rule, None] = {}
    for tree in trees:
        path: list[tuple[str, str, float]] = []
        for line in tree.splitlines():
            m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
            if m:
                indent = len(m[1])
                path = [p for p in path if p[0] < indent] + [(indent, names[int(m[2])], m[3], float(m[4]))]
                bounds: dict[str, tuple[float, float]] = {}
                for _, name, side, at in path:
                    low, high = bounds.get(name, (-math.inf, math.inf))
                    bounds[name] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
                found[Rule(tuple((name, *bounds[name]) for name in names if name in bounds))] = None
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns rules and weights from labelled rows for which ``usable`` (on the label table) holds.

    Rows with a null id or label say nothing; of several labels for an id the
    greatest counts. Without both labels the score is a constant, (ones + 1) / (rows + 2).
    """
    labelled = labels.where(usable).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    drawn = stored(labelled.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "labels")
    drawn = drawn.where(F.col("draw") < math.ceil(min(1.0, sample / max(1, drawn.count())) * (1 << 20))).drop("draw")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(broadcast_if_small(drawn, drawn.count()), "id")
    rows = stored(statistics(rows).withColumn("x", array_to_vector(F.array(*STATISTICS))), "statistics")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Model(math.log((ones + 1) / (n - ones + 1)))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=LEAST, featureSubsetStrategy="onethird", seed=SEED)
    rules = rules_of(t.toDebugString for t in forest.fit(rows).trees)
    if not rules:
        return Model(math.log(ones / (n - ones)))
    held = stored(rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("x")), "rules")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=100, tol=1e-6).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return Model(lasso.intercept, {r: w for r, w in zip(rules, weights, strict=True) if w})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score.

    Defined cases: a null text is the empty text, one empty line without words; null ids
    are kept; repeated rows count each; an empty table gives no row; other columns do
    not matter.
    """
    rows = statistics(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.select(F.col("id").alias(id_col), model.score().alias("score"))


def op11_rule_quality(spark, sf_dir: str) -> DataFrame:
    from creditflow.llm.toxicity import held_out

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
