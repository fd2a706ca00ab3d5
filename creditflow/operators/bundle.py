"""A deployed policy as one object: rules, ratings and all that was learned, by version.

A folder holds two tables. ``learned`` has a row for each bin of each calibration, and for
each edge of a stress (tens of rows a version); ``rules`` has a row for each version, with
the JSON of policy and ratings, and is written last: what a failed save leaves behind
belongs to no version. New applicants, in a batch or on a stream, are scored from a
loaded bundle as they would be in the session that fitted it; nothing is fitted again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from creditflow.functions.binning import BinnedMean
from creditflow.operators import deploy
from creditflow.operators.evaluate import Fitted, fit
from creditflow.operators.policy import Policy, from_json, to_json
from creditflow.operators.production import Rating
from creditflow.operators.ratings import Bands, Recipe, Segmented, rated

#: label: ``pd``, ``rating``, ``rate:<stage>`` or ``stress:<number>``. A bin's edge is its upper end; the bin -1 has the mean of all.
LEARNED = "version string, label string, bin int, edge double, tie string, mean double"
RULES = "version string, saved_at timestamp, rules string"
#: The rating's column while rows are scored; decision tables leave it out.
RATING = "risk_rating"
#: Calibrations that one join may broadcast.
MAX_CALIBRATIONS = 100_000


def _rating_dict(r: Rating) -> dict | None:
    if r is None:
        return None
    if isinstance(r, Segmented):
        return {"segment": r.segment, "parts": {s: _rating_dict(p) for s, p in r.parts.items()}}
    return {"breaks": r.breaks, "mapping": r.mapping} if isinstance(r, Recipe) else {"score": r.score, "bands": r.bands}


def _rating_of(d: dict | None) -> Rating:
    if d is None:
        return None
    if "parts" in d:
        return Segmented(d["segment"], {s: _rating_of(p) for s, p in d["parts"].items()})
    if "bands" in d:
        return Bands(d["score"], tuple(tuple(b) for b in d["bands"]))
    return Recipe({c: tuple(b) for c, b in d["breaks"].items()}, d["mapping"])


def _mean_rows(label: str, m: BinnedMean) -> list[tuple]:
    ends = [*m.inner, None]
    means = list(m.means) or [None] * len(ends)
    return [(label, -1, None, None, m.fallback), *((label, i, e, None, x) for i, (e, x) in enumerate(zip(ends, means, strict=True)))]


def learned_rows(fitted: Fitted) -> list[tuple]:
    """(label, bin, edge, tie, mean) of everything in fitted."""
    rows = [*_mean_rows("pd", fitted.pd), *(r for i, m in fitted.rates.items() for r in _mean_rows(f"rate:{i}", m))]
    if fitted.pd_by_rating is not None:
        rows += [("rating", -1, None, None, fitted.pd.fallback), *(("rating", k, None, None, m) for k, m in fitted.pd_by_rating.items())]
    for k, edges in fitted.stress.items():
        rows += [(f"stress:{k}", -1, None, None, None), *((f"stress:{k}", i, e, str(t), None) for i, (e, t) in enumerate(edges))]
    return rows


def _binned(rows: list) -> BinnedMean:
    bins = sorted((r for r in rows if r["bin"] >= 0), key=lambda r: r["bin"])
    means = tuple(r["mean"] for r in bins)
    return BinnedMean(tuple(r["edge"] for r in bins[:-1]), means if any(m is not None for m in means) else (), next(r["mean"] for r in rows if r["bin"] < 0))


def fitted_of(rows: list) -> Fitted:
    """What learned_rows wrote; ties are text, which compares with whole-number ids as numbers."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["label"], []).append(r)
    part = lambda kind: {int(k.partition(":")[2]): v for k, v in by.items() if k.startswith(f"{kind}:")}
    ratings = {r["bin"]: r["mean"] for r in by["rating"] if r["bin"] >= 0} if "rating" in by else None
    stress = {k: tuple((r["edge"], r["tie"]) for r in sorted(v, key=lambda r: r["bin"]) if r["bin"] >= 0) for k, v in part("stress").items()}
    return Fitted({i: _binned(v) for i, v in part("rate").items()}, _binned(by["pd"]), ratings, stress)


@dataclass(frozen=True)
class Bundle:
    """Policy, rating and what was learned. A rating that calibrates (``by_rating``) gives the baseline default rate; otherwise the score does."""

    policy: Policy
    fitted: Fitted
    rating: Rating = None
    version: str = "1"

    @classmethod
    def fit(cls, df: DataFrame, policy: Policy, rating: Rating = None, by_rating: bool = False, version: str = "1") -> Bundle:
        column = F.col(RATING) if by_rating else None
        return cls(policy, fit(rated(df, rating, RATING) if by_rating else df, policy, column), rating, version)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the folder; a version that is there is never changed."""
        if self.version in versions(spark, path):
            raise ValueError(f"version {self.version} is there already")
        rules = json.dumps({"policy": to_json(self.policy), "rating": _rating_dict(self.rating)})
        spark.createDataFrame([(self.version, *r) for r in learned_rows(self.fitted)], LEARNED).coalesce(1).write.mode("append").parquet(f"{path}/learned")
        spark.createDataFrame([(self.version, rules)], "version string, rules string").select("version", F.current_timestamp().alias("saved_at"), "rules").coalesce(1).write.mode("append").parquet(f"{path}/rules")

    def rated(self, df: DataFrame) -> DataFrame:
        """df with the rating's number in ``risk_rating``."""
        return rated(df.drop(RATING), self.rating, RATING)

    def score(self, df: DataFrame, simple: bool = True, method: str = "analytical") -> DataFrame:
        """Decisions (or, if not simple, the whole evaluation) for a batch or a stream; labels may be missing."""
        if self.rating is None:
            return deploy.score(df, self.policy, self.fitted, None, simple, method)
        out = deploy.score(self.rated(df), self.policy, self.fitted, F.col(RATING), simple, method)
        return out if simple else out.drop(RATING)

    def score_stream(self, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        """Decisions for each micro-batch, appended as Parquet; exactly once by the file sink's log."""
        return self.score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions in the folder, oldest first."""
    return [r["version"] for r in _table(spark, f"{path}/rules", RULES).orderBy("saved_at", "version").select("version").collect()]


def load(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The named version, or the latest."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} in {path}")
    version = version or known[-1]
    own = F.col("version") == version
    rules = json.loads(_table(spark, f"{path}/rules", RULES).where(own).first()["rules"])
    rows = _table(spark, f"{path}/learned", LEARNED).where(own).distinct().collect()  # tens of rows
    return Bundle(from_json(rules["policy"])[0], fitted_of(rows), _rating_of(rules["rating"]), version)


def calibrated_by_version(df: DataFrame, learned: DataFrame, version: str, score: str, label: str = "pd", name: str = "pd") -> DataFrame:
    """df with the calibrated mean of each row's own version (a column of df), batch or stream.

    The learned table becomes a row for each version, with arrays of edges and means,
    which is broadcast while there are few (counted); more are joined by a shuffle. A
    row of an unknown version gets null; one without a score, or in a bin without a
    mean, the mean of all.
    """
    bins = F.array_sort(F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", "edge", "mean"))))
    table = learned.where(F.col("label") == label).groupBy(F.col("version").alias("_version")).agg(bins.alias("_bins"), F.max(F.when(F.col("bin") < 0, F.col("mean"))).alias("_whole"))
    if table.limit(MAX_CALIBRATIONS + 1).count() <= MAX_CALIBRATIONS:
        table = F.broadcast(table)
    row = df.select(F.struct("*").alias("row"))  # whatever its columns are called
    x = F.col("row").getField(score).cast("double")
    place = F.when(x.isNotNull(), F.size(F.filter("_bins", lambda b: b["edge"] < x)))
    found = row.join(table, F.col("row").getField(version) == F.col("_version"), "left")
    mean: Column = F.coalesce(F.get("_bins", place)["mean"], F.col("_whole"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != name), mean.alias(name))

