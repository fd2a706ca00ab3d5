"""Risk ratings: fit on micro bins, predict by breaks, bands or segments, labels and bands.

Rows are reduced to (segment, key, month) counts in one aggregate; the merge runs
on that small table, one group per segment or pair, in parallel.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.functions.binning import left_bin, quantile_edges, unique
from creditflow.functions.expressions import quoted
from creditflow.operators._merge import merge_bins


#: Rows of a band table, which is broadcast.
MAX_BANDS = 100_000


@dataclass(frozen=True)
class Recipe:
    """Breaks of each score (outer ones included) and the rating of each micro-bin key."""

    breaks: dict[str, tuple[float, ...]]
    mapping: dict[str, int]

    def key(self) -> Column:
        return F.concat_ws("-", *(left_bin(F.col(c), list(b[1:-1])).cast("string") for c, b in self.breaks.items()))

    def predict(self) -> Column:
        """The rating; null for a key without one."""
        if not self.mapping:
            return F.lit(None).cast("int")
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in self.mapping.items() for x in kv)), self.key())


    def to_json(self) -> str:
        return json.dumps({"breaks": self.breaks, "mapping": self.mapping})

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        data = json.loads(text)
        return cls({c: tuple(b) for c, b in data["breaks"].items()}, data["mapping"])


def predict_by_segment(segment: str, recipes: dict[str, Recipe]) -> Column:
    return F.coalesce(*(F.when(quoted(segment) == s, r.predict()) for s, r in recipes.items()), F.lit(None).cast("int"))


#: A row for each segment and score, and a row for each cell of a segment.
BREAKS, CELLS = "segment string, position int, score string, breaks array<double>", "segment string, key string, rating int"
#: Rows of breaks or cells that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_CELLS = 500_000


def recipe_tables(spark, recipes: dict[str | None, Recipe]) -> tuple[DataFrame, DataFrame]:
    """Recipes by segment (None: for all rows) as two tables, of breaks and of cells."""
    breaks = [(seg, i, score, [float(x) for x in b]) for seg, r in recipes.items() for i, (score, b) in enumerate(r.breaks.items())]
    cells = [(seg, k, int(g)) for seg, r in recipes.items() for k, g in r.mapping.items()]
    return spark.createDataFrame(breaks, BREAKS), spark.createDataFrame(cells, CELLS)


def recipes_from_tables(breaks: DataFrame, cells: DataFrame) -> dict[str | None, Recipe]:
    """The recipes of two (small) tables."""
    out: dict[str | None, Recipe] = {}
    for r in sorted(breaks.collect(), key=lambda r: (r["segment"] or "", r["position"])):
        out.setdefault(r["segment"], Recipe({}, {})).breaks[r["score"]] = tuple(r["breaks"])
    for r in cells.collect():
        out[r["segment"]].mapping[r["key"]] = r["rating"]
    return out


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS else df


def rate_by_recipe_table(df: DataFrame, breaks: DataFrame, cells: DataFrame, segment: str | None = None, name: str = "rating") -> DataFrame:
    """df with a rating from tables of recipes: each row's bins by its segment's breaks, and the cell of their key by equality.

    The plan has the scores in it, but no cell and no segment. Rows of an unknown
    (or null) segment, and of a cell without a rating, get null; a null score is in the
    top bin. Segments may use different scores of those in the table. It runs on a
    stream as well.
    """
    scores = sorted(r["score"] for r in breaks.select("score").distinct().collect())  # columns of df
    by_segment = breaks.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("position", "score", "breaks"))).alias("breaks"))
    row = df.select(F.struct("*").alias("row"))  # whatever its columns are called
    own = (lambda side: F.col("row").getField(segment).eqNullSafe(F.col(side)) & F.col(side).isNotNull()) if segment else (lambda side: F.col(side).isNull())
    found = row.join(_few(by_segment), own("segment"), "left").drop("segment")
    value = lambda b: F.coalesce(*(F.when(b["score"] == c, F.col("row").getField(c).cast("double")) for c in scores), F.lit(None).cast("double"))
    inner = lambda b: F.slice(b["breaks"], F.lit(2), F.greatest(F.size(b["breaks"]) - 2, F.lit(0)))
    place = lambda b: F.when(value(b).isNull(), F.size(inner(b))).otherwise(F.size(F.filter(inner(b), lambda e: e <= value(b))))
    found = found.withColumn("key", F.array_join(F.transform("breaks", lambda b: place(b).cast("string")), "-")).drop("breaks")
    cells = cells.select("segment", F.col("key").alias("cell"), F.col("rating").alias("found"))
    found = found.join(_few(cells), own("segment") & (F.col("key") == F.col("cell")), "left")
    return found.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != name), F.col("found").alias(name))


def letter_number(letter: str) -> int:
    """A to E are 1 to 5; any other letter is 5."""
    return {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}.get(letter, 5)


def predict_by_bands(score: str, bands: list[tuple[str, float, float]]) -> Column:
    """Ratings by closed score bands (letter, least, greatest); the later band wins; outside all: null."""
    cases = [F.when(F.col(score).between(low, high), F.lit(letter_number(letter))) for letter, low, high in reversed(bands)]
    return F.coalesce(*cases, F.lit(None).cast("int"))


@dataclass(frozen=True)
class Bands:
    """Closed score bands (letter, least, greatest) of one score; the later band wins."""

    score: str
    bands: tuple[tuple[str, float, float], ...]

    def predict(self) -> Column:
        return predict_by_bands(self.score, list(self.bands)) if self.bands else F.lit(None).cast("int")


@dataclass(frozen=True)
class Segmented:
    """A rating of its own (Recipe or Bands) for each value of a column."""

    segment: str
    parts: dict[str, Recipe | Bands]


def rated(df: DataFrame, rating: Recipe | Bands | Segmented | None, name: str) -> DataFrame:
    """df with the rating (null where there is none) in column ``name``; recipes by segment are joined as tables."""
    if not isinstance(rating, Segmented):
        return df.withColumn(name, F.lit(None).cast("int") if rating is None else rating.predict())
    if all(isinstance(p, Recipe) for p in rating.parts.values()):
        return rate_by_recipe_table(df, *recipe_tables(df.sparkSession, rating.parts), rating.segment, name)
    return df.withColumn(name, predict_by_segment(rating.segment, rating.parts))


def rate_by_band_table(df: DataFrame, score: str, bands: DataFrame, segment: str | None = None) -> DataFrame:
    """df with rating, from a band table (segment, rating, min_score, max_score) by equality and range; no band: null.

    A table of more than MAX_BANDS rows is refused: bands are a handful for each segment.
    """
    if bands.limit(MAX_BANDS + 1).count() > MAX_BANDS:
        raise ValueError("too many bands")
    on = (F.col(f"l.`{score}`") >= F.col("r.min_score")) & (F.col(f"l.`{score}`") <= F.col("r.max_score"))
    if segment:
        on = on & (F.col(f"l.`{segment}`") == F.col("r.segment"))
    return df.alias("l").join(F.broadcast(bands).alias("r"), on, "left").select("l.*", F.col("r.rating").alias("rating"))


def letter(rating: Column) -> Column:
    return F.chr(F.lit(64) + rating)


def micro_bins(df: DataFrame, recipe: Recipe, default: str, time: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Non-null defaults and bads by key (and month)."""
    by = [*(keys or []), recipe.key().alias("key"), *([F.col(time).alias("month")] if time else [])]
    return df.where(F.col(default).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("volume"), F.sum(F.col(default).cast("bigint")).alias("bads"))


def _fit_groups(pdf: pd.DataFrame, single: bool, max_groups: int, min_vol_ratio: float, max_crossings: int, method: str, keys: list[str]) -> pd.DataFrame:
    total = pdf.groupby("key", as_index=False)[["volume", "bads"]].sum()
    total["pd"] = total["bads"] / total["volume"].clip(lower=1)
    if single:  # high scores first
        total["order"] = -total["key"].astype(int)
        total = total.sort_values("order")
    else:
        total = total.sort_values(["pd", "key"])
    months = sorted(pdf["month"].unique()) if "month" in pdf else []
    table = lambda c: pdf.pivot_table(index="key", columns="month", values=c, aggfunc="sum", fill_value=0).reindex(total["key"])[months].to_numpy() if len(months) else np.zeros((len(total), 0))
    total["rating"] = merge_bins(total["volume"], total["bads"], table("volume"), table("bads"), max_groups, min_vol_ratio, max_crossings, method)
    for k in keys:
        total[k] = pdf[k].iloc[0]
    return total[[*keys, "key", "volume", "bads", "rating"]]


def fit_groups(bins: DataFrame, single: bool, max_groups: int = 5, min_vol_ratio: float = 0.05, max_crossings: int = 1, method: str = "ward", keys: list[str] | None = None) -> DataFrame:
    """(keys, key, month, volume, bads) -> (keys, key, volume, bads, rating), one merge for each value of keys."""
    keys = keys or []
    schema = "".join(f"{k} string, " for k in keys) + "key string, volume long, bads long, rating int"
    grouped = bins.groupBy(*keys) if keys else bins.withColumn("_all", F.lit(0)).groupBy("_all")
    return grouped.applyInPandas(lambda pdf: _fit_groups(pdf, single, max_groups, min_vol_ratio, max_crossings, method, keys), schema)


def breaks_of(df: DataFrame, scores: list[str], bins: int) -> dict[str, tuple[float, ...]]:
    edges = quantile_edges(df, scores, [i / bins for i in range(bins + 1)])
    out = {c: tuple(unique(e)) for c, e in edges.items()}
    if bad := [c for c, e in out.items() if len(e) < 2]:
        raise ValueError(f"too few distinct values: {', '.join(bad)}")
    return out


@dataclass(frozen=True)
class FittedRatings:
    recipe: Recipe
    bins: DataFrame  # key, volume, bads, rating
    time: str | None = None
    oot_date: str | None = None

    def report(self, df: DataFrame, default: str, train: Column | None = None) -> DataFrame:
        """Volume and default rate by period (Train, OOT, and All over both) and rating.

        The periods meet at oot_date, unless ``train`` tells them apart; rows for which that
        is unknown (no month) are in All only. Rows without a rating are left out.
        """
        train = train_flag(self.time, self.oot_date) if train is None else train
        return period_report(df.select(self.recipe.predict().alias("rating"), F.col(default).cast("double").alias("d"), train.alias("train")), [])


def train_flag(time: str | None, oot_date: str | None) -> Column:
    """Whether a row is older than oot_date; null without either."""
    return quoted(time) < oot_date if time and oot_date else F.lit(None).cast("boolean")


def period_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, period, rating, volume, default_rate of rows with rating, d (default) and train (null: of no period)."""
    periods = F.array_compact(F.array(F.lit("All"), F.when(F.col("train"), "Train").when(~F.col("train"), "OOT")))
    rows = rows.where("rating is not null").select(*keys, "rating", "d", F.explode(periods).alias("period"))
    return rows.groupBy(*keys, "period", "rating").agg(F.count("d").alias("volume"), F.avg("d").alias("default_rate"))


def _training_rows(df: DataFrame, scores: list[str], default: str, bins: int, max_groups: int, time: str | None, oot_date: str | None) -> DataFrame:
    """The rows before oot_date, after the arguments are checked."""
    if max_groups > bins:
        raise ValueError("max_groups exceeds bins")
    if missing := {*scores, default, *([time] if time else [])} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    train = df.where(F.col(time) < oot_date) if time and oot_date else df
    if train.isEmpty():
        raise ValueError("no training rows")
    return train


def fit_ratings(df: DataFrame, scores: list[str], default: str, bins: int = 20, max_groups: int = 5, min_vol_ratio: float = 0.05, max_crossings: int = 1, time: str | None = None, method: str = "ward", oot_date: str | None = None) -> FittedRatings:
    """Ratings from quantile bins of one score or several, on rows before oot_date."""
    train = _training_rows(df, scores, default, bins, max_groups, time, oot_date)
    recipe = Recipe(breaks_of(train, scores, bins), {})
    groups = fit_groups(micro_bins(train, recipe, default, time), len(scores) == 1, max_groups, min_vol_ratio, max_crossings, method)
    rows = groups.collect()  # bins ** scores rows at most
    return FittedRatings(Recipe(recipe.breaks, {r["key"]: r["rating"] for r in rows}), groups, time, oot_date)


@dataclass(frozen=True)
class FittedPairs:
    """Two-score fits, a pair each: ``bins`` (pair, key, volume, bads, rating) and their breaks."""

    primary: str
    breaks: dict[str, tuple[float, ...]]
    challengers: tuple[str, ...]
    bins: DataFrame
    time: str | None
    oot_date: str | None

    def pair(self, challenger: str) -> str:
        return f"{self.primary}_vs_{challenger}"

    def _keys(self) -> list[Column]:
        return [F.struct(F.lit(self.pair(c)).alias("pair"), Recipe({s: self.breaks[s] for s in (self.primary, c)}, {}).key().alias("key")) for c in self.challengers]

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The recipes of all pairs as ``recipe_tables`` has them, the pair in place of the segment."""
        rows = [(self.pair(c), i, s, list(self.breaks[s])) for c in self.challengers for i, s in enumerate((self.primary, c))]
        return self.bins.sparkSession.createDataFrame(rows, BREAKS), self.bins.select(F.col("pair").alias("segment"), "key", "rating")

    def recipe(self, challenger: str) -> Recipe:
        cells = self.bins.where(F.col("pair") == self.pair(challenger)).collect()  # bins ** 2 rows at most
        return Recipe({s: self.breaks[s] for s in (self.primary, challenger)}, {r["key"]: r["rating"] for r in cells})

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """id, pair, rating: every row once for each pair."""
        rows = df.select(quoted(id_col), F.explode(F.array(*self._keys())).alias("k"))
        return rows.join(_few(self.bins.select("pair", "key", "rating")), (F.col("k.pair") == F.col("pair")) & (F.col("k.key") == F.col("key")), "left").select(quoted(id_col), F.col("k.pair").alias("pair"), "rating")

    def report(self, df: DataFrame, default: str) -> DataFrame:
        """pair, period, rating, volume, default_rate; see ``period_report``."""
        rows = df.select(F.explode(F.array(*self._keys())).alias("k"), F.col(default).cast("double").alias("d"), train_flag(self.time, self.oot_date).alias("train"))
        rated = rows.join(_few(self.bins.select("pair", "key", "rating")), (F.col("k.pair") == F.col("pair")) & (F.col("k.key") == F.col("key")))
        return period_report(rated, ["pair"])


def fit_pairwise(df: DataFrame, primary: str, challengers: list[str], default: str, bins: int = 10, time: str | None = None, oot_date: str | None = None, max_groups: int = 5, **options) -> FittedPairs:
    """One two-score fit for each challenger on the rows before oot_date: all breaks in one pass, all cells in another, a merge for each pair."""
    train = _training_rows(df, [primary, *challengers], default, bins, max_groups, time, oot_date)
    fitted = FittedPairs(primary, breaks_of(train, [primary, *challengers], bins), tuple(challengers), train, time, oot_date)
    rows = train.where(F.col(default).isNotNull()).select(F.explode(F.array(*fitted._keys())).alias("k"), *([F.col(time).alias("month")] if time else []), F.col(default).cast("bigint").alias("d"))
    cells = rows.groupBy("k.pair", "k.key", *(["month"] if time else [])).agg(F.count(F.lit(1)).alias("volume"), F.sum("d").alias("bads"))
    return replace(fitted, bins=fit_groups(cells, False, max_groups, keys=["pair"], **options))


def relabel(df: DataFrame, rating: Column, default: str) -> DataFrame:
    """rating, label: letters by observed default rate, lowest first."""
    rates = df.groupBy(rating.alias("rating")).agg(F.avg(F.col(default).cast("double")).alias("rate")).where("rating is not null")
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("rate").asc_nulls_last(), "rating"))  # a row for each rating
    return rates.select("rating", letter(place).alias("label"), "rate")


def bands(spark, recipes: dict[str, Recipe], score: str, top: int = 1000) -> DataFrame:
    """Score bands of one-score recipes by segment: least and greatest whole score of each rating (E without a mapping, and for the fifth group and all beyond it)."""
    scores = spark.range(0, top + 1).select(F.col("id").cast("double").alias(score))
    parts = [scores.select(F.lit(s).alias("segment"), letter(F.least(F.coalesce(r.predict(), F.lit(5)), F.lit(5))).alias("rating"), score) for s, r in recipes.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("segment", "rating").agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def matrix(spark, recipe: Recipe) -> DataFrame:
    """The recipe's cells with letters: a row for each key."""
    rows = [(k, *map(int, k.split("-")), chr(64 + g)) for k, g in recipe.mapping.items()]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"bin_{c} int" for c in recipe.breaks) + ", rating string")


def not_rating(rating: Column, riskiest: int) -> Column:
    """True for rows of any other rating, and for rows without one."""
    return F.coalesce(rating != riskiest, F.lit(True))

