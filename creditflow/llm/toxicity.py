"""Toxicity scores from a learned lexicon, misspellings and context.

The lexicon (words, and stems that stand for all words that begin with them) is
learned from labelled rows: terms far more frequent in toxic texts than in others,
by a likelihood-ratio test in which equal texts count once. It is kept as a trie. A word that is not in it is run
through a Levenshtein automaton (one edit, for words of ``FUZZY_FROM`` letters or
more) intersected with the trie. Each hit is weighed by its context: inside
quotation marks that open and close within ``CONTEXT`` words it counts as
quotation, otherwise as abuse. A logistic model on these sums gives the score.

Learning uses at most about ``SAMPLE`` labelled rows of each class (drawn by the
hash of their id); scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creditflow.llm.held import held, lean
from creditflow.llm.storage import broadcast_if_small, small_batches, stored

SAMPLE = 6000
#: Lexicon entries at most, best first; taken from the terms that passed every test.
TERMS = 5000
FUZZY_FROM, CONTEXT = 5, 6
MIN_RATIO, MIN_G2 = 8.0, 30.0
PREFIXES = (4, 5, 6, 7, 8)
#: Judged words a worker keeps, and rows of terms it gathers before it sends them on.
CACHE_WORDS, GATHERED = 150_000, 50_000
_QUOTES = "\"'“”„«»‘’"
_NO_LETTER = {c: " " for c in range(0x250) if not chr(c).isalpha()}


def plain(word: str) -> str:
    """The word in lower case without what stands around its letters and digits."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def parts(word: str) -> list[str]:
    core = plain(word)
    return [core] if core.isalpha() else core.translate(_NO_LETTER).split()


def terms_of(text: str) -> set[str]:
    """Words of a text, and the stems of their first letters (marked by a star)."""
    words = {p for w in set(text.split()) for p in parts(w)}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


class Trie:
    """Terms with weights; stems match every word that begins with them."""

    def __init__(self, weights: dict[str, float]):
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term, weight in weights.items():
            word = term.rstrip("*")
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            mark = "*" if term.endswith("*") else "."
            node[mark * 2] = max(weight, node.get(mark * 2, 0.0))
            if mark == "." and len(word) >= FUZZY_FROM:  # one edit leaves one half as it is
                self.heads.add(word[: len(word) // 2])
                self.tails.add(word[len(word) // 2 :])
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("**", 0.0))
        return max(best, node.get("..", 0.0))

    def fuzzy(self, word: str) -> float:
        """Best weight of a whole term one edit away: the automaton's rows run down the trie."""
        if len(word) < FUZZY_FROM - 1 or not (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return 0.0
        best, n = 0.0, len(word)
        stack = [(self.root, tuple(min(i, 2) for i in range(n + 1)), 0)]
        while stack:
            node, row, depth = stack.pop()
            if depth >= FUZZY_FROM and row[n] <= 1:
                best = max(best, node.get("..", 0.0))
            low, high = max(1, depth), min(n, depth + 2)  # cells off the band stay at 2
            for c, child in node.items():
                if len(c) == 1:
                    new = [2] * (n + 1)
                    if depth < 1:
                        new[0] = depth + 1
                    least = new[0]
                    for i in range(low, high + 1):
                        new[i] = min(row[i - 1] + (word[i - 1] != c), row[i] + 1, new[i - 1] + 1, 2)
                        least = min(least, new[i])
                    if least <= 1:
                        stack.append((child, tuple(new), depth + 1))
        return best


def distinct_terms(found: dict[str, tuple[float, int]], margin: float = 0.7) -> dict[str, float]:
    """Weights of the terms that say more than a shorter one.

    A stem goes if a shorter kept stem weighs about as much. A word goes if a kept
    stem does, unless it makes up half of that stem's rows: then it is a term of
    its own, of which misspellings are looked for.
    """
    kept: dict[str, float] = {}
    for term in sorted((t for t in found if t.endswith("*")), key=lambda t: (len(t), t)):
        stems = [term[:k] + "*" for k in PREFIXES if k < len(term) - 1]
        if all(kept.get(s, -1.0) < found[term][0] - margin for s in stems):
            kept[term] = found[term][0]
    out = dict(kept)
    for word in (t for t in found if not t.endswith("*")):
        stems = [s for k in PREFIXES if (s := word[:k] + "*") in kept]
        best = max(stems, key=kept.get, default=None)
        if best is None or kept[best] < found[word][0] - margin or found[word][1] >= 0.5 * found[best][1]:
            out[word] = found[word][0]
    return out


def independent(contexts: Column, toxic: Column) -> Column:
    """Whether a term stands between different words in at least half of its toxic texts (4 at least).

    Texts count once however many rows hold them. What is left are near copies of a
    toxic text, which make all of its words look toxic; there they keep their neighbours.
    """
    return contexts >= F.greatest(F.lit(4), 0.5 * toxic)


class Known(dict):
    """Each raw word's hit: None, or (weight, is fuzzy)."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = None
        cores = parts(word)
        exact = max((self.trie.exact(p) for p in cores), default=0.0)
        if exact > 0:
            found = (exact, False)
        else:
            fuzzy = max((self.trie.fuzzy(p) for p in {*cores, plain(word)}), default=0.0)
            if fuzzy > 0:
                found = (fuzzy, True)
        self[word] = found
        return found


def quoted(words: list[str], i: int) -> bool:
    """Whether quotation marks open before (or on) word i and close after (or on) it, within CONTEXT words."""
    before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
    opens = max((k for k, w in enumerate(before) if w[0] in _QUOTES), default=-1)
    if opens < 0 or any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in before[opens:-1] if len(w) > 1):
        return False
    return any(len(w) > 1 and w.rstrip(".,;:!?")[-1:] in _QUOTES for w in after)


def features(text: str | None, known: Known) -> list[float]:
    """log1p of summed weights: abuse, misspelled, quoted; hits; hits for each 100 words."""
    words = text.split() if text else []
    sums, hits = [0.0, 0.0, 0.0], 0
    for i in [i for i, w in enumerate(words) if known[w]]:
        weight, is_fuzzy = known[words[i]]
        sums[2 if quoted(words, i) else 1 if is_fuzzy else 0] += weight
        hits += 1
    return [*map(math.log1p, sums), math.log1p(hits), math.log1p(100 * hits / max(1, len(words)))]


N_FEATURES = 5


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    intercept: float = -30.0


@lean
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def sent() -> pa.RecordBatch:
        terms = list(toxic.keys() | clean.keys())
        columns = [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())]
        toxic.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(terms_of(text.as_py() or ""))
            if len(toxic) + len(clean) > GATHERED:
                yield sent()
    yield sent()


@lean
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All terms of each text with a hash of the words around their first place."""
    out: set[tuple[str, int]] = set()

    def sent() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), ())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()), strict=True)], ["term", "context"])
        out.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            words, seen = (text.as_py() or "").split(), set()
            for i, w in enumerate(words):
                for p in parts(w):
                    if p in seen:  # so are its stems
                        continue
                    new = {p, *(p[:k] + "*" for k in PREFIXES if len(p) >= k)} - seen
                    seen |= new
                    around = zlib.crc32(((words[i - 1] if i else "") + " " + (words[i + 1] if i + 1 < len(words) else "")).encode())
                    out.update((t, around) for t in new)
            if len(out) > GATHERED:
                yield sent()
    yield sent()


def _known(weights: dict[str, float]) -> Known:
    """One in a Python worker: judged words stay known from task to task."""
    return held(("lexicon", frozenset(weights.items())), lambda: Known(Trie(weights)))


@lean
def _features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known = _known(shared.value)
    for batch in batches:
        x = [features(t.as_py(), known) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "weight"])


@lean
def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    known = _known(model.weights)
    w = np.array(model.coefficients)
    for batch in batches:
        x = np.array([features(t.as_py(), known) for t in batch.column(1)]).reshape(-1, N_FEATURES)
        z = np.clip(x @ w + model.intercept, -30, 30)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["id", "score"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for ridge logistic regression (the intercept is not shrunk)."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, shrink = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - shrink @ beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + shrink
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(beta)), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row for each text and label, with the sum of the weights: copies say nothing new about words."""
    return rows.groupBy(F.sha2("text", 256).alias("address"), "label").agg(F.any_value("text").alias("text"), F.sum("weight").alias("weight")).select("text", "label", "weight")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns lexicon and weights from labelled rows for which ``usable`` (on the label table) holds."""
    small_batches(docs.sparkSession)
    labelled = labels.where(usable).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    drawn = stored(labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("weight", 1 / share), "labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(broadcast_if_small(drawn), "id").select("text", "label", "weight")
    rows = stored(distinct_texts(rows), "labelled")
    n_toxic, n_clean = (rows.where(F.col("label") == k).count() for k in (1, 0))
    if not n_toxic:
        return Model()
    a, b = F.col("toxic"), F.col("clean")
    toxic_rate, clean_rate = (a + 0.5) / (n_toxic + 1.0), (b + 0.5) / (n_clean + 1.0)
    both = (a + b) / float(n_toxic + n_clean)
    g2 = 2 * (a * F.log(F.greatest(a, F.lit(0.5)) / (both * n_toxic)) + b * F.log(F.greatest(b, F.lit(0.5)) / F.greatest(both * n_clean, F.lit(1e-9))))
    terms = rows.select("text", "label").mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = terms.withColumn("g2", g2).withColumn("weight", F.log(toxic_rate / clean_rate)).where((F.col("weight") >= math.log(MIN_RATIO)) & (F.col("g2") >= MIN_G2))
    terms = stored(terms, "terms")
    held = rows.where("label = 1").select("text").mapInArrow(_contexts, "term string, context long").join(broadcast_if_small(terms.select("term")), "term", "left_semi")
    contexts = held.distinct().groupBy("term").agg(F.count("*").alias("contexts"))
    found = terms.join(contexts, "term").where(independent(F.col("contexts"), a)).collect()  # no more than the labelled sample gives
    best = {r["term"]: r["g2"] for r in found}
    weights = distinct_terms({r["term"]: (r["weight"], r["toxic"]) for r in found})
    weights = {t: weights[t] for t in sorted(weights, key=lambda t: (-best[t], t))[:TERMS]}
    spark = docs.sparkSession
    table = rows.mapInArrow(lambda x, s=spark.sparkContext.broadcast(weights): _features(x, s), "x array<double>, label int, weight double").collect()
    x, y, w = np.array([r["x"] for r in table]), np.array([r["label"] for r in table], float), np.array([r["weight"] for r in table])
    coefficients, intercept = _logistic(x, y, w)
    return Model(weights, coefficients.tolist(), intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score.

    Defined cases: a null or empty text has no hits and gets the score of a text
    without hits; a model learned without any toxic row scores 0 throughout
    (1e-13); null ids are kept; other columns do not matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _scores(b, shared), "id long, score double").withColumnRenamed("id", id_col)


@lean
def _below(batches: Iterator[pa.RecordBatch], shared, column: str, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        scores = np.concatenate([np.zeros(0), *(s.column(1).to_numpy() for s in _scores(iter([pa.RecordBatch.from_arrays([texts, texts], ["id", "text"])]), shared))])
        yield batch.filter(pa.array(scores < threshold))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores threshold or more, whatever their ids."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _below(b, shared, text_col, threshold), docs.schema)


def held_out(id_col: str, buckets: int, left_out: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets == left_out, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, ~held_out("doc_id", 3, 1))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
