"""Language identification in two steps: family, then language within it.

Features are hashed byte n-grams (2 to 4 bytes; ASCII letters in lower case, other
ASCII as a blank) of the whole text, as shares of all its n-grams. Families are
learned: languages whose mean profiles are similar form one. A linear
support-vector machine per family (one against the rest) picks the family; within
it a machine for each pair of languages votes. All machines are linear, so a text
is scored by looking up each n-gram's weights and adding them.

Training draws at most about ``SAMPLE`` rows of each language, fewer where there are very many.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean
from creditflow.llm.storage import small_batches, stored

#: Training rows of each language, and of all languages together (32 KB each on the driver).
SAMPLE, SAMPLE_OF_ALL = 400, 4_000
BITS = 13
ORDERS = (2, 3, 4)
#: Languages are of one family when their profiles' cosine is at least this share of the way from the least to the greatest pair.
FAMILY_CUT = 0.5
#: Bytes of one slice of n-grams.
_SLICE = 1 << 19

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def _grams(piece: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams that begin at each byte but the last ones."""
    x = piece.astype(np.uint32)
    code = x.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            return
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        if n in ORDERS:
            yield ((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64)


def _spaced(raw: np.ndarray) -> np.ndarray:
    """Folded bytes with a blank at both ends."""
    return np.concatenate([[0x20], _FOLD[raw], [0x20]]).astype(np.uint8)


def profile(raw: np.ndarray) -> np.ndarray:
    """The n-gram shares of one text."""
    out = np.zeros(1 << BITS)
    text = _spaced(raw)
    for at_ in range(0, len(text), _SLICE):
        for g in _grams(text[at_ : at_ + _SLICE + max(ORDERS) - 1]):
            out += np.bincount(g, minlength=1 << BITS)
    return out / max(1.0, out.sum())


def letters_in(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    family_of: list[int]  # by language
    families: int
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # buckets x (families + pairs)
    intercepts: np.ndarray


def svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    a = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    lipschitz = 1.0 + 2 * c * float(weight @ np.einsum('ij,ij->i', a, a))
    w = z = np.zeros(a.shape[1], dtype=x.dtype)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (a @ z)).astype(x.dtype)
        gradient = z - x.dtype.type(2 * c) * (a.T @ (weight * y * slack))
        new = z - gradient / x.dtype.type(lipschitz)
        z = new + x.dtype.type((t - 1) / (t + 2)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _families(centres: np.ndarray) -> list[int]:
    """Average-linkage groups of language profiles, by cosine."""
    unit = centres / np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    cosine = unit @ unit.T
    groups = [[i] for i in range(len(centres))]
    apart = [cosine[i, j] for i, j in itertools.combinations(range(len(centres)), 2)]
    if not apart:
        return [0] * len(centres)
    cut = min(apart) + FAMILY_CUT * (max(apart) - min(apart))
    while len(groups) > 1:
        linked = {(a, b): float(np.mean(cosine[np.ix_(groups[a], groups[b])])) for a, b in itertools.combinations(range(len(groups)), 2)}
        a, b = max(linked, key=linked.get)
        if linked[a, b] < cut or len(groups) == 2 and len(centres) > 2:
            break
        groups[a] += groups.pop(b)
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(len(centres))]


@lean
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if letters_in(text):
                p = profile(np.frombuffer(text.encode(), dtype=np.uint8)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([p.tobytes()], pa.binary())], ["lang", "profile"])


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from rows with a language for which ``usable`` holds; None if there are none.

    Rows are drawn by a hash of their id. Their profiles (32 KB each, ``sample``
    for each language) come to the driver, which trains the machines.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    sample = min(sample, max(1, SAMPLE_OF_ALL // len(counts)))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))) for lang, n in sorted(counts.items())))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    table = stored(drawn.mapInArrow(_profiles, "lang string, profile binary"), "profiles").collect()
    languages = sorted({r["lang"] for r in table})
    if not languages:
        return None
    x = np.stack([np.frombuffer(r["profile"], dtype=np.float32) for r in table])
    label = np.array([languages.index(r["lang"]) for r in table])
    del table
    scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5)
    x = x * scale.astype(np.float32)
    centres = np.stack([x[label == k].mean(axis=0) for k in range(len(languages))])
    family = _families(centres)
    n_families = max(family) + 1
    columns, intercepts = [], []
    own = np.array(family)[label]
    for f in range(n_families):
        w, b = svm(x, np.where(own == f, 1.0, -1.0).astype(np.float32)) if n_families > 1 else (np.zeros(x.shape[1]), 1.0)
        columns.append(w)
        intercepts.append(b)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(languages)), 2) if family[a] == family[b]]
    for a, b in pairs:
        mine = (label == a) | (label == b)
        w, c = svm(x[mine], np.where(label[mine] == a, 1.0, -1.0).astype(np.float32))
        columns.append(w)
        intercepts.append(c)
    return Model(languages, family, n_families, pairs, (np.stack(columns, axis=1) * scale[:, None]).astype(np.float32), np.array(intercepts))


def decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores from the machines' margins, one row per text."""
    n = len(margins)
    sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
    family = margins[:, : model.families].argmax(axis=1)
    chance = sure(margins[:, : model.families].max(axis=1))
    votes, trust = np.zeros((n, len(model.languages))), np.ones((n, len(model.languages)))
    for k, (a, b) in enumerate(model.pairs, model.families):
        m = margins[:, k]
        votes[:, a] += (m >= 0) + 1e-3 * np.clip(m, -10, 10)
        votes[:, b] += (m < 0) - 1e-3 * np.clip(m, -10, 10)
        trust[:, a] = np.minimum(trust[:, a], sure(m))
        trust[:, b] = np.minimum(trust[:, b], sure(-m))
    votes[np.array(model.family_of)[None, :] != family[:, None]] = -np.inf
    best = votes.argmax(axis=1)
    return [model.languages[k] for k in best], np.clip(chance * trust[np.arange(n), best], 0.0, 1.0)


def _margins(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margins of some texts: the sums of their n-grams' weights, over their number, and the intercepts."""
    rows = len(offsets) - 1
    begin = offsets[:-1] + 2 * np.arange(rows)  # each with a blank at both ends
    size = np.diff(offsets) + 2
    text = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    text[np.arange(len(raw)) + 2 * owner + 1] = _FOLD[raw]
    total, count = np.zeros((rows, model.weights.shape[1])), np.zeros(rows)
    ends = begin + size
    for at_ in range(0, len(text), _SLICE):
        piece = text[at_ : at_ + _SLICE + max(ORDERS) - 1]
        for n, gram in zip(ORDERS, _grams(piece), strict=False):
            gram = gram[:_SLICE]
            first, last = np.searchsorted(ends, at_, "right"), np.searchsorted(begin, at_ + len(gram), "left")
            cuts = np.clip(np.stack([begin[first:last], ends[first:last] - n + 1]) - at_, 0, len(gram))
            run = np.zeros((len(gram) + 1, total.shape[1]))
            np.cumsum(model.weights[gram], axis=0, out=run[1:], dtype=np.float64)
            wide = np.maximum(cuts[1], cuts[0])
            total[first:last] += run[wide] - run[cuts[0]]
            count[first:last] += wide - cuts[0]
    return total / np.maximum(1, count)[:, None] + model.intercepts


@lean
def _predictions(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for batch in batches:
        for i, j in at.groups(batch.column(1)):
            texts = batch.column(1).slice(i, j - i)
            known = np.array([letters_in(t) for t in texts.to_pylist()])
            if model is None:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                names, score = decide(model, _margins(model, *at.text_buffer(texts)))
                names, score = [x if k else "und" for x, k in zip(names, known, strict=True)], np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text where nothing could be learned. With one language learned, it is the
    prediction for all texts with letters. Null ids are kept; other columns do not
    matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _predictions(b, shared), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
