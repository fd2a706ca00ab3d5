"""Benchmark decontamination under edit distance.

An item leaks into a document if a run of the document's words is within
``floor((1 - threshold) * n)`` word edits of the item's n words. Words are runs of
ASCII letters and digits (any case) and of bytes above ASCII.

How it runs
-----------
Items are the stated query set: blocks of ``ITEM_BLOCK`` are collected, embedded
and broadcast one after the other, and every document is read against each block
where it lies; no document is shuffled.

1. A random walk (CGK) reads words from a place on: at each step it writes the word
   it stands on, and moves on or stays by a random bit of step and word. Strings a few
   edits apart fall into step again, so that edits become differing positions.
2. A repetition has its own bits and samples positions of the walk, the first
   always. Walks from every word of an item (a window of it that is shifted, as edits
   before it may have made it) are indexed by their sampled words; a walk that has left
   the item has none. The walks of windows from every word of a document are looked up
   there: this alone gives the candidates.
3. Repetitions are added until copies of all items at the greatest allowed distance
   (with random changes, insertions and deletions) share one with ``recall``.
4. Candidates are verified by the exact edit distance of the item to the nearest
   run of words around the windows.

Defined cases: null texts and texts without words match nothing; an item that is
null or has fewer than ``MIN_WORDS`` words, of which one edit is more than a fifth,
matches nothing; rows with a null id are reported with it; repeated rows are
reported each; other columns do not matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean, release
from creditflow.llm.storage import small_batches, stored

_U = np.uint64
ITEM_BLOCK = 5_000
MIN_WORDS = 5
#: Copies that measure the recall, and repetitions after which it counts as out of reach.
TRIALS, MOST_REPETITIONS = 20_000, 200
#: Sampled positions behind the first, for items from and below these sizes.
SAMPLES = ((2, 0, 10), (3, 10, 1 << 62))
#: Walks whose samples come together by chance at one word in this many are looked up whatever else an item has.
COMMON = 1e-8
_SEEN = 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _words(texts: pa.Array) -> at.Words:
    return at.words_of(*at.text_buffer(texts), fold=_FOLD, second=False)


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of word edits from the item to any run of the text."""
    span = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != _U(word)))
        row = np.minimum.accumulate(new - span) + span
    return int(row.min())


def _marks(places: np.ndarray) -> np.ndarray:
    """A table of 2 ** _SEEN flags; made where it is used, not sent."""
    out = np.zeros(1 << _SEEN, dtype=bool)
    out[places] = True
    return out


def _edited(words: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """A copy with k random edits."""
    copy = words.tolist()
    for kind in draw.integers(0, 3, k).tolist():
        at_, new = int(draw.integers(0, max(1, len(copy)))), int(draw.integers(1, 1 << 62))
        if kind == 0:
            copy.insert(at_, new)
        elif kind == 1 and len(copy) > 1:
            del copy[at_]
        else:
            copy[at_ : at_ + 1] = [new]
    return np.array(copy, dtype=_U)


class Repetition:
    """One draw of walk bits and of sampled positions behind the first; and the items' walks by their sampled words."""

    def __init__(self, number: int, samples: int):
        draw = np.random.default_rng((7, number))
        self.seed = _U(draw.integers(1, 1 << 62))
        self.gaps = draw.integers(1, 4, samples).tolist()

    def walks(self, words: np.ndarray, end: np.ndarray, place: np.ndarray, wanted=None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places of walks that stay below ``end``, where each of their samples stands); wanted: drops walks by the key of the first two."""
        bits = at.mix(words ^ self.seed)
        at_, step = [place], 0
        for k, gap in enumerate(self.gaps):
            now = at_[-1]
            for j in range(step, step + gap):
                now = now + ((bits[now] >> _U(j)) & _U(1)).astype(np.int64)
                inside = now < end[at_[0]]
                if not inside.all():
                    now, at_ = now[inside], [x[inside] for x in at_]
            step += gap
            at_.append(now)
            if k == 0 and wanted is not None:
                some = wanted(self.key(words, at_))
                at_ = [x[some] for x in at_]
        return at_[0], at_

    @staticmethod
    def key(words: np.ndarray, samples: list[np.ndarray]) -> np.ndarray:
        out = words[samples[0]]
        for x in samples[1:]:
            out = at.mix(out * _U(3) + words[x])
        return out

    def index(self, words: np.ndarray, first: np.ndarray, share: np.ndarray) -> None:
        """Keeps the walks from all words of the items, but those of common words only: of these the least common third of an item's.

        share: each word's share of all words of the items.
        """
        place, samples = self.walks(words, np.repeat(first[1:], np.diff(first)), np.arange(len(words)))
        chance = share[samples[0]]
        for x, y in zip(samples, samples[1:]):  # a walk that stays where it is says nothing new
            chance = chance * np.where(x == y, 1.0, share[y])
        item = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((chance, item))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        stay = (chance <= COMMON) | (rank < np.diff(first)[item] // 3)
        samples = [x[stay] for x in samples]
        key = self.key(words, samples)
        order = np.argsort(key, kind="stable")
        self.indexed, self.place = key[order], samples[0][order]
        self.halves = np.unique(self.key(words, samples[:2]) >> _U(64 - _SEEN))

    @functools.cached_property
    def seen(self) -> np.ndarray:
        return _marks(self.halves)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def meets(self, words: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in words, place in the items) of walks with the same samples."""
        place, samples = self.walks(words, end, place, lambda half: np.flatnonzero(self.seen[half >> _U(64 - _SEEN)]))
        key = self.key(words, samples)
        low, high = np.searchsorted(self.indexed, key, "left"), np.searchsorted(self.indexed, key, "right")
        times = high - low
        return np.repeat(place, times), self.place[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]


def item_groups(ids: list, texts: list[str], threshold: float, recall: float) -> list[Items]:
    """Short items by few samples, so that an edit leaves them walks; longer ones by more, so that common words are no candidates."""
    words = _words(pa.array(texts, pa.string()))
    items = [(i, words.h1[a:b].copy()) for i, a, b in zip(ids, words.first[:-1], words.first[1:], strict=True) if b - a >= MIN_WORDS]
    groups = [(samples, [x for x in items if low <= len(x[1]) < high]) for samples, low, high in SAMPLES]
    return [Items(own, threshold, recall, samples) for samples, own in groups if own]


class Items:
    """Items of sizes that share a number of samples, ready to be found."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float, recall: float, samples: int):
        self.items, self.samples = items, samples
        self.allowed = np.array([int(math.floor((1 - threshold) * len(w) + 1e-9)) for _, w in self.items], dtype=np.int64)
        self.words = np.concatenate([np.zeros(0, _U), *(w for _, w in self.items)])
        self.first = np.concatenate([[0], np.cumsum([len(w) for _, w in self.items])]).astype(np.int64)
        self.item_of = np.repeat(np.arange(len(self.items)), np.diff(self.first))
        self.repetitions = self._repetitions(recall) if self.items else []

    @functools.cached_property
    def known(self) -> np.ndarray:
        return _marks(self.words >> _U(64 - _SEEN))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def _repetitions(self, recall: float) -> list[Repetition]:
        """As many as find ``recall`` of edited copies of all items."""
        _, place, times = np.unique(self.words, return_inverse=True, return_counts=True)
        share = (times / len(self.words))[place]
        draw, copies, of = np.random.default_rng(11), [], []
        for _ in range(math.ceil(TRIALS / len(self.items))):
            for k, (_, w) in enumerate(self.items):
                copies.append(_edited(w, int(self.allowed[k]), draw))
                of.append(k)
        first = np.concatenate([[0], np.cumsum([len(c) for c in copies])])
        words, end, copy = np.concatenate(copies), np.repeat(first[1:], np.diff(first)), np.repeat(np.arange(len(copies)), np.diff(first))
        found, out = np.zeros(len(copies), dtype=bool), []
        while found.mean() < recall:
            if len(out) == MOST_REPETITIONS:
                raise ValueError(f"{recall} of copies at this threshold are not found by {MOST_REPETITIONS} repetitions")
            out.append(Repetition(len(out), self.samples))
            out[-1].index(self.words, self.first, share)
            mine, theirs = out[-1].meets(words, end, np.arange(len(words)))
            found[copy[mine[np.array(of)[copy[mine]] == self.item_of[theirs]]]] = True
        return out

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, distance) of all leaks into rows of word hashes."""
        if not self.items or not len(words):
            return
        end, place = np.repeat(first[1:], np.diff(first)), np.flatnonzero(self.known[words >> _U(64 - _SEEN)])
        found = []
        for repetition in self.repetitions:
            mine, theirs = repetition.meets(words, end, place)
            item = self.item_of[theirs]
            found.append(np.stack([np.searchsorted(first, mine, "right") - 1, item, mine - (theirs - self.first[item])]))
        row, item, start = np.unique(np.concatenate(found, axis=1), axis=1)
        if not len(row):
            return
        new = np.ones(len(row), dtype=bool)  # starts that edits may have moved apart are one run
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > 2 * self.allowed[item[1:]])
        begin = np.flatnonzero(new)
        best: dict[tuple[int, int], int] = {}
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist(), strict=True):
            r, k = int(row[a]), int(item[a])
            if best.get((r, k), 1) > 0:
                slack, w = int(self.allowed[k]), self.items[k][1]
                run = words[max(first[r], start[a] - slack) : min(first[r + 1], start[b - 1] + len(w) + slack)]
                if np.isin(w, run).sum() < len(w) - slack:  # each word that is not there is an edit
                    continue
                d = distance(w, run)
                if d <= slack:
                    best[r, k] = min(d, best.get((r, k), d))
        for (r, k), d in best.items():
            yield r, k, d


@lean
def _find(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ids, out = batch.column(0), []
        for i, j in at.groups(batch.column(1)):
            words = _words(batch.column(1).slice(i, j - i))
            for items in shared.value:
                out += [(ids[i + r].as_py(), items.items[k][0], d) for r, k, d in items.find(words.h1, words.first)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item_id", "distance"])


def _item_blocks(benchmark: DataFrame, threshold: float, recall: float, item_id: str, item_text: str) -> Iterator[tuple]:
    """The items as broadcast variables of about ITEM_BLOCK rows, one at a time, and whether there are more than one."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        shared = benchmark.sparkSession.sparkContext.broadcast(item_groups([r.i for r in block], [r.t for r in block], threshold, recall))
        yield shared, blocks > 1
        if blocks > 1:
            shared.unpersist()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and item that leaks into it: id, item_id, distance (word edits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    out = None
    for shared, several in _item_blocks(benchmark, threshold, recall, item_id, item_text):
        found = rows.mapInArrow(lambda x, s=shared: _find(x, s), "id long, item_id long, distance long")
        found = stored(found, "leaks") if several else found
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


@lean
def _clean_rows(batches: Iterator[pa.RecordBatch], shared, column: str) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        keep = np.ones(batch.num_rows, dtype=bool)
        for i, j in at.groups(texts):
            words = _words(texts.slice(i, j - i))
            for items in shared.value:
                keep[[i + r for r, _, _ in items.find(words.h1, words.first)]] = False
        yield batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, recall: float = 0.9999, text_col: str = "text") -> DataFrame:
    """docs without the rows into which an item leaks, whatever their ids; one pass for each block of items."""
    for shared, several in _item_blocks(benchmark, threshold, recall, "item_id", "text"):
        left = docs.mapInArrow(lambda b, s=shared: _clean_rows(b, s, text_col), docs.schema)
        docs = stored(left, "clean") if several else left
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "distance")
