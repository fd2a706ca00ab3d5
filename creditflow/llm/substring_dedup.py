"""Exact substring deduplication by hashes of fixed-length word windows.

``substring_dedup(docs)`` removes each word that lies in a window of ``window``
consecutive words whose word sequence also starts in a row with a smaller id.

How it runs
-----------
1. Every window has a Rabin-Karp hash, and an *anchor*: the least hash of the
   ``GRAM``-word runs inside it. Equal windows have equal anchors, and neighbours
   mostly share one, so the distinct anchors of a row are few (about one for 18
   words). Anchors are counted in Spark first; a window whose anchor occurs in
   one row only cannot repeat, and is not shuffled.
2. The other windows are counted by their 128-bit hash: least id per hash
   (combined before the shuffle, so a passage in a third of all rows costs one
   record a task), then joined back to those with a larger id.
3. Start positions are gathered per row (bounded by the row's length), merged
   to maximal intervals, and cut from the text.

Rows whose whole text equals that of a row with a smaller id are set aside first:
all their windows repeat, so none is hashed. The texts are shuffled once, for step
3; for step 2 they are only if the anchors that repeat are too many to broadcast.

Defined cases: null text has no words; rows with a null id are returned
unchanged and are never a source; rows with the same id do not remove each
other; a row with fewer words than the window loses none; other columns of the
input do not matter. Rows of one id with different texts are told apart by a hash
of the text, and each is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean, release
from creditflow.llm.storage import BROADCAST_ROWS, broadcast_if_small, small_batches, stored

GRAM = 16
_BASE_GRAM, _BASE_1, _BASE_2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def _anchors_of(words: at.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, and which windows lie within one row."""
    gram = min(GRAM, window)
    least = at.sliding_min(at.rolling(words.h1, gram, _BASE_GRAM), window - gram + 1)
    return at.signed(least), at.inside(words.first, window, len(words.h1))


@lean
def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ids, tags, texts = batch.columns
        for i, j in at.groups(texts):
            words = at.words_of(*at.text_buffer(texts.slice(i, j - i)))
            least, ok = _anchors_of(words, window)
            at_ = np.flatnonzero(ok)
            if not len(at_):
                continue
            row, value = words.row[at_], least[at_]
            new = np.ones(len(at_), dtype=bool)  # runs of one value; the few later repeats do no harm
            new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            rows = pa.array(row[new] + i)
            yield pa.RecordBatch.from_arrays([ids.take(rows), tags.take(rows), pa.array(value[new])], ["id", "tag", "anchor"])


@lean
def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags, texts, wanted = batch.columns
        for i, j in at.groups(texts):
            words = at.words_of(*at.text_buffer(texts.slice(i, j - i)))
            least, ok = _anchors_of(words, window)
            known = np.unique(wanted.slice(i, j - i).flatten().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(known, least), len(known) - 1)
            at_ = np.flatnonzero(ok & (known[place] == least))
            row = words.row[at_]
            h1, h2 = at.rolling(words.h1, window, _BASE_1)[at_], at.rolling(words.h2, window, _BASE_2)[at_]
            rows = pa.array(row + i)
            place = ((at_ - words.first[row]) << 32) | (tags.take(rows).to_numpy().astype(np.int64) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(place), pa.array(at.signed(h1)), pa.array(at.signed(h2))], ["id", "at", "h1", "h2"])


@lean
def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, cuts, copied = batch.columns
        n_words, n_removed, kept = [], [], []
        for text, starts, whole in zip(texts, cuts, copied.to_pylist(), strict=True):
            raw = text.as_py()
            parts = raw.encode().split() if raw else []  # bytes.split cuts at 0x20 and 0x09-0x0D
            n_words.append(len(parts))
            if whole and len(parts) >= window:
                parts = []
            elif starts.is_valid:
                edge = np.zeros(len(parts) + 1, dtype=np.int32)
                begin = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                parts = [parts[k] for k in np.flatnonzero(stay)]
            n_removed.append(n_words[-1] - len(parts))
            kept.append(b" ".join(parts).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def _later_copies(rows: DataFrame) -> DataFrame:
    """(id, tag) of rows whose text also stands in a row with a smaller id (stored)."""
    named = rows.where("text is not null").select("id", "tag", F.unhex(F.sha2("text", 256)).alias("address"))
    first = named.groupBy("address").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("address", "lo")
    return stored(named.join(broadcast_if_small(stored(first, "firsts")), "address").where("id > lo").select("id", "tag").distinct(), "copies")


def removal_starts(rows: DataFrame, copies: DataFrame, window: int = 50) -> DataFrame:
    """rows (id, tag, text; no null id) -> id, tag, starts: the word positions at which a repeated window starts.

    copies: rows (id, tag) to leave out, as all of their windows repeat. What many rows
    hold is reduced to one record a task before it is shuffled, and is stored, so
    that Spark may split the rows of a frequent hash when they are joined to it.
    """
    known = rows.where("text is not null").join(copies, ["id", "tag"], "left_anti")
    anchors = known.mapInArrow(lambda b: _anchors(b, window), "id long, tag int, anchor long")
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor", "lo")
    shared = broadcast_if_small(stored(shared, "shared"))
    wanted = anchors.join(shared, "anchor").groupBy("id", "tag").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("id") > F.col("lo"), F.col("anchor"))).alias("later"))
    wanted = stored(wanted, "anchors")
    total = wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0
    wanted = F.broadcast(wanted) if total <= 4 * BROADCAST_ROWS else wanted  # 8 bytes each
    texts = rows.join(wanted, ["id", "tag"])
    schema = "id long, at long, h1 long, h2 long"
    windows = texts.select("id", "tag", "text", "anchors").mapInArrow(lambda b: _windows(b, window), schema)
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    least = broadcast_if_small(stored(least, "windows"))
    repeats = texts.where(F.size("later") > 0).select("id", "tag", "text", "later").mapInArrow(lambda b: _windows(b, window), schema)
    found = repeats.join(least, ["h1", "h2"]).where("id > lo")
    return found.groupBy("id", F.shiftright(F.shiftleft("at", 32), 32).cast("int").alias("tag")).agg(F.collect_set(F.shiftright("at", 32).cast("int")).alias("starts"))


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words joined by one space)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    known = rows.where("id is not null")
    copies = broadcast_if_small(_later_copies(known))
    cut = known.join(removal_starts(known, copies, window), ["id", "tag"], "left").join(copies.withColumn("copied", F.lit(True)), ["id", "tag"], "left").select("id", "text", "starts", "copied")
    cut = cut.unionByName(rows.where("id is null").select("id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("boolean").alias("copied")))
    return cut.mapInArrow(lambda b: _cut(b, window), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, ws FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
r AS (SELECT DISTINCT g.doc_id, q FROM g JOIN m USING (h), unnest(range(g.p, g.p + 50)) AS t(q) WHERE g.doc_id > m.lo),
d AS (SELECT doc_id, list(q) AS cut FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN cut IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(cut, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN d USING (doc_id)
"""
