"""Token counts of sections, from one encoding of the whole document.

A document is encoded once; the byte length of each token gives its span, in
bytes and from there in characters. Sections are the document's lines, each with
its line break. Token spans and section spans are both sorted, so their interval
join is two searches. A token over a boundary goes to the section that holds most
of its characters, the earlier one on a tie (``RULE``); characters are counted by
the bytes that begin them.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean
from creditflow.llm.storage import small_batches

RULE = "most characters, then the earlier section"


@functools.cache
def encoding(path: str):
    """The encoder and each token's byte length; one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each section of UTF-8 bytes: first and last character (exclusive), tokens, tokens over a boundary given to it and taken from it."""
    begins = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])
    cut = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]])
    if len(cut) > 2 and cut[-2] == cut[-1]:
        cut = cut[:-1]
    low, high = chars[cut[:-1]], chars[cut[1:]]
    end = np.cumsum(sizes)
    start, stop = chars[end - sizes], chars[end]
    first = np.searchsorted(high, start, side="right")
    last = np.searchsorted(high, np.maximum(stop - 1, start), side="right")
    last, first = np.minimum(last, len(low) - 1), np.minimum(first, len(low) - 1)
    home = first.copy()
    over = np.flatnonzero(last > first)
    for t in over.tolist():
        spans = np.arange(first[t], last[t] + 1)
        share = np.minimum(high[spans], stop[t]) - np.maximum(low[spans], start[t])
        home[t] = spans[int(share.argmax())]
    n = len(low)
    given, taken = np.bincount(home[over], minlength=n), np.zeros(n, dtype=np.int64)
    for t in over.tolist():
        taken[first[t] : last[t] + 1] += 1
    return low, high, np.bincount(home, minlength=n), given, taken - given


@lean
def _sections(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder, lengths = encoding(path)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, j in at.groups(texts):
            rows, columns = [], []
            for r, text in enumerate(texts.slice(i, j - i).to_pylist(), i):
                if text:
                    tokens = np.array(encoder.encode_ordinary(text), dtype=np.int64)
                    columns.append(attribute(np.frombuffer(text.encode(), dtype=np.uint8), lengths[tokens]))
                else:
                    columns.append(tuple(np.zeros(1, dtype=np.int64) for _ in range(5)))
                rows.append(np.full(len(columns[-1][0]), r))
            if rows:
                section = np.concatenate([np.arange(len(x)) for x in rows])
                data = [np.concatenate(c).astype(np.int64) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), pa.array(section), *map(pa.array, data)], ["id", "section", "start", "end", "n_tokens", "n_given", "n_ceded"])


def attribute_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: id, section (from 0), start, end (characters), n_tokens, n_given and n_ceded (tokens over a boundary that fell to it, and that touch it but fell elsewhere).

    The sections of a document add up to its tokens. A null or empty text is one
    empty section; null ids are kept; repeated rows are counted each; other columns
    do not matter. A token that holds only a part of a character counts as starting
    at that character's end or within it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, section long, start long, end long, n_tokens long, n_given long, n_ceded long"
    return rows.mapInArrow(lambda b: _sections(b, tokenizer_path), schema).withColumnRenamed("id", id_col)


def op3_token_attribution(spark, sf_dir: str) -> DataFrame:
    from creditflow.llm.packing import public_tokenizer

    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("byte_bpe_50k.tiktoken"))
