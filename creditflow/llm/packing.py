"""Packing of token sequences by multiway differencing.

Documents are cut at multiples of the window, and a full piece is a sequence by
itself. One document in four also gives off four short pieces of its end, so that
differencing has small parts to even out the rest (padding below 1 per cent
instead of 3 to 4). The remainders are dealt into blocks of about ``BLOCK`` rows,
and each block is split into near-equal windows by Karmarkar-Karp differencing:
the two partial partitions with the largest spreads are merged so that the large
sums of one meet the small sums of the other, until one is left. If a window then
exceeds its capacity, the number of windows rises and the block is split anew.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import held, lean
from creditflow.llm.storage import small_batches, stored

if TYPE_CHECKING:  # only tasks that are given pandas frames load it
    import pandas as pd

WINDOW = 2048
#: Remainders in a block (expected; dealt by hash, so a block's size varies by a few per cent).
BLOCK = 1500
#: The last remainder of one text in CRUMB_EVERY ends in pieces of these lengths, which even out the windows.
CRUMBS, CRUMB_EVERY = (8, 16, 32, 64), 4
#: Words kept with their ids in each of two generations (about 70 MB in all), and the longest word kept.
CACHE_WORDS, LONG_WORD = 150_000, 64
#: Splits at these characters only here, not in the tokenizer; texts with one are encoded whole.
_TAIL = ".,;:!?|()[]{}<>\"#$%&*+-/=@\\^_`~"
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Ends a unit while it is merged; no unit that is merged here has it.
END = "\x00"


class Words(dict):
    """Ids of words, learned as they are asked for; two generations, so that words in use stay."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def word_merges(path: str):
    """(function from a unit and END to ranks, id bytes by rank) of a byte-level tokenizer file with word ends.

    Ranks are bytes, bytes with an end, and then the file's merges in their order. The
    function merges whichever neighbours give the token of lowest rank, which is the same
    if each token, spelt out, merges to itself: neighbours that make up a token but are no
    listed merge would then be what this token ends as. That is checked here.
    """
    import tiktoken
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable, byte_of = [*range(33, 127), *range(161, 173), *range(174, 256)], {}
    for byte in range(256):  # how a byte-level vocabulary writes bytes
        byte_of[chr(byte if byte in printable else 256 + len([b for b in range(byte) if b not in printable]))] = byte
    end = model["end_of_word_suffix"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    tokens = [*byte_of, *(c + end for c in byte_of), *(a + b for a, b in pairs)]
    mark = "\u2400"  # stands for an end, as a symbol of its own
    spelt = lambda t: t.removesuffix(end) + mark if t.endswith(end) else t
    vocab = {spelt(t): i for i, t in enumerate(tokens)} | {mark: len(tokens)}
    merge = models.BPE(vocab, [*((c, mark) for c in byte_of), *((spelt(a), spelt(b)) for a, b in pairs)]).tokenize
    if any(len(merge(t)) != 1 for t in vocab):
        raise ValueError(f"{path}: tokens do not follow from the merges")
    raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(end)) + (END.encode() if t.endswith(end) else b"")
    ranks = {raw(t): i for i, t in enumerate(tokens)}
    encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, [model["vocab"][t].to_bytes(4, "little") for t in tokens]


class WordEncoder:
    """Ids of whole texts, for a tokenizer whose tokens never cross white space.

    A text is cut at white space and walked once; the ids of each word are looked up
    or encoded, and together they are the ids of the whole text. A new word of
    letters with punctuation behind it is two units, which the tokenizer also
    keeps apart. Units of Latin letters, which are their own normal form but for
    case, are merged by themselves; other units and words take the tokenizer's whole
    route.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.written = word_merges(path)
        self.words, self.tails = Words(self._word), Words(self._unit)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii() and (max(unit) >= "\u0250" or "\u0130" in unit):
            return self._encode(unit)
        return b"".join(map(self.written.__getitem__, self.merge(unit.lower() + END))) if unit else b""

    def _word(self, word: str) -> bytes:
        head = word.rstrip(_TAIL)
        # a letter whose normal form ends in a mark would draw the punctuation to itself
        if head.isalpha() and (head.isascii() or unicodedata.normalize("NFC", head).lower()[-1].isalpha()):
            return self._unit(word) if len(head) == len(word) else self.words[head] + self.tails[word[len(head) :]]
        return self._encode(word) if head else self._unit(word)

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if any(c in text for c in _ODD_SPACE):
            return self._encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One for each Python worker: its words stay known from task to task."""
    return held(("encoder", path), lambda: WordEncoder(path))


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, separator: int, window: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    crumbs = sum(CRUMBS)
    end = np.array([separator], dtype="<u4").tobytes()
    for batch in batches:
        ids, starts, lengths, crcs, totals = [], [], [], [], []
        keys = batch.column(0).to_pylist()
        for i, j in at.groups(batch.column(1)):
            for id_, data in zip(keys[i:j], map(encode, batch.column(1).slice(i, j - i).to_pylist()), strict=True):
                data += end
                total = len(data) // 4
                cuts = list(range(0, total, window))
                if total % window > 4 * crumbs and zlib.crc32(data) % CRUMB_EVERY == 0:
                    cuts += sorted((total - np.cumsum(CRUMBS)).tolist())
                for a, b in zip(cuts, [*cuts[1:], total], strict=True):
                    ids.append(id_)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(data[4 * a : 4 * b]))
                    totals.append(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals)], ["id", "start", "length", "ids_crc32", "doc_tokens"])


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: sizes (positive) into k windows; each item's window and each window's sum."""
    n = len(sizes)
    parent = np.arange(n)
    if k <= 1:
        return np.zeros(n, dtype=np.int64), np.array([int(sizes.sum())])
    order = np.argsort(-sizes, kind="stable")
    # while it has empty windows, the largest partial partition takes in the next largest item: the first k at once
    top = order[:k]
    heap = [(-int(sizes[i]), int(i), sizes[[i]].astype(np.int64), np.array([i])) for i in order[k:]]
    heap.append((int((sizes[top[-1]] if len(top) == k else 0) - sizes[top[0]]), int(top[0]), sizes[top].astype(np.int64), top))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        p, q = len(a), len(b)
        if p + q <= k:
            sums, slots = np.concatenate([a, b]), np.concatenate([ia, ib])
        else:
            meet_a, meet_b = slice(k - q, p), slice(k - p, q)
            parent[ib[meet_b][::-1]] = ia[meet_a]
            sums = np.concatenate([a[: k - q], a[meet_a] + b[meet_b][::-1], b[: k - p]])
            slots = np.concatenate([ia, ib[: k - p]])
        by_sum = np.argsort(-sums, kind="stable")
        sums, slots = sums[by_sum], slots[by_sum]
        heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), tie, sums, slots))
    _, _, sums, slots = heap[0]
    while (up := parent[parent] != parent).any():
        parent[up] = parent[parent[up]]
    name = np.zeros(n, dtype=np.int64)
    name[slots] = np.arange(len(slots))
    return name[parent], sums


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item: as few windows as differencing can fill without passing the capacity."""
    total = int(sizes.sum())
    k = max(1, math.ceil(total / capacity))
    while True:
        name, sums = differencing(sizes, min(k, len(sizes)))
        if sums.max(initial=0) <= capacity or k >= len(sizes):
            return name
        k += max(1, math.ceil(k * (int(sums.max()) - capacity) / capacity / 4))


def _pack_block(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "id", "start", "row"], ascending=[False, True, True, True], kind="stable")
    name = windows_of(pdf["length"].to_numpy(), window)
    order = np.argsort(name, kind="stable")
    pdf, name = pdf.iloc[order], name[order]
    before = pdf["length"].cumsum() - pdf["length"]
    return pdf.assign(sequence_id=(pdf["block"].to_numpy(np.int64) << 21) | name, offset=before - before.groupby(name).transform("min")).drop(columns=["block", "row"])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's ids and then ``separator``. Sequences hold at most ``window`` ids.

    Defined cases: null and empty text have the separator only; a null id is
    kept; repeated rows are packed each; an empty table gives no row; other
    columns do not matter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(lambda b: _pieces(b, tokenizer_path, separator, window), "id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stored(pieces, "pieces").withColumn("row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", F.col("row") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rest = pieces.where(F.col("length") < window)
    blocks = max(1, math.ceil(rest.count() / BLOCK))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(lambda pdf: _pack_block(pdf, window), schema)
    return full.unionByName(packed).withColumnRenamed("id", id_col)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_differencing_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"))
