"""Alignment of two tokenizers over the same texts.

Both encode space+text whole, so that every token covers a range of the same bytes.
The tokens of a batch are two sorted tables of starts, and pandas' merge_asof, keyed by
document, gives each start the covering token of the other side; the two directions
together are all overlaps. Where both sides end at one byte, a group ends.

How often an id pair is linked is counted over all documents: tasks sum the pairs of
their batches, and Spark sums these. A document keeps its distinct pairs and their
numbers, and looks the counts up: pairs that are frequent (``FREQUENT`` at most, an
exact bound) are broadcast, and only the rarer ones are joined by a shuffle,
where no pair has many rows.

For speed, texts are cut into *units* before single spaces and line breaks that stand
between two plain characters (``_PLAIN``: no white space, and known to every version of
Unicode). Neither tokenizer has a token across such a place, which is checked when
its vocabulary is read; ids of units are kept, and all other stretches are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import held, lean
from creditflow.llm.storage import shared_dir, small_batches, stored

#: Pairs whose counts may be broadcast (17 bytes each).
FREQUENT = 2_000_000
#: Units kept in each of two generations, and the longest one kept.
CACHE_UNITS, LONG_UNIT = 120_000, 64
#: Distinct pairs that a task gathers before it sends them on.
GATHERED = 1_000_000
#: Ids are below this.
ID = 1 << 20
_PLAIN = "!-~¡-¬®-ɏ"
_CUT = re.compile(f"(?<=[{_PLAIN}])(?=[ \n][{_PLAIN}])")

DOC = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PASS = f"{DOC}, pairs array<long>, numbers array<long>, summed boolean"


def byte_level_encoding(path: str):
    """(encoder, bytes of each id) of a byte-level tokenizer file, special tokens left out.

    The encoder merges whichever neighbours give the token of lowest id; the file lists
    merges in order. That is the same if ids rise with the merges, and if each token, spelt
    out in bytes, merges to itself: neighbours that make up a token but are no listed merge
    would then be what this token's bytes end as. Both are checked here.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable, value = [*range(33, 127), *range(161, 173), *range(174, 256)], {}
    for byte in range(256):  # how a byte-level vocabulary writes bytes
        value[chr(byte if byte in printable else 256 + len([b for b in range(byte) if b not in printable]))] = byte
    vocab = {t: i for t, i in model["vocab"].items() if all(c in value for c in t)}
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    merge = Tokenizer.from_file(path).model.tokenize
    if any(i >= j for i, j in pairwise(merged)) or any(len(merge(t)) != 1 for t in vocab if not t.startswith("<|")):
        raise ValueError(f"{path}: ids do not follow from the merges")
    ranks = {bytes(value[c] for c in t): i for t, i in vocab.items() if not t.startswith("<|")}
    written = [b""] * (max(model["vocab"].values()) + 1)
    for raw, i in ranks.items():
        written[i] = raw
    return tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), written


class Aligner:
    """Both encoders; ids of units are kept in two generations, so that units in use stay."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a, self.bytes_a = byte_level_encoding(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        written = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(written)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        if max(len(written), len(self.bytes_a)) > ID:
            raise ValueError(f"ids of {ID} and more are not supported")
        self.space = self.b.piece_to_id("▁")
        #: Pieces that hold a space or line break behind another character would reach over a cut.
        self.cuts = not any(re.search("[^▁ \n][▁ \n]", p) for p in written)
        #: Written ids; behind each, what separates it from the next.
        self.text = np.array([f"{i}{mark}" for marks, n in ((",|", len(self.bytes_a)), (",;", len(written))) for i in range(n) for mark in marks], dtype="S8")
        #: Ids of units as little-endian 32-bit numbers, for A and B, in the newer and the older generation.
        self.new: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: Units whose tokens do not give back their bytes.
        self.unsound: set[str] = set()

    def _learn(self, units: list[str]) -> None:
        """Ids of units, each with the space or line break in front of it."""
        ids_a = list(map(self.a.encode_ordinary, units))
        inner = [i for i, u in enumerate(units) if u[0] != " "]
        given = units if len(inner) == len(units) else [u[1:] if u[0] == " " else u for u in units]
        ids_b = self.b.encode(given, num_threads=1)
        for i in inner:  # the space that B adds is not there inside a text
            ids_b[i] = ids_b[i][1:] if ids_b[i][:1] == [self.space] else []
        raw = "".join(units).encode()
        for known, ids, written in zip(self.new, (ids_a, ids_b), (self.bytes_a, self.bytes_b), strict=True):
            flat = np.fromiter(chain.from_iterable(ids), dtype="<u4")
            if b"".join(map(written.__getitem__, flat.tolist())) != raw:
                self.unsound.update(u for u, x in zip(units, ids, strict=True) if b"".join(map(written.__getitem__, x)) != u.encode())
            data, ends = flat.tobytes(), [0, *accumulate([4 * len(x) for x in ids])]
            known.update(zip(units, [data[i:j] for i, j in pairwise(ends)], strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where the bytes are not given back, or the text is null or empty."""
        cut = [((_CUT.split(" " + t) if self.cuts else [" " + t]) if t else []) for t in texts]
        unknown = set().union(*cut).difference(self.new[0])
        for unit in unknown.intersection(self.old[0]):
            unknown.discard(unit)
            for new, old in zip(self.new, self.old, strict=True):
                new[unit] = old[unit]
        if unknown:
            self._learn(list(unknown))
        out, none = [], np.zeros(0, dtype=np.int64)
        for units in cut:
            if units and (not self.unsound or self.unsound.isdisjoint(units)):
                out.append(tuple(np.frombuffer(b"".join(map(known.__getitem__, units)), dtype="<u4").astype(np.int64) for known in self.new))
            else:
                out.append((none, none))
        for unit in [u for u in unknown if len(u) > LONG_UNIT]:
            self.unsound.discard(unit)
            for known in self.new:
                del known[unit]
        if len(self.new[0]) > CACHE_UNITS:
            self.unsound.difference_update(self.old[0].keys() - self.new[0].keys())
            self.old, self.new = self.new, ({}, {})
        return out


def overlaps(start_a: np.ndarray, doc_a: np.ndarray, start_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of tokens by their numbers in either table, and which A tokens start where a B token does.

    Starts ascend over the documents of a batch, and each document's first tokens start together.
    """
    a = pd.DataFrame({"start": start_a, "doc": doc_a, "a": np.arange(len(start_a))}, copy=False)
    b = pd.DataFrame({"start": start_b, "doc": doc_b, "b": np.arange(len(start_b))}, copy=False)
    b_of_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy()
    a_of_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy()
    both = start_b[b_of_a] == start_a
    more = np.flatnonzero(start_a[a_of_b] != start_b)  # equal starts were found from A
    return np.concatenate([np.arange(len(start_a)), a_of_b[more]]), np.concatenate([b_of_a, more]), both


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(pairs, return_counts=True)


def _group_hashes(aligner: Aligner, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: np.ndarray) -> list[str]:
    """For documents of n tokens each: the hash of all ids as written, in the order of groups, A before B; the last of a side has the separator that follows."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    codes = np.concatenate([2 * a + last_a, 2 * (len(aligner.bytes_a) + b) + last_b])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    written = aligner.text[codes[order]].view(np.uint8)
    kept = written != 0
    ends = np.concatenate([[0], np.cumsum(kept.reshape(-1, 8).sum(1))])[np.concatenate([[0], np.cumsum(n)])]
    data = written[kept].tobytes()
    return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in pairwise(ends.tolist())]


@lean
def _align(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (summed) with the pairs of all of the task's documents."""
    aligner = held(("aligner", byte_level, pieces), lambda: Aligner(byte_level, pieces))
    row = TaskContext.get().partitionId() << 40
    none = np.zeros(0, dtype=np.int64)
    summed, gathered = [], 0

    def task_pairs() -> pa.RecordBatch:
        pairs, numbers = (np.concatenate([none, *(s[k] for s in summed)]) for k in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs, numbers = pairs[order], numbers[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else none
        columns = [[pairs[first]], [np.add.reduceat(numbers, first) if len(first) else none]]
        empty = [pa.nulls(1, t) for t in (*[pa.int64()] * 6, pa.string())]
        return pa.RecordBatch.from_arrays([*empty, *(pa.array(c, pa.list_(pa.int64())) for c in columns), pa.array([True])], names)

    names = [c.split()[0] for c in PASS.replace("array<long>", "x").split(", ")]
    for batch in batches:
        for i, j in at.groups(batch.column(1)):
            found = aligner.encode(batch.column(1).slice(i, j - i).to_pylist())
            n_a, n_b = (np.array([len(f[k]) for f in found], dtype=np.int64) for k in (0, 1))
            a, b = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
            doc_a, doc_b = np.repeat(np.arange(len(found)), n_a), np.repeat(np.arange(len(found)), n_b)
            size_a, size_b = aligner.sizes_a[a], aligner.sizes_b[b]
            start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            link_a, link_b, both = overlaps(start_a, doc_a, start_b, doc_b)
            group_a = np.cumsum(both) - 1  # a group starts where both sides do, which is where the one before ended
            group_b = group_a[np.searchsorted(start_a, start_b, side="right") - 1] if len(b) else none
            hashes = _group_hashes(aligner, a, b, group_a, group_b, n_a + n_b) if len(a) else [""] * len(found)
            n_links, n_groups = np.bincount(doc_a[link_a], minlength=len(found)), np.bincount(doc_a[both], minlength=len(found))
            keyed, numbers = _distinct((doc_a[link_a] * ID + a[link_a]) * ID + b[link_b])
            pairs, ends = keyed % (ID * ID), np.searchsorted(keyed // (ID * ID), np.arange(len(found) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pairs, numbers)]
            rows = [np.arange(row, row + len(found)), batch.column(0).slice(i, j - i), n_a, n_b, n_groups, n_links, hashes]
            row += len(found)
            yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in rows), *lists, pa.array(np.zeros(len(found), dtype=bool))], names)
            order = np.argsort(pairs, kind="stable")
            first = np.flatnonzero(np.append(True, pairs[order][1:] != pairs[order][:-1])) if len(pairs) else none
            summed.append((pairs[order][first], np.add.reduceat(numbers[order], first) if len(first) else none))
            gathered += len(first)
            if gathered > GATHERED:
                yield task_pairs()
                summed, gathered = [], 0
    yield task_pairs()


@lean
def _resolve(batches: Iterator[pa.RecordBatch], shared, rest: bool) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs that were broadcast; with rest, the others are kept for a join."""
    table, counts, best = shared.value
    for batch in batches:
        pairs, numbers = (batch.column(k).flatten().to_numpy() for k in (7, 8))
        ends = np.concatenate([[0], np.cumsum(batch.column(7).value_lengths().to_numpy())])
        at_ = np.minimum(np.searchsorted(table, pairs), max(0, len(table) - 1))
        hit = table[at_] == pairs if len(table) else np.zeros(len(pairs), dtype=bool)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(hit & best[at_], numbers, 0) if len(table) else numbers * 0, np.where(hit, numbers * counts[at_], 0) if len(table) else numbers * 0)]
        columns = [*batch.columns[:7], *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)]
        if rest:
            left = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (pairs, numbers)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:7], "n_best", "count_sum", *(["pairs", "numbers"] if rest else [])])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over the summed rows of all tasks: how often an id pair is linked, and whether its B id has no more frequent pair."""
    each = aligned.where("summed").select(F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select("p.*")
    total = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("numbers").alias("n")), "pairs")
    most = total.groupBy((F.col("pair") % ID).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B
    return stored(total.join(F.broadcast(most), F.col("pair") % ID == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, byte_level: str, pieces: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, counts): id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row; and each pair's links.

    A pair is a * 2**20 + b. Special tokens' strings in a text are plain text.

    Defined cases: a text that is null, empty, or not given back by the tokens of
    both sides (a literal U+2581, for one) has no tokens, hence zeros and an empty
    hash; null ids are kept; repeated rows count each; an empty table gives
    no row; other columns do not matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda b: _align(b, byte_level, pieces), PASS).write.partitionBy("summed").option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(PASS).parquet(path)
    counts = pair_counts(aligned)
    least, within = 1, counts.count()
    if within > frequent:
        by_size = dict(counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect())  # 64 rows at most
        for k in sorted(by_size):
            within -= by_size[k]
            least = 1 << (k + 1)
            if within <= frequent:
                break
    table = counts.where(F.col("n") >= least).orderBy("pair").toPandas()  # frequent rows at most
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    listed = aligned.where("not summed").drop("summed")
    out = f"{DOC}, n_best long, count_sum long"
    if least == 1:
        found = listed.mapInArrow(lambda b: _resolve(b, shared, False), out)
    else:
        part = stored(listed.mapInArrow(lambda b: _resolve(b, shared, True), f"{out}, pairs array<long>, numbers array<long>"), "resolved")
        rare = part.select("row", F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.numbers").alias("number"))
        more = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("number")).otherwise(0)).alias("more_best"), F.sum(F.col("number") * F.col("n")).alias("more_sum"))
        found = part.drop("pairs", "numbers").join(more, "row", "left")
        found = found.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    from creditflow.llm.packing import public_tokenizer

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))[0]
