"""Line deduplication by an exact set-similarity join.

A line is the set of its words. ``line_dedup`` removes every line for which an
earlier line (smaller id, or same id and smaller number) has a Jaccard similarity
of ``threshold`` or more; lines are judged on the input, not on what is left.

How it runs
-----------
1. One scan gives every line's place and the 128-bit key of its set, and counts
   words. Lines with equal sets are merged: the first stays, the others are decided.
2. Words are ordered by rarity: the FREQUENT most common get a rank (a table of
   bounded size, broadcast); all others are rarer and follow their hash. Any fixed
   order gives exact results; this one keeps lists short.
3. Each first line sends its prefix (the n - ceil(t n) + 1 rarest words) to the
   lists of these words, with its size, the position and a 128-bit parity sketch of
   its set. A word held by more than ``hot`` lines has no list of its own: lines
   that share it must share a second word of a prefix one longer, so the pair of
   words is the list. A word of one line only has no list: a broadcast table of bits
   by hash (of bounded size) marks the words that occur again and have no rank.
4. Lists are sorted by size and read as a stream, so that a line meets only those
   within the length bound; positional and sketch bounds (the parity of two sets
   differs in at most |A xor B| bits) drop pairs that cannot reach the threshold.
   Of each line the NEAREST candidates of every list go on, and lists that
   have more are kept. Where more than ``long`` lines are within the bound, a line
   meets only the first PILOTS lines of its size and the PILOTS lines just before it,
   and the list is kept too: of many lines made from one template nearly all are
   decided by these.
5. Pairs are verified on the full sets.
6. Lines still undecided meet all lines of the lists that were kept. Long lists are
   dealt into blocks: BLOCK undecided lines meet BLOCK lines of the list in a task.

Defined cases: a null text has no line and stays null; a line without words is
kept and removes nothing; rows with a null id are returned unchanged; lines of
rows with equal id and equal number do not remove each other; rows with equal id
and different texts are told apart by a hash of the text; equal rows are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.llm import arrow_text as at
from creditflow.llm.held import lean, release
from creditflow.llm.storage import BROADCAST_ROWS, broadcast_if_small, small_batches, stored

_U = np.uint64
#: Words that get a rank by count: 12 bytes each, so 12 MB at most.
FREQUENT = 1_000_000
#: Bits, as a power of two, that mark the other words of more than one line: 8 MB. A bit that words share costs list entries only.
AGAIN = 26
#: Lines that may share a word before its list is split by second words.
HOT = 100_000
#: Candidates of a line that leave each list at once.
NEAREST = 2
#: Lines within the length bound from which a line meets pilots only at first, and pilots at either end.
LONG, PILOTS = 8_192, 64
#: Lines on either side of a block.
BLOCK = 20_000
#: Sizes and positions from here on are not told apart.
_MOST = 0x7FFF
#: Words that the scan counts before it sends them on; rows of lists, and pairs, that are compared at once.
_COUNTED, _ROWS, _PAIRS = 1 << 19, 1 << 17, 1 << 20


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of rows: the first row, each line's row and number, distinct word hashes and their lines, and where each line's begin."""
    for i, j in at.groups(texts):
        raw, offsets = at.text_buffer(texts.slice(i, j - i))
        breaks = np.flatnonzero(raw == 10) + 1
        n = np.searchsorted(breaks, offsets[1:], side="right") - np.searchsorted(breaks, offsets[:-1], side="right")
        row = np.repeat(np.arange(j - i), n + 1)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        number = np.arange(len(row)) - first[row]
        begin = np.where(number == 0, offsets[row], 0)
        inner = number > 0
        begin[inner] = breaks[np.searchsorted(breaks, offsets[:-1], side="right")[row[inner]] + number[inner] - 1]
        words = at.words_of(raw, np.append(begin, len(raw)), second=False)
        edge, h = words.first, words.h1.copy()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                h[a:b].sort()
        line = words.row
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        yield i, row, number, h, line, np.searchsorted(line, np.arange(len(row) + 1))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return run[first[1:]] - run[first[:-1]]


def _places(batch: pa.RecordBatch, i: int, row: np.ndarray, number: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Ids of lines, and number << 32 | tag of the text."""
    rows = pa.array(row + i)
    return batch.column(0).take(rows), (number.astype(np.int64) << 32) | (batch.column(1).take(rows).to_numpy().astype(np.int64) & 0xFFFFFFFF)


class _Counts:
    """Sums of word counts, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.merged = 0

    def add(self, words: np.ndarray) -> None:
        self.parts.append(np.unique(words, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * self.merged + _COUNTED // 2:
            self.merge()

    def merge(self) -> None:
        word, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        self.parts = [(word, np.bincount(place, weights=np.concatenate([p[1] for p in self.parts]), minlength=len(word)).astype(np.int64))]
        self.size = self.merged = len(word)

    def take(self) -> pa.RecordBatch:
        self.merge()
        (word, n), none = self.parts[0], pa.nulls(self.size, pa.int64())
        self.__init__()
        return pa.RecordBatch.from_arrays([none, none, pa.array(at.signed(word)), pa.array(n)], ["id", "at", "a", "b"])


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with words (id, at, both halves of the set's key) and, without id, words (hash, count of lines)."""
    release()
    counts = _Counts()
    for batch in batches:
        for i, row, number, h, _, first in _sets(batch.column(2)):
            some = np.flatnonzero(np.diff(first) > 0)
            k1, k2 = _sum_by(at.mix(h), first), _sum_by(at.mix(h ^ _U(0x5851F42D4C957F2D)), first)
            ids, place = _places(batch, i, row[some], number[some])
            yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(at.signed(k1[some])), pa.array(at.signed(k2[some]))], ["id", "at", "a", "b"])
            counts.add(h)
            if counts.merged > _COUNTED:
                yield counts.take()
    if counts.parts:
        yield counts.take()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(batch.column(k).to_numpy(zero_copy_only=False)).tobytes()], pa.binary()) for k in (0, 1)], ["words", "counts"])


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _marked(flags: pa.Array, i: int, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which lines are set in their row's flags (null, or too short: not set)."""
    flags = flags.slice(i, int(row[-1]) + 1)
    size = pc.fill_null(pc.list_value_length(flags), 0).to_numpy().astype(np.int64)
    start, values = np.cumsum(size) - size, flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
    inside = number < size[row]
    out = np.zeros(len(row), dtype=bool)
    out[inside] = values[(start[row] + number)[inside]]
    return out


@lean
def _prefixes(batches: Iterator[pa.RecordBatch], ranked, threshold: float) -> Iterator[pa.RecordBatch]:
    """List entries: key, size << 16 | position, the line's place, its sketch."""
    release()
    known, rank, hot, again = ranked.value
    for batch in batches:
        for i, row, number, h, line, first in _sets(batch.column(2)):
            n = np.diff(first)
            take = (n >= threshold * (n + 1) - 1e-9) & ~_marked(batch.column(3), i, row, number)  # shorter ones match equal sets only
            order = np.zeros(len(h), dtype=_U)  # rare words first, by hash; then the ranked
            if len(known):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                common = known[place] == h
                order[common] = rank[place[common]].astype(_U)
            key = (order << _U(40)) | (h & _U((1 << 40) - 1))
            bit, half = _U(1) << (h >> _U(58)), (h >> _U(57)) & _U(1)
            edges = np.append(first[:-1], len(h))
            sketches = []
            for side in (0, 1):
                run = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(np.where(half == side, bit, _U(0)))])
                sketches.append(run[edges[1:]] ^ run[edges[:-1]])
            length = prefix_length(n, threshold)
            lines = np.flatnonzero(take)
            if not len(lines):
                continue
            out = [a + np.argsort(key[a:b], kind="stable")[:m] for a, b, m in zip(first[lines].tolist(), first[lines + 1].tolist(), (length[lines] + 1).tolist(), strict=True)]
            sizes = np.array([len(x) for x in out])
            words, owner = np.concatenate(out), np.repeat(lines, sizes)
            position = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            is_hot, in_prefix = order[words] >= _U(hot), position < length[owner]
            shared = (order[words] > 0) | _again(h[words], again)
            single = np.flatnonzero(in_prefix & ~is_hot & shared)
            left, right = _second_words(owner, position, in_prefix & is_hot)
            some = shared[left] & shared[right]
            left, right = left[some], right[some]
            keys = np.concatenate([h[words[single]], at.mix(h[words[left]] * _U(3) + h[words[right]])])
            which = np.concatenate([single, left])
            owner, position = owner[which], np.minimum(position[which], _MOST)
            ids, place = _places(batch, i, row[owner], number[owner])
            size = (np.minimum(n[owner], _MOST) << 16) | position
            yield pa.RecordBatch.from_arrays([pa.array(at.signed(keys)), pa.array(size.astype(np.int32)), ids, pa.array(place), *(pa.array(at.signed(x[owner])) for x in sketches)], ["key", "size", "id", "at", "s1", "s2"])


def _again(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each word is set."""
    place = words >> _U(64 - AGAIN)
    return (bits[place >> _U(6)] >> (place & _U(63))) & _U(1) > 0


def _second_words(owner: np.ndarray, position: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later place) of the long prefix of which one is hot in the short prefix: hot ones are last in the order."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in np.flatnonzero(hot).tolist():
        begin = x - position[x]
        left.append(np.arange(begin, x))  # with all before it
        right.append(np.full(x - begin, x))
        if x + 1 < len(owner) and owner[x + 1] == owner[x] and not hot[x + 1]:  # and the one behind the short prefix
            mine = np.flatnonzero(hot[begin : x + 1]) + begin
            left.append(mine)
            right.append(np.full(len(mine), x + 1))
    return np.concatenate(left), np.concatenate(right)


def _is_later(id_: np.ndarray, at_: np.ndarray, id0: np.ndarray, at0: np.ndarray) -> np.ndarray:
    return (id_ > id0) | ((id_ == id0) & (at_ >> 32 > at0 >> 32))


def _bounded(x: np.ndarray, y: np.ndarray, entries: tuple[np.ndarray, ...], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows that may reach the threshold by position and by sketch, and in how many bits their sketches differ."""
    n, position, s1, s2 = entries
    ok = (np.minimum(n[x] - position[x], n[y] - position[y]) >= t / (1 + t) * (n[x] + n[y]) - 1e-9) | (np.maximum(n[x], n[y]) >= _MOST)
    x, y = x[ok], y[ok]
    far = np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[y])
    ok = (far <= (1 - t) / (1 + t) * (n[x] + n[y]) + 1e-9) | (np.maximum(n[x], n[y]) >= _MOST)
    return x[ok], y[ok], far[ok]


def _ranges(row: np.ndarray, start: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with ``many`` rows from ``start`` on, about _PAIRS pairs at a time."""
    upto, r0 = np.cumsum(many), 0
    while r0 < len(row):
        r1 = max(r0 + 1, int(np.searchsorted(upto, (upto[r0 - 1] if r0 else 0) + _PAIRS, side="right")))
        m = many[r0:r1]
        yield np.repeat(row[r0:r1], m), np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[r0:r1], m)
        r0 = r1


def _entries(size: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, ...]:
    return (size >> 16).astype(np.int64), (size & 0xFFFF).astype(np.int64), s1.view(_U), s2.view(_U)


def _joined(columns: list[np.ndarray], fresh: int, t: float, most: int | None, long: int, pilots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier) rows of lists that may match, with one row at least from ``fresh`` on; and the rows of lists that have more pairs than these.

    Rows are in order of list and size.
    """
    key, size, id_, at_, s1, s2 = columns
    entries = _entries(size, s1, s2)
    n = entries[0]
    which = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    code, row = (which << 16) | n, np.arange(len(key))
    low = np.searchsorted(code, (which << 16) | np.ceil(t * n - 1e-9).astype(np.int64))
    many = row - low
    many[:fresh] = 0
    wide = np.flatnonzero(many > long)
    dense = [which[wide]]
    if len(wide):  # the first rows of the own size, and the last before it
        alike = np.searchsorted(code, code[wide])
        end = np.minimum(alike + pilots, wide)
        last = np.maximum(end, wide - pilots)
        many[wide] = 0
        start = np.concatenate([low, alike, last])
        many, row = np.concatenate([many, end - alike, wide - last]), np.concatenate([row, wide, wide])
        order = np.argsort(row, kind="stable")
        row, low, many = row[order], start[order], many[order]
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in _ranges(row, low, many):
        x, y, far = _bounded(x, y, entries, t)
        swap = _is_later(id_[y], at_[y], id_[x], at_[x])
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        ok = swap | _is_later(id_[x], at_[x], id_[y], at_[y])
        x, y, far = x[ok], y[ok], far[ok]
        if most is not None and len(x):
            order = np.lexsort((far, x))
            x, y = x[order], y[order]
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            near = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) < most
            dense.append(which[x[~near]])
            x, y = x[near], y[near]
        later.append(x)
        earlier.append(y)
    return np.concatenate(later), np.concatenate(earlier), np.isin(which, np.concatenate(dense))


@lean
def _candidates(batches: Iterator[pa.RecordBatch], t: float, most: int | None, long: int = LONG) -> Iterator[pa.RecordBatch]:
    """Pairs (id, at, id0, at0) from lists in order; and, with their key, the entries of lists that have more pairs than these."""
    release()
    names = ["key", "size", "id", "at", "s1", "s2", "id0", "at0"]
    pilots = min(PILOTS, max(1, long // 4))
    fresh, thinned = 0, None

    def found(columns, fresh, thinned):
        later, earlier, dense = _joined(columns, fresh, t, most, long, pilots)
        id_, at_ = columns[2], columns[3]
        none = pa.nulls(len(later), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.array(id_[later]), pa.array(at_[later]), none, none, pa.array(id_[earlier]), pa.array(at_[earlier])], names)
        if thinned is not None:
            dense |= columns[0] == thinned
        if dense.any():
            none = pa.nulls(int(dense.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c[dense]) for c in columns), none, none], names)

    waiting: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        held = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        keep = np.flatnonzero((held[0] == held[0][-1]) & (held[1] >> 16 >= t * (held[1][-1] >> 16) - 1))
        many = len(keep) > 2 * long
        thinned = held[0][-1] if many else thinned
        yield from found(held, fresh, thinned)
        if many:  # the list is kept; from here on its pilots are enough
            n = held[1][keep] >> 16
            begin = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
            place = np.arange(len(n)) - np.repeat(begin, np.diff(np.append(begin, len(n))))
            keep = keep[(place < pilots) | (np.arange(len(n)) >= len(n) - pilots)]
        waiting, rows = [[c[keep] for c in held]], 0
        fresh = len(keep)
    if rows:
        yield from found([np.concatenate(x) for x in zip(*waiting, strict=True)], fresh, thinned)


def _block_pairs(columns: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) rows of whole blocks that may match: rows asked for, and those that are not."""
    key, x, y, size, id_, at_, s1, s2, asked = columns
    entries = _entries(size, s1, s2)
    n = entries[0]
    which = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
    code, row = (which << 16) | n, np.flatnonzero(asked)
    least, greatest = np.ceil(t * n[row] - 1e-9).astype(np.int64), np.minimum(np.floor(n[row] / t + 1e-9).astype(np.int64), _MOST)
    low = np.searchsorted(code, (which[row] << 16) | least)
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _ranges(row, low, np.searchsorted(code, (which[row] << 16) | greatest, side="right") - low):
        ok = ~asked[b]
        a, b, _ = _bounded(a[ok], b[ok], entries, t)
        ok = _is_later(id_[a], at_[a], id_[b], at_[b])
        later.append(a[ok])
        earlier.append(b[ok])
    return np.concatenate(later), np.concatenate(earlier)


@lean
def _blocks(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs (id, at, id0, at0) of blocks in order."""
    release()

    def found(columns):
        later, earlier = _block_pairs(columns, t)
        return pa.RecordBatch.from_arrays([pa.array(columns[c][side]) for side in (later, earlier) for c in (4, 5)], ["id", "at", "id0", "at0"])

    waiting: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        whole = len(held[0]) - int(np.logical_and.reduce([c == c[-1] for c in held[:3]]).sum())  # the last block may go on
        if whole:
            yield found([c[:whole] for c in held])
        waiting, rows = [[c[whole:] for c in held]], len(held[0]) - whole
    if rows:
        yield found([np.concatenate(c) for c in zip(*waiting, strict=True)])


def _undecided_pairs(entries: DataFrame, t: float) -> DataFrame:
    """entries (key, size, id, at, s1, s2, asked; of whole lists) -> pairs of lines that are asked for and earlier lines that may match."""
    per_list = entries.groupBy("key").agg(F.count_if("asked").alias("xs"), F.count(F.lit(1)).alias("ys")).where("xs > 0")
    per_list = broadcast_if_small(stored(per_list.select("key", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("xs", "ys"))), "asked"))
    own = lambda m: F.pmod(F.xxhash64("id", "at"), F.col(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    cell = lambda x, y, asked: F.struct(x.alias("x"), y.alias("y"), F.lit(asked).alias("asked"))
    as_asked = F.when(F.col("asked"), F.transform(every("ys"), lambda y: cell(own("xs"), y, True)))
    cells = F.concat(F.coalesce(as_asked, F.array().cast("array<struct<x:int,y:int,asked:boolean>>")), F.transform(every("xs"), lambda x: cell(x, own("ys"), False)))
    dealt = entries.distinct().join(per_list, "key").withColumn("c", F.explode(cells)).select("key", "c.x", "c.y", "size", "id", "at", "s1", "s2", "c.asked")
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "size").mapInArrow(lambda b: _blocks(b, t), "id long, at long, id0 long, at0 long")


@lean
def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, row, number, h, line, first in _sets(batch.column(2)):
            some = np.flatnonzero(_marked(batch.column(3), i, row, number))
            if not len(some):
                continue
            ids, place = _places(batch, i, row[some], number[some])
            size = np.diff(first)[some]
            words = pa.array(at.signed(h[np.isin(line, some)]))
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays([ids, pa.array(place), sets], ["id", "at", "words"])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for numbers in batch.column(2):
            numbers = numbers.values.to_numpy()
            flags = np.zeros(int(numbers.max()) + 1, dtype=bool)
            flags[numbers] = True
            out.append(flags)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flags = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, bool)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flags], ["id", "tag", "flags"])


def by_row(lines: DataFrame, name: str) -> DataFrame:
    """(id, at) -> id, tag and, by line number, whether the line is among them (stored); with a broadcast hint while they are few."""
    rows = lines.groupBy("id", F.shiftright(F.shiftleft("at", 32), 32).cast("int").alias("tag")).agg(F.collect_set(F.shiftright("at", 32).cast("int")).alias("lines"))
    table = stored(rows.mapInArrow(_flags, "id long, tag int, flags array<boolean>").withColumnRenamed("flags", name), name)
    total = table.agg(F.sum(F.size(name))).first()[0] or 0
    return F.broadcast(table) if total <= 8 * BROADCAST_ROWS else table


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose flag is set (null: none)."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def _collected(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both columns (long) of a table of bounded size."""
    parts = table.mapInArrow(_packed, "words binary, counts binary").collect()
    return tuple(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], dtype=np.int64) for r in parts)]) for c in ("words", "counts"))


def _ranks(counts: DataFrame, hot: int):
    """counts (word, n; stored) -> the FREQUENT most common words (hashes ascending), their ranks, rarer first, the least rank of a hot one, and the bits of all others; as a broadcast variable."""
    spark = counts.sparkSession
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    total = sizes.withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n")))).where(F.col("above") <= FREQUENT).agg(F.min("n")).first()[0]
    common = F.lit(False) if total is None else F.col("n") >= F.lit(total)
    place = F.shiftrightunsigned("word", 64 - AGAIN)
    rest = counts.where(~common).groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    again = np.zeros(1 << (AGAIN - 6), _U)
    cell, bits = _collected(rest)
    again[cell] = bits.view(_U)
    word, n = _collected(counts.where(common).select("word", "n"))
    word = word.view(_U)
    by_word = np.argsort(word)
    rank = np.empty(len(word), dtype=np.int32)
    rank[np.lexsort((word, n))] = np.arange(1, len(word) + 1)
    return spark.sparkContext.broadcast((word[by_word], rank[by_word], int((n <= hot).sum()) + 1, again))


_LATER = "id > id0 or (id = id0 and shiftright(at, 32) > shiftright(at0, 32))"


def _verified(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """(id, at) of the later lines of pairs that reach the threshold."""
    ends = pairs.select(F.explode(F.array(F.struct("id", "at"), F.struct(F.col("id0").alias("id"), F.col("at0").alias("at")))).alias("e")).select("e.*").distinct()
    sets = rows.join(by_row(ends, "wanted"), ["id", "tag"]).select("id", "tag", "text", "wanted").mapInArrow(_wanted_sets, "id long, at long, words array<long>")
    sets = stored(sets, "sets").dropDuplicates(["id", "at"])
    both = pairs.join(sets, ["id", "at"]).join(sets.select(F.col("id").alias("id0"), F.col("at").alias("at0"), F.col("words").alias("words0")), ["id0", "at0"])
    common = F.size(F.array_intersect("words", "words0"))
    return both.where(common >= t * (F.size("words") + F.size("words0") - common) - 1e-9).select("id", "at").distinct()


def duplicate_lines(rows: DataFrame, threshold: float = 0.8, hot: int = HOT, long: int = LONG) -> DataFrame:
    """rows (id, text; no nulls) -> (id, at) of every line to remove; at is the line's number << 32 | tag, the tag F.hash(text)."""
    small_batches(rows.sparkSession)
    rows = rows.select("id", F.hash("text").alias("tag"), "text")
    scan = stored(rows.mapInArrow(_scan, "id long, at long, a long, b long"), "lines")
    lines = scan.where("id is not null")
    first = lines.groupBy("a", "b").agg(F.min(F.struct("id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("a", "b", F.col("f.id").alias("id0"), F.col("f.at").alias("at0"))
    first = stored(first, "firsts")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    copies = stored(lines.join(first, ["a", "b"]).where(_LATER).select("id", "at"), "copies")

    counts = stored(scan.where("id is null").groupBy(F.col("a").alias("word")).agg(F.sum("b").alias("n")).where("n > 1"), "words")
    ranked = _ranks(counts, hot if threshold > 0.5 else 1 << 62)  # below, a pair may have one word in common
    texts = rows.join(by_row(copies, "decided"), ["id", "tag"], "left").select("id", "tag", "text", "decided")
    entry = "key long, size int, id long, at long, s1 long, s2 long"
    most = NEAREST
    entries = texts.mapInArrow(lambda b: _prefixes(b, ranked, threshold), entry).repartition("key").sortWithinPartitions("key", "size", "id")
    found = stored(entries.mapInArrow(lambda b: _candidates(b, threshold, most, long), entry + ", id0 long, at0 long"), "lists")
    pairs = stored(found.where("key is null").select("id", "at", "id0", "at0").distinct(), "pairs")
    near = stored(_verified(pairs, rows, threshold), "near")
    gone = copies.unionByName(near)

    rest = found.where("key is not null").select("key", "size", "id", "at", "s1", "s2")
    rest = rest.join(broadcast_if_small(near).withColumn("asked", F.lit(False)), ["id", "at"], "left").select("key", "size", "id", "at", "s1", "s2", F.coalesce("asked", F.lit(True)).alias("asked"))
    more = _undecided_pairs(rest, threshold).distinct().join(pairs, ["id", "at", "id0", "at0"], "left_anti")
    more = stored(more, "pairs")
    return gone if more.isEmpty() else gone.unionByName(_verified(more, rows, threshold))


def lines_by_row(lines: DataFrame) -> DataFrame:
    """(id, at) -> id, tag, gone: by line number, whether the line is to be removed."""
    return by_row(lines, "gone")


def line_dedup(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, long: int = LONG) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, kept_text (kept lines, in order)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = lines_by_row(duplicate_lines(rows.where("id is not null and text is not null"), threshold, hot, long))
    cut = rows.withColumn("tag", F.hash("text")).join(gone, ["id", "tag"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("gone", lambda x: x))).cast("long")
    return cut.select(F.col("id").alias(id_col), n_lines.alias("n_lines"), n_removed.alias("n_removed"), without_lines(F.col("text"), F.col("gone")).alias("kept_text"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, k, s[k] AS line, list_distinct(list_filter(string_split_regex(s[k], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS r, len(w) AS n FROM b),
t AS (SELECT r, n, unnest(w) AS w FROM o),
c AS (SELECT w, count(*) AS c FROM t GROUP BY w),
p AS (SELECT r, n, w FROM (SELECT t.r, t.n, t.w, row_number() OVER (PARTITION BY r ORDER BY c, t.w) AS i FROM t JOIN c USING (w)) WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.w = b.w AND a.r < b.r AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
d AS (SELECT DISTINCT q.b AS r FROM q JOIN o x ON x.r = q.a JOIN o y ON y.r = q.b
      WHERE len(list_intersect(x.w, y.w)) >= 0.8 * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
k AS (SELECT doc_id, count(*) AS n_lines, count(d.r) AS n_removed, string_agg(CASE WHEN d.r IS NULL THEN line END, chr(10) ORDER BY k) AS kept FROM o LEFT JOIN d USING (r) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""
