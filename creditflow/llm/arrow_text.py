"""Vectorised words and hashes over Arrow text columns.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D. These bytes are
ASCII, so cutting UTF-8 there is safe. Work goes in slices of at most
``SLICE_BYTES`` (cut at a separator), so memory stays small for long texts too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Rows of a batch are handled in groups of about this many text bytes.
GROUP_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64


def odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=_U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = odd_powers(base, max(n, 1 << 16))
    p, q = _POWERS[base]
    return p[:n], q[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about GROUP_BYTES of text each (one row at least)."""
    _, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some rows: byte spans, hashes, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    first: np.ndarray  # n_rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None, second: bool = True) -> Words:
    """Words of every row with two 64-bit hashes each (the second is left out if it is not wanted).

    A word hash is a polynomial in its bytes, taken from running sums; equal
    bytes give equal hashes wherever they stand. fold maps bytes before hashing
    and cutting (a 256-entry table).
    """
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        while end < len(raw) and not (_IS_SPACE[raw[end]] or begins[end]):  # to a separator
            step = raw[end : end + 4096]
            stop = np.flatnonzero(_IS_SPACE[step] | begins[end : end + len(step)])
            end += int(stop[0]) if len(stop) else len(step)
        piece = raw[at:end]
        if fold is not None:
            piece = fold[piece]
        space = _IS_SPACE[piece]
        n = len(piece)
        start = ~space
        start[1:] &= space[:-1] | begins[at + 1 : end]
        close = ~space
        close[:-1] &= space[1:] | begins[at + 1 : end]
        s, e = np.flatnonzero(start), np.flatnonzero(close) + 1
        bytes_ = piece.astype(_U) + _U(1)
        hashes = []
        for base in _BASES if second else _BASES[:1]:
            p, q = powers(base, n)
            run = np.zeros(n + 1, dtype=_U)
            np.cumsum(bytes_ * p, out=run[1:])
            hashes.append(mix((run[e] - run[s]) * q[s] + (e - s).astype(_U)) if len(s) else np.zeros(0, _U))
        parts.append((s + at, e + at, hashes[0], hashes[-1]))
        at = end
    if parts:
        starts, ends, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts = ends = np.zeros(0, np.int64)
        h1 = h2 = np.zeros(0, _U)
    return Words(starts, ends, h1, h2, np.searchsorted(starts, offsets))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of width values, mixed; empty if too few."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    p, q = powers(base, len(h) + 1)
    run = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * p[: len(h)], out=run[1:])
    return mix((run[width:] - run[:n]) * q[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have :][:n])


def inside(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the windows of width values lie within one row."""
    n = max(0, total - width + 1)
    ok = np.zeros(n, dtype=bool)
    a, b = first[:-1], first[1:] - width + 1
    take = b > a
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, a[take], 1)
    np.add.at(mark, b[take], -1)
    ok[:] = np.cumsum(mark[:-1]) > 0
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)
