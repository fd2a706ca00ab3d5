"""Merging of adjacent rating bins: linked neighbours and a heap of their costs (numpy only).

A forced merge repairs a broken rule (empty bin, default rate not rising, bin too
small and, but for information value, too many months in which neighbours cross);
otherwise the cheapest neighbours merge while there are more groups than allowed. Forced costs are
negative, so that the first minimum is the next merge in either case. A merge changes
the costs of two pairs only; entries of the heap that it outdates are skipped when
they come up.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Costs of broken rules, worst first (fixed values): empty, not rising, too small, crossing months.
WARD_FORCED = (-2e9, -1e9, -1e6, -1e3)
#: The same for information value: empty and not rising replace the cost, too small is added to it.
IV_FORCED = (-1e9, -1e6, -1e3)
#: Weights of crossing months and of the spread of monthly rates (fixed values).
IV_CROSSING, IV_SPREAD = 0.5, 0.2


def _crossings(vols: np.ndarray, bads: np.ndarray) -> np.ndarray:
    """For each pair of neighbours: months in which both have rows and the left rate is not below the right."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = bads / vols
    return ((vols[:-1] > 0) & (vols[1:] > 0) & (rate[:-1] >= rate[1:])).sum(axis=1) if vols.shape[1] else np.zeros(len(vols) - 1, int)


def _ward(v, b, vols, bads, whole, least, crossings, method):
    pd = b / np.maximum(v, 1)
    cost = (pd[:-1] - pd[1:]) ** 2
    if method == "ward":
        cost = v[:-1] * v[1:] / np.maximum(v[:-1] + v[1:], 1) * cost
    share = v / max(whole[0], 1)
    empty, falling, small, crossing = WARD_FORCED
    broken = [np.minimum(v[:-1], v[1:]) == 0, pd[:-1] >= pd[1:], np.minimum(share[:-1], share[1:]) < least, _crossings(vols, bads) > crossings]
    return cost + np.select(broken, [empty, falling, small, crossing], 0.0), 0.0


def _iv_part(v, b, bad, good):
    """Information value of each group; 0 where it has only bads or only goods."""
    share_bad, share_good = b / max(bad, 1), (v - b) / max(good, 1)
    both = (share_bad > 0) & (share_good > 0)
    ratio = np.divide(share_good, share_bad, out=np.ones_like(share_bad), where=both)
    return np.where(both, (share_good - share_bad) * np.log(ratio), 0.0)


def _iv(v, b, vols, bads, whole, least, crossings, method):
    bad, good = whole[1], whole[0] - whole[1]
    pd = b / np.maximum(v, 1)
    own = _iv_part(v, b, bad, good)
    mv, mb = vols[:-1] + vols[1:], bads[:-1] + bads[1:]
    spread = np.array([np.std(y[x > 0] / x[x > 0]) if (x > 0).any() else 0.0 for x, y in zip(mv, mb, strict=True)])
    loss = own[:-1] + own[1:] - _iv_part(v[:-1] + v[1:], b[:-1] + b[1:], bad, good)
    share = v / max(whole[0], 1)
    empty, falling, small = IV_FORCED
    cost = loss + IV_CROSSING * _crossings(vols, bads) + IV_SPREAD * spread + np.where(np.minimum(share[:-1], share[1:]) < least, small, 0.0)
    return np.select([np.minimum(v[:-1], v[1:]) == 0, pd[:-1] >= pd[1:]], [empty, falling], cost), -100.0


def merge_bins(v, b, vols, bads, max_groups: int, min_vol_ratio: float, max_crossings: int, method: str = "ward") -> np.ndarray:
    """Group (from 1, left to right) of each bin. vols, bads: bins x months (no month: zero columns)."""
    v, b, vols, bads = (np.array(x, dtype=np.float64) for x in (v, b, vols, bads))
    n, whole, costs = len(v), (v.sum(), b.sum()), _iv if method == "iv" else _ward
    if n < 2:
        return np.ones(n, dtype=np.int64)
    cost, floor = costs(v, b, vols, bads, whole, min_vol_ratio, max_crossings, method)
    heap = [(c, i, 0) for i, c in enumerate(cost.tolist())]  # a pair is known by its left bin; equal costs: leftmost first
    heapq.heapify(heap)
    left, right, version, groups = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n, n
    while heap:
        c, i, of = heap[0]
        if version[i] != of:
            heapq.heappop(heap)
            continue
        if groups <= max_groups and c >= floor:
            break
        heapq.heappop(heap)
        j = right[i]
        for x in (v, b, vols, bads):
            x[i] += x[j]
        right[i], version[j], groups = right[j], -1, groups - 1
        if right[i] < n:
            left[right[i]] = i
        else:
            version[i] += 1  # the last bin begins no pair
        near = [k for k in (left[i], i, right[i]) if 0 <= k < n]
        if len(near) > 1:
            new, _ = costs(v[near], b[near], vols[near], bads[near], whole, min_vol_ratio, max_crossings, method)
            for k, cost_k in zip(near, new.tolist(), strict=False):
                version[k] += 1
                heapq.heappush(heap, (cost_k, k, version[k]))
    first = [0]
    while right[first[-1]] < n:
        first.append(right[first[-1]])
    return np.searchsorted(first, np.arange(n), side="right")
