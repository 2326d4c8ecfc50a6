"""Maximal intervals of a score walk: kernels on one (query, strand), in numpy.

C[0] = 0 and C[i] is the sum of bins 0..i-1. Intervals are 1-based inclusive (a, b) on C; as bins they are [a, b + 1).
"""

from __future__ import annotations

import math

import numpy as np


def extrema(C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(H, L): prefix maxima of C[1..] with H[0] = -inf and H[n+1] = inf; suffix minima with L[0] = inf and L[n+1] = -inf."""
    H = np.concatenate(([-np.inf], np.maximum.accumulate(C[1:]), [np.inf]))
    L = np.concatenate(([np.inf], np.minimum.accumulate(C[:0:-1])[::-1], [-np.inf]))
    return H, L


def maximal(C: np.ndarray, tau: int, left: int = 1, right: int | None = None) -> list[tuple[int, int]]:
    """Maximal falling intervals of at least tau steps within [left, right]; extrema are those of the whole walk."""
    n = len(C) - 1
    right = n if right is None else right
    if right >= left + tau and C[right] < C[left]:
        return [(left, right)]
    if right < left:
        return []
    H, L = extrema(C)
    a = np.arange(left, right + 1)
    a = a[C[a] > H[a - 1]]
    b = np.searchsorted(L[1 : n + 1], C[a], side="left")  # L rises: the last index whose suffix minimum is below C[a]
    b = np.maximum(left, np.minimum(right, b))
    keep = (b >= a + tau) & (C[b] < C[a]) & (C[b] >= H[a - 1])
    out, taken = [], set()
    for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        if y not in taken:
            taken.add(y)
            out.append((x, y))
    return out


def maximal_by_loop(C: np.ndarray, tau: int, left: int = 1, right: int | None = None) -> list[tuple[int, int]]:
    """The same by definition, pair by pair: for tests."""
    n = len(C) - 1
    right = n if right is None else right
    if right >= left + tau and C[right] < C[left]:
        return [(left, right)]
    out, taken = [], set()
    for a in range(left, right + 1):
        before = max(C[1:a], default=-math.inf)
        if C[a] > before:
            b = max((i for i in range(1, n + 1) if min(C[i:]) < C[a]), default=0)
            b = max(left, min(right, b))
            if b >= a + tau and C[b] < C[a] and C[b] >= before and b not in taken:
                taken.add(b)
                out.append((a, b))
    return out


def merged(intervals: list[tuple[int, int]], C: np.ndarray, S: np.ndarray, chisq: float) -> list[tuple[int, int]]:
    """Joins overlapping neighbours whose common fall is not significantly less steep: chi-square below chisq."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out:
            first, last = out[-1]
            fall, spread = C[b] - C[first], S[first] - S[b]
            if a < last and (fall * fall + 1e-7) / (spread + 1e-7) < chisq:
                out[-1] = (first, b)
                continue
        out.append((a, b))
    return out


def ranks(thresholds: list[float], distance: float) -> list[int]:
    """Threshold indices in the order they are tried: those up to the query's distance rising, then the others falling."""
    if math.isnan(distance):
        return sorted(range(len(thresholds)), key=lambda i: thresholds[i])
    return sorted(range(len(thresholds)), key=lambda i: (thresholds[i] > distance, thresholds[i] if thresholds[i] <= distance else -thresholds[i]))


def flipped(C: np.ndarray, threshold: float, distance: float) -> np.ndarray:
    """C with its sign changed where the threshold is above the query's distance, so that falls mean farther regions."""
    return -C if not math.isnan(distance) and threshold > distance else C


def gaps(found: list[tuple[int, int, int | None]], n: int) -> list[tuple[int, int]]:
    """What ranges (first bin, bin after the last) leave of 1..n, walking them in the order given: (first, last) bins."""
    at, out = 1, []
    for a, b, _ in found:
        if a > at:
            out.append((at, a - 1))
        at = max(at, b)
    return out + ([(at, n)] if at <= n else [])


def ordered(walks: list[np.ndarray], spreads: list[np.ndarray], order: list[int], tau: int, chisq: float, by_position: bool = False) -> list[tuple[int, int, int | None]]:
    """(first bin, bin after the last, threshold): each threshold in order takes intervals from the gaps that earlier
    ones left. Rows stand by threshold rank and position, and gaps are walked in that order; by_position: both by position.
    Without any interval: the whole range."""
    n = len(walks[0]) - 1
    found: list[tuple[int, int, int | None]] = []
    for t in order:
        new = [x for a, b in gaps(found, n) if b >= a + tau for x in maximal(walks[t], tau, a, b)]
        found += [(a, b + 1, t) for a, b in merged(new, walks[t], spreads[t], chisq)]
        if by_position:
            found.sort(key=lambda x: x[:2])
    return found or [(1, n + 1, None)]


def coordinates(first: int, after: int, shift: int, enmers: int, k: int, last: bool) -> tuple[int, int]:
    """1-based positions of a range of bins."""
    start = ((first - 1) << shift) + 1
    return start, enmers + k - 1 if last else min(((after - 1) << shift) + 1, enmers + 1)


def distance_bin(thresholds: list[float], index: int | None, query_distance: float, distance: float) -> tuple[float, float]:
    """Bounds of the distance class of a record."""
    low, high = 1e-5, 1.0
    rising = sorted(thresholds)
    if index is not None:
        t = thresholds[index]
        at = rising.index(t)
        if math.isnan(query_distance) or t <= query_distance:
            return (rising[at - 1] if at else low, t)
        return (t, rising[at + 1] if at + 1 < len(rising) else high)
    d = distance if not math.isnan(distance) else query_distance
    if math.isnan(d):
        return low, high
    at = int(np.searchsorted(rising, d, side="left"))
    return (rising[at - 1] if at else low, rising[at] if at < len(rising) else high)
