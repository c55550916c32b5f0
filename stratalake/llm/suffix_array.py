"""Suffix arrays by induced sorting, on whole arrays at a time.

Suffixes are classified as S (smaller than the next one) or L. The leftmost S ones of each run are sorted by
their substrings, named, and sorted as a shorter text of names; all others are induced from them, bucket by
bucket: what is known of a bucket gives the places of its predecessors at once.

The order is exact for the first DEPTH bytes, which is all that matches of that length need. Names of the
shorter text are many, and a scan over many buckets cannot work on whole arrays; so below the first level
ranks are doubled until they reach DEPTH, unless there are few names, which are sorted recursively.
"""

from __future__ import annotations

import numpy as np

FEW_NAMES = 512


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one (the end mark) is S."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[np.minimum(at, n - 1)] > 0
    return out


class _Buckets:
    """Suffixes waiting in each bucket, in the order they came."""

    def __init__(self, sigma: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def put(self, places: np.ndarray, symbols: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        places, symbols = places[order], symbols[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        heads = symbols[np.concatenate(([0], cuts))]
        for c, part in zip(heads.tolist(), np.split(places, cuts)):
            self.waiting[c].append(part)

    def take(self, c: int) -> np.ndarray:
        parts, self.waiting[c] = self.waiting[c], []
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes from that of the leftmost S ones."""
    first = s[lms]
    bounds = np.searchsorted(first, np.arange(sigma + 1))
    waiting, large = _Buckets(sigma), []
    for c in range(sigma):
        rounds, now = [], waiting.take(c)
        while len(now):
            rounds.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            symbols = s[before]
            same = symbols == c
            waiting.put(before[~same], symbols[~same])
            now = before[same]
        large.append(np.concatenate(rounds) if rounds else np.zeros(0, np.int32))
        before = lms[bounds[c] : bounds[c + 1]]
        before = before[before > 0] - 1
        waiting.put(before, s[before])
    waiting, buckets = _Buckets(sigma), []
    waiting.waiting[s[-1]].append(np.array([len(s) - 1], np.int32))
    for c in range(sigma - 1, -1, -1):
        rounds, now = [], waiting.take(c)
        while len(now):
            rounds.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            symbols = s[before]
            same = symbols == c
            waiting.put(before[~same], symbols[~same])
            now = before[same]
        back = large[c][::-1]
        before = back[back > 0] - 1
        before = before[small[before]]
        waiting.put(before, s[before])
        if rounds:
            buckets.append(np.concatenate(rounds)[::-1])
        buckets.append(large[c])
    return np.concatenate(buckets[::-1])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of `names` by their first `depth` names at least. Ranks are the first place of those
    not told apart yet; only these are sorted again."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while reach < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        tied = order[places]
        there = tied + reach
        later = np.where(there < n, rank[np.minimum(there, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 2) + later)
        tied, later, old = tied[by], later[by], rank[tied[by]]
        order[places] = tied
        new[places[1:]] = (old[1:] != old[:-1]) | (later[1:] != later[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[tied] = start[places]
        reach *= 2
    return order


def suffix_array(s: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Places of the suffixes of s in order, exact for the first `depth` symbols. The last symbol of s is its
    smallest and stands there alone."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        by_symbol = lms[np.argsort(s[lms], kind="stable")]
        order = _induce(s, small, by_symbol, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        number = np.zeros(n, np.int32)
        number[lms] = np.arange(len(lms))
        ends = np.append(lms[1:], n - 1)
        length = (ends - lms + 1)[number[order]]
        same = np.zeros(len(order), bool)
        same[1:] = length[1:] == length[:-1]
        at, k = np.flatnonzero(same), 0
        while len(at):
            on = length[at] > k
            at = at[on]
            a, b = order[at] + k, order[at - 1] + k
            equal = (s[a] == s[b]) & (small[a] == small[b])
            same[at[~equal]] = False
            at, k = at[equal], k + 1
        names = np.zeros(len(lms), np.int64)
        names[number[order]] = np.cumsum(~same) - 1
        if not same.any():
            lms = order
        elif names.max() + 1 <= FEW_NAMES and len(lms) > 4 * FEW_NAMES:
            lms = lms[suffix_array(names.astype(np.uint16), int(names.max()) + 1, depth)]
        else:
            lms = lms[_doubled(names, depth // 2 + 2)]
    return _induce(s, small, lms.astype(np.int32), sigma)


def permuted_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the text: how many bytes its suffix shares with the one before it in order, up to depth."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth + 8, data.dtype)))
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    alive = np.flatnonzero(before >= 0)
    for k in range(depth):
        alive = alive[padded[alive + k] == padded[before[alive] + k]]
        out[alive] = k + 1
    return out
