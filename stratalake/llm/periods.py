"""Periodic runs of words: stretches that repeat a period, found from Lyndon roots with suffix-tree LCE.

A run is a stretch of words with smallest period q, at least max(shortest, repeats * q) words long, that no
neighbouring word extends. Every run holds the longest Lyndon word of one of its places, under the order of the
words or its reverse, as its period (the runs theorem), so there are at most two candidates a place. A candidate
is extended to the right by the longest common extension of its place and the place a period later, and to the
left by the same on the reversed words. Extensions come in constant time from suffix trees (Ukkonen) of the words
and their reversal: the string depth of the lowest common ancestor, a range minimum over the Euler tour.

Words that cannot lie in a run are left out of the trees. In a run each word after the first period has stood at
most q words before, and these words are repeats - 1 periods at least; so a stretch of L words that all occurred
before holds only periods up to L / (repeats - 1), and words whose last occurrence is further back cut it. What is
left keeps L / (repeats - 1) words before it. This drops no run, whatever the text.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, compared exactly. Memory follows the longest text
(some hundred bytes for each word in a repeated stretch). Cases: null text counts as empty; a text without words
has no run and an empty collapsed text; repeated rows give equal rows; null ids and other columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.store import whole

WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def ukkonen(symbols: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """(begin and end of the edge into each node, node * width + symbol -> child, width). Node 0 is the root; the last
    symbol must be unique."""
    n, width = len(symbols), max(symbols) + 1
    begin, end, link, child_of = [0], [0], [0], {}
    node = edge = length = open_suffixes = 0
    for i, symbol in enumerate(symbols):
        last = 0
        open_suffixes += 1
        while open_suffixes:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            child = child_of.get(key)
            if child is None:
                child_of[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                low = begin[child]
                span = end[child] - low
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if symbols[low + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(begin)
                begin += (low, i)
                end += (low + length, n)
                link += (0, 0)
                child_of[key] = middle
                child_of[middle * width + symbol] = middle + 1
                begin[child] = low + length
                child_of[middle * width + symbols[low + length]] = child
                if last:
                    link[last] = middle
                last = middle
            open_suffixes -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_suffixes + 1
    return begin, end, child_of, width


class SuffixTree:
    """Longest common extensions of two places in constant time."""

    def __init__(self, symbols: list[int]):
        begin, end, child_of, width = ukkonen(symbols)
        children: list[list[int] | None] = [None] * len(begin)
        for key, child in child_of.items():
            parent = key // width
            if children[parent] is None:
                children[parent] = [child]
            else:
                children[parent].append(child)
        depth, first, tour = [0] * len(begin), [0] * len(begin), []
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            first[node] = len(tour)
            deep = depth[node]
            tour.append(deep)
            if children[node]:
                for child in children[node]:
                    depth[child] = deep + end[child] - begin[child]
                    stack.append(~node)
                    stack.append(child)
        leaves = np.array([c is None for c in children])
        leaves[0] = False
        size = len(symbols)
        self.place = np.zeros(size, np.int64)
        self.place[size - np.array(depth)[leaves]] = np.array(first)[leaves]
        levels = max(1, len(tour).bit_length())
        self.least = np.empty((levels, len(tour)), np.int32)
        self.least[0] = tour
        for k in range(1, levels):
            half = 1 << (k - 1)
            self.least[k] = self.least[k - 1]
            self.least[k, :-half] = np.minimum(self.least[k - 1, :-half], self.least[k - 1, half:])

    def extension(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two different places begin with alike."""
        a, b = self.place[one], self.place[other]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level) + 1]).astype(np.int64)


def lyndon_lengths(symbols: np.ndarray, tree: SuffixTree, reverse: bool) -> np.ndarray:
    """Length of the longest Lyndon word at each place, under the order of the symbols or its reverse: the way to the
    next smaller suffix. The last symbol is the smallest in both."""
    n = len(symbols) - 1
    after = np.arange(1, n + 1)
    left = np.arange(n)
    while len(left):
        at = after[left]
        open_ = at < n
        left, at = left[open_], at[open_]
        same = tree.extension(left, at)
        one, other = symbols[left + same], symbols[np.minimum(at + same, n)]
        larger = (at + same < n) & ((other < one) if reverse else (other > one))
        left = left[larger]
        after[left] = after[at[larger]]  # what stands between is larger still
    return after - np.arange(n)


def runs_of_symbols(symbols: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """(start, length, period) of every run, in any order."""
    n = len(symbols)
    ended = np.append(symbols + 1, 0)
    forward, backward = SuffixTree(ended.tolist()), SuffixTree(np.append(symbols[::-1] + 1, 0).tolist())
    found = []
    for reverse in (False, True):
        period = lyndon_lengths(ended, forward, reverse)
        start = np.flatnonzero(np.arange(n) + period < n)
        period = period[start]
        right = forward.extension(start, start + period)
        left = np.where(start > 0, backward.extension(np.minimum(n - start, n - 1), n - start - period), 0)
        length = left + period + right
        enough = length >= np.maximum(shortest, repeats * period)
        found.append(np.stack([start - left, length, period], axis=1)[enough])
    return np.unique(np.concatenate(found), axis=0)


def repeated_stretches(ids: np.ndarray, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """(first word to look at, first word, end) of the stretches that can hold a run after its first period."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    back = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    least = min(max((repeats - 1) * q, shortest - q) for q in range(1, shortest + 1))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = back <= n // repeats
    most = np.zeros(n, np.int64)
    while True:
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        size = ends - begins
        widest = np.where(size >= least, size // (repeats - 1), 0)
        most[inside[1:-1]] = np.repeat(widest, size)
        kept = inside[1:-1] & (back <= most)
        if (kept == inside[1:-1]).all():
            return [(max(0, int(a - w)), int(a), int(b)) for a, b, w in zip(begins, ends, widest)]
        inside[1:-1] = kept


def word_runs(words: list, shortest: int = 6, repeats: int = 4) -> np.ndarray:
    """(start, length, period) of every run of a list of words, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < max(shortest, repeats):
        return none
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == len(words):
        return none
    stretches = repeated_stretches(ids, shortest, repeats)
    if not stretches:
        return none
    # stretches are looked at together, with a word of its own after each
    size = np.array([b - low + 1 for low, _, b in stretches])
    joined = np.concatenate([np.append(ids[low:b], len(number) + k) for k, (low, _, b) in enumerate(stretches)])
    begins = np.concatenate(([0], np.cumsum(size)))
    found = runs_of_symbols(joined, shortest, repeats)
    at = np.searchsorted(begins, found[:, 0], "right") - 1
    found[:, 0] += np.array([low for low, _, _ in stretches])[at] - begins[at]
    found = found[found[:, 0] + found[:, 2] >= np.array([a for _, a, _ in stretches])[at]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, repeats: int = 4) -> DataFrame:
    """id, n_words, runs (by start and period), collapsed (the words outside repeats, joined by one space) per row."""
    if repeats < 2 or shortest < 1:
        raise ValueError("a run repeats its period twice at least")
    rows = docs.select(F.col(id_col), whole(text_col).cast("binary").alias("_text"))
    name = rows.schema[0]
    out = f"`{name.name}` {name.dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"

    def find(batches):
        for batch in batches:
            counts, held, left = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()  # at the white space above, and no other
                runs = word_runs(words, shortest, repeats)
                counts.append(len(words))
                held.append(runs)
                left.append(b" ".join(collapsed(words, runs)))
            offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            flat = np.concatenate([*held, np.zeros((0, 3), np.int64)])
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, struct),
                pa.array(left, pa.binary()).cast(pa.string())], names=[name.name, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(find, out)
