"""Texts of an Arrow batch as one byte buffer, and vectorised word hashes over it.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Word hashes are 64-bit: a polynomial of
the bytes, mixed. They depend on the word alone, not on the batch, the task or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


UP = _powers(BASE, CHUNK)
DOWN = _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (two multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets with one more entry than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `size` bytes; a longer text is a range by itself."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, end of each word, index of the first word of each text and the word count at last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = AS_IS) -> np.ndarray:
    """A hash per word, of its bytes put through `table`. Longer words than CHUNK are hashed by pieces."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(ends, low + CHUNK, "right"))
            if j == i:
                whole, value = table[data[low : ends[i]]], np.uint64(0)
                for k in range(0, len(whole), CHUNK):
                    piece = whole[k : k + CHUNK].astype(np.uint64) + np.uint64(1)
                    value = value * STEP + (piece * UP[: len(piece)]).sum(dtype=np.uint64)
                out[i] = value ^ np.uint64(len(whole))
                i += 1
                continue
            values = table[data[low : ends[j - 1]]].astype(np.uint64)
            values += np.uint64(1)
            values *= UP[: len(values)]
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * DOWN[s] ^ (e - s).astype(np.uint64)
            i = j
    return mix(out)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words inside a text, index of the first run of each text and the count at last).

    A text with 1 to n-1 words has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(runs)))
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    out = np.zeros(at[-1], np.uint64)
    last = np.repeat(first[1:], runs)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= STEP
            there = index + k
            ok = there < last
            if len(hashes):
                out += np.where(ok, hashes[np.minimum(there, len(hashes) - 1)], np.uint64(0))
    return mix(out), at
