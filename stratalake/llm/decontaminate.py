"""Benchmark passages in training texts, found by spaced-seed hashing.

Words are lower-cased (A-Z) and ASCII punctuation counts as space. A document holds a passage of a
benchmark item if WINDOW words of it in a row stand in the document in the same order, with at most
SUBSTITUTED of them replaced by other words. Each seed is a fixed mask of six word places in a span of
eight; whatever two words of a window are replaced, one of the masks still fits somewhere in it
(tests/llm checks all cases), so no such window is missed. Hashes of training texts under the masks
are joined with those of the benchmark, and around each hit the two texts are compared word by word.
Items of 5 to 12 words are found whole, with at most one word replaced: each of their three masks leaves out every
third word, so one of them fits whichever word is replaced. Shorter items are found only as the whole text of a
document, as they are too common inside others.

Neither side goes through the driver: the seeds of both are joined in a shuffle, and the hits meet their texts
in another. Only a bit table of the benchmark's seeds is sent to the tasks, 16 bits a seed and 2^MOST_BITS at most,
so that few other seeds of documents are shuffled; what it lets through is told apart by the join. A seed that a
text repeats is one row with all its places, so a text of one repeated word does not multiply. Documents and items are
told apart by a 64-bit hash on the way; where two share one, the comparison of the texts decides. Cases: null and empty
texts match nothing; repeated documents and repeated items are each reported; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.store import keep, whole

WINDOW, SHORTEST = 13, 5
#: Words that may be replaced in a window, and in a whole item of SHORTEST words or more that is shorter.
SUBSTITUTED, SUBSTITUTED_SHORT = 2, 1
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
BLOCK_WORDS = 2_000_000
PART_BYTES = 2 << 20
LEAST_BITS, MOST_BITS = 20, 27

NORMAL = tx.LOWER.copy()
NORMAL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each normalised word, index of the first word of each text and the count)."""
    data = NORMAL[data]
    starts, ends, first = tx.words(data, offsets)
    return tx.word_hashes(data, starts, ends), first


def allowed(n: int) -> int:
    """Words that may be replaced in a window of n words."""
    return SUBSTITUTED if n >= WINDOW else SUBSTITUTED_SHORT if n >= SHORTEST else 0


def masks_of(n: int) -> list[tuple[int, ...]]:
    """Masks of a whole item of n words. With a word replaced, the one that leaves out its place still fits."""
    return [tuple(p for p in range(n) if p % 3 != k) for k in range(3)] if n >= SHORTEST else [tuple(range(n))]


def _seed(hashes: np.ndarray, places: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the masked words at every place where the mask fits in the array."""
    n = max(0, len(hashes) - places[-1])
    out = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for p in places:
            out = out * tx.STEP + hashes[p : p + n]
    return tx.mix(out)


def seeds(data: np.ndarray, offsets: np.ndarray, short: list[int], items: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, place of the window in it) under the masks and of the short lengths; of items only what their own
    length asks for."""
    words, first = word_hashes(data, offsets)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    found = []
    cuts = [(WINDOW, k, mask, mask[-1]) for k, mask in enumerate(MASKS)]
    cuts += [(n, 3 * n + k + len(MASKS), mask, n - 1) for n in short for k, mask in enumerate(masks_of(n))]
    for n, salt, mask, span in cuts:
        seed = _seed(words, mask, salt)[: max(0, len(words) - span)]
        at = np.flatnonzero(text[: len(seed)] == text[span:])
        if items:
            at = at[size[text[at]] >= WINDOW if n == WINDOW else size[text[at]] == n]
        elif n < SHORTEST:
            at = at[size[text[at]] == n]
        found.append((seed[at], text[at], at - first[text[at]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def covered(words: np.ndarray, other: np.ndarray, shifts: list[int]) -> np.ndarray:
    """Words of a text in windows that agree with the item laid over it at one of the shifts."""
    size, out = min(WINDOW, len(other)), [np.zeros(0, np.int64)]
    for shift in shifts:
        low, high = max(0, -shift), min(len(other), len(words) - shift)
        if high - low >= size:
            wrong = np.concatenate(([0], np.cumsum(other[low:high] != words[low + shift : high + shift])))
            good = np.flatnonzero(wrong[size:] - wrong[:-size] <= allowed(size))
            out.append(np.unique(good[:, None] + np.arange(size)) + low + shift)
    return np.unique(np.concatenate(out))


def differences(places: list[int], others: list[int]) -> list[int]:
    """Every place minus other, once each, without making all pairs at a time."""
    a, b = np.array(places), np.array(others)
    if min(len(a), len(b)) == 1:
        return np.unique(np.subtract.outer(a, b)).tolist()
    seen = np.zeros(int(a.max() - a.min() + b.max() - b.min()) + 1, bool)
    few, many = (a - a.min(), b.max() - b) if len(a) < len(b) else (b.max() - b, a - a.min())
    for x in few:
        seen[many + x] = True
    return (np.flatnonzero(seen) + int(a.min() - b.max())).tolist()


def seed_table(texts: DataFrame, short: list[int], items: bool = False, sieve=None, bits: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """seed, key, places of texts (key, text), those only that the broadcast bit table has."""

    def cut(batches):
        for batch in batches:
            data, offsets = tx.buffer(batch.column(1))
            for a, b in tx.parts(offsets, part_bytes):
                seed, text, place = seeds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], short, items)
                if sieve is not None:
                    bit = seed >> np.uint64(64 - bits)
                    there = (sieve.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    seed, text, place = seed[there], text[there], place[there]
                order = np.lexsort((place, seed, text))
                seed, text, place = seed[order], text[order], place[order]
                heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(seed)), bool), (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(seed)), pa.int32()), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(seed[heads].view(np.int64)), batch.column(0).take(pa.array(text[heads] + a)), lists], names=["seed", "key", "places"])

    return texts.select("key", "text").mapInArrow(cut, "seed long, key long, places array<int>")


def _bits(seed_rows: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the leading bits of all seeds."""
    slot = seed_rows.select(F.shiftrightunsigned("seed", 64 - bits).alias("slot"))
    words = slot.selectExpr("cast(slot div 32 AS int) AS word", "shiftleft(1L, cast(slot % 32 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # bounded by 2^MOST_BITS / 32 rows
    out = np.zeros(1 << (bits - 5), "<u4")
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, item id, words covered, first and last covered word: one row per document and item that overlap.

    block_words: about so many words of items are hashed at a time in a task.
    """
    items = benchmark.select(F.col(item_col).alias("item"), whole(item_text).alias("text")).withColumn("key", F.xxhash64("item", "text"))
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    short = list(range(1, WINDOW))
    theirs = keep(seed_table(items, short, items=True, part_bytes=2 * block_words).distinct(), "seeds")  # a word and its space are two bytes or more
    short = [n for n in short if n in _short(items)]
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * theirs.count()).bit_length()))
    sieve = docs.sparkSession.sparkContext.broadcast(_bits(theirs, bits))
    hits = seed_table(rows, short, sieve=sieve, bits=bits).join(theirs.withColumnsRenamed({"key": "item_key", "places": "at"}).hint("merge"), "seed")

    def laid(batches):
        for batch in batches:
            shifts = [differences(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shifts, pa.list_(pa.int32()))], names=["key", "item_key", "shifts"])

    shifted = hits.select("key", "item_key", "places", "at").mapInArrow(laid, "key long, item_key long, shifts array<int>")
    pairs = shifted.select("key", "item_key", F.explode("shifts").alias("shift")).groupBy("key", "item_key").agg(F.collect_set("shift").alias("shifts"))
    pairs = pairs.join(items.select(F.col("key").alias("item_key"), "item", F.col("text").alias("other")).hint("merge"), "item_key")
    met = pairs.join(rows.hint("merge"), "key").select("id", "item", "text", "other", "shifts")
    names = ["id", "item", "words", "first_word", "last_word"]

    def compare(batches):
        for batch in batches:
            (words, first), (others, begin) = (word_hashes(*tx.buffer(batch.column(k))) for k in (2, 3))
            got = []
            for k, shifts in enumerate(batch.column(4).to_pylist()):
                if len(cover := covered(words[first[k] : first[k + 1]], others[begin[k] : begin[k + 1]], shifts)):
                    got.append((k, len(cover), int(cover[0]), int(cover[-1])))
            k, n, low, high = zip(*got) if got else ([],) * 4
            at = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (n, low, high))], names=names)

    ids, kinds = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    found = met.mapInArrow(compare, f"id {ids}, item {kinds}, words long, first_word long, last_word long")
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _short(items: DataFrame) -> set[int]:
    """Lengths of the items of fewer words than a window."""

    def lengths(batches):
        for batch in batches:
            size = np.unique(np.diff(word_hashes(*tx.buffer(batch.column(0)))[1]))
            yield pa.RecordBatch.from_arrays([pa.array(size[size < WINDOW], pa.int64())], names=["n"])

    return {r.n for r in items.select("text").mapInArrow(lengths, "n long").distinct().collect()}  # at most WINDOW rows


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, all columns. Rows with a null id are judged alike."""
    row = F.struct("*")
    keyed = docs.select(row.alias("row"), F.xxhash64(F.col(id_col), whole(text_col)).alias("key"))
    found = overlaps(keyed.select("key", F.col(f"row.{text_col}").alias("text")), benchmark, "key").select("key").distinct()
    return keyed.join(found, "key", "left_anti").select("row.*")
