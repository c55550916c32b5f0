"""Fill-in-middle transformation: each text is cut at two places and its middle moved to the end.

A cut after k units (code points, words or lines) needs the byte where unit k + 1 begins. The places where units
begin are kept as a set of 16-bit containers, one per 64 KB of the texts: a sorted array where
they are few, a bitmap where they are many, and runs where they follow one another (plain ASCII is one run).
Containers know how many places lie before them, so a cut is a binary search over containers and a select inside
one. Both cuts of all texts of a batch are looked up together; texts are not walked from their beginning. A set holds about 1 MB of texts, or one longer text.

Cases: null text counts as empty and stays plain; a null id draws as the empty id; repeated rows get equal cuts;
a text that holds a mark stays plain, so that every output can be undone; columns other than id and text are left
out, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.store import whole

SPAN = 1 << 16
#: Up to so many places an array is smaller than the 8 KB of a bitmap.
ARRAY_PLACES = 4096
PART_BYTES = 1 << 20
UNITS = ("char", "word", "line")
CUTS = "struct<n:bigint,first:bigint,second:bigint>"

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint16)
#: Place of the k-th one of a byte, least significant bit first.
_NTH = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _places = [k for k in range(8) if _byte >> k & 1]
    _NTH[_byte, : len(_places)] = _places


class ArrayContainer:
    """The low 16 bits of the places, in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)


class BitmapContainer:
    """One bit a place, with the ones before each 64 bytes."""

    BLOCK = 64

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(_ONES[self.bytes].reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64))))

    def select(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        ones = np.cumsum(_ONES[self.bytes.reshape(-1, self.BLOCK)[block]], axis=1, dtype=np.int64)
        at = (ones <= left[:, None]).sum(axis=1)
        left -= np.where(at > 0, ones[np.arange(len(k)), np.maximum(at - 1, 0)], 0)
        byte = block * self.BLOCK + at
        return byte * 8 + _NTH[self.bytes[byte], left]


class RunContainer:
    """First place of each run, and the places before it."""

    def __init__(self, low: np.ndarray, begins: np.ndarray):
        self.first, self.before = low[begins].astype(np.uint16), begins

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, "right") - 1
        return self.first[run] + (k - self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for sorted places below SPAN."""
    begins = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
    if 4 * len(begins) < min(2 * len(low), SPAN // 8):
        return RunContainer(low, begins)
    return ArrayContainer(low) if len(low) <= ARRAY_PLACES else BitmapContainer(low)


class BoundarySet:
    """The places of a flag array, by rank."""

    def __init__(self, flags: np.ndarray):
        lows = [np.flatnonzero(flags[a : a + SPAN]) for a in range(0, len(flags), SPAN)]
        self.containers = [container(low) if len(low) else None for low in lows]
        self.before = np.cumsum([0, *map(len, lows)])  # cumulative cardinalities

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of each rank, counted from 0."""
        held = np.searchsorted(self.before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        order = np.argsort(held, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(held[order])) + 1):
            if len(part):
                c = held[part[0]]
                out[part] = c * SPAN + self.containers[c].select(ranks[part] - self.before[c])
        return out


@dataclass(frozen=True)
class Marks:
    """Strings before the three parts."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def inside(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def boundaries(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte, and True for the end of the last text. A text that is not empty begins a
    unit; what stands before its first word belongs to its first unit; a line ends after its line feed."""
    begins = np.zeros(len(data) + 1, bool)
    if unit == "char":
        np.not_equal(data & 0xC0, 0x80, out=begins[:-1])
    elif unit == "line":
        np.equal(data, 0x0A, out=begins[1:])
    elif unit == "word":
        starts, _, first = tx.words(data, offsets)
        begins[starts] = True
        begins[starts[first[:-1][np.diff(first) > 0]]] = False
    else:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}")
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins[-1] = True
    return begins


def cut_places(texts: pa.Array, one: np.ndarray, other: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, byte of the first cut, byte of the second) of each text; the draws choose among its units + 1 places."""
    data, offsets = tx.buffer(texts)
    out = np.zeros((3, len(texts)), np.int64)
    for i, j in tx.parts(offsets, PART_BYTES):
        at = offsets[i : j + 1] - offsets[i]
        flags = boundaries(data[offsets[i] : offsets[j]], at, unit)
        places = BoundarySet(flags)
        rank = np.array([places.before[p // SPAN] + np.count_nonzero(flags[p - p % SPAN : p]) for p in at.tolist()])
        n = np.diff(rank)
        draws = one[i:j] % (n + 1), other[i:j] % (n + 1)
        out[0, i:j] = n
        for row, choose in ((1, np.minimum), (2, np.maximum)):
            out[row, i:j] = places.select(rank[:-1] + choose(*draws)) - at[:-1]
    return tuple(out)


def cuts(text: Column, one: Column, other: Column, unit: str = "char") -> Column:
    """Struct of n, first, second for each row; the text itself stays in the JVM."""

    def find(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        n, first, second = cut_places(texts, ones.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, first, second)], names=["n", "first", "second"])

    find.__annotations__ = {"texts": pa.Array, "ones": pa.Array, "others": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, CUTS)(text, one, other)


def _bytes(text: str, begin: Column, size: Column | None = None) -> Column:
    """Bytes of the text from a place on, as text."""
    return F.substring(F.col(text).cast("binary"), begin + 1, F.lit((1 << 31) - 1) if size is None else size).cast("string")


def middle_last(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", plain_percent: int = 10, suffix_first_percent: int = 20,
    salt: str = "1:", marks: Marks = Marks(),
) -> DataFrame:
    """id, n (units), form, prefix, middle, suffix (null if plain), output per row.

    The draws are the first four groups of eight hex digits of the sha256 of salt and id, so a row's cuts do not
    depend on its neighbours. Form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = {f"_h{k}": F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    rows = docs.select(F.col(id_col), whole(text_col).alias("_text"), digest.alias("_digest")).withColumns(drawn)
    plain = (F.col("_text") == "") | marks.inside(F.col("_text")) | (F.col("_h2") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select(id_col, "_text", form.alias("form"), cuts(F.col("_text"), F.col("_h0"), F.col("_h1"), unit).alias("_cut"))
    first, second = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
    split_up = F.col("form") != "plain"
    rows = rows.select(
        id_col, F.col("_cut.n").alias("n"), "form", "_text", F.when(split_up, _bytes("_text", F.lit(0), first)).alias("prefix"),
        F.when(split_up, _bytes("_text", first, second - first)).alias("middle"), F.when(split_up, _bytes("_text", second)).alias("suffix"))
    psm = F.concat(F.lit(marks.prefix), "prefix", F.lit(marks.suffix), "suffix", F.lit(marks.middle), "middle")
    spm = F.concat(F.lit(marks.suffix), "suffix", F.lit(marks.prefix), "prefix", F.lit(marks.middle), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return rows.select(id_col, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(form: Column, output: Column, marks: Marks = Marks()) -> Column:
    """The text an output was made from, from output and form alone. The parts hold no mark and a mark begins only at
    its own first character, so an output falls apart where its marks were put."""
    parts = F.split(output, "|".join(re.escape(m) for m in (marks.prefix, marks.suffix, marks.middle)), -1)
    one, other, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, other)).when(form == "spm", F.concat(other, middle, one)).otherwise(output)
