"""Byte-level BPE by a file of ranks: encoding and decoding of whole texts.

A text is split by a pattern into pieces, and each piece is merged by itself: of all neighbouring pairs whose bytes
together are in the vocabulary, the pair of the lowest rank is joined, the leftmost first, until none is left.

The merges are a fold in Spark's higher-order functions over the bytes of a piece. The state is the ids so far and
the rank of each neighbouring pair; a step joins one pair and looks up the two pairs that changed. Ranks come from
a literal: buckets of (left id, right id) -> rank, for every way to cut a piece of the vocabulary in two pieces of
it, so that a lookup reads one small list. In pieces of more than LONG ids a step joins all pairs of the lowest rank
at once, if the pairs this makes have no lower rank; else one, as ever. So a long run of one letter takes few steps.

Each distinct piece is merged once. Texts become packs of up to PACK_BYTES: the pack's distinct pieces, and a code
for each place, written in buckets. Up to HEAD frequent pieces are merged first and sent to the tasks; the other pieces
of all packs meet by piece, the first of a kind is merged, and ids go back to every pack that holds it, where they
replace the codes; the packs themselves are not shuffled. Decoding concatenates the vocabulary's bytes for each id.

Cases: null text counts as empty and has no ids; null ids, repeated rows and other columns change nothing; ids
outside the vocabulary cannot be decoded and are an error. Character classes of the pattern cover all of Unicode.
The time for one piece of n bytes that never repeats a pair grows with n squared (100 KB without a space).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratalake.llm.store import keep, keep_in_buckets, whole

PACK_BYTES = 16 << 20
#: Frequent pieces sent to the tasks, the packs in which they are looked for, and the longest one.
HEAD, HEAD_PACKS, HEAD_BYTES = 1 << 18, 8, 64
#: Packs in a bucket.
PACKS = 4
SLICE = 1 << 19
LONG = 64
BUCKETS = 65_537
#: Stands for the rank of a pair that is no piece of the vocabulary; above all ranks.
NO_RANK = (1 << 31) - 1
ID = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank of a file with a base64 piece and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left rank, right rank) -> rank of both pieces together."""
    cut = ((piece[:k], piece[k:], rank) for piece, rank in ranks.items() for k in range(1, len(piece)))
    return {(ranks[a], ranks[b]): rank for a, b, rank in cut if a in ranks and b in ranks}


def not_made(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> dict[bytes, int]:
    """Pieces of the vocabulary that merges of their own bytes do not end in; as a whole piece each is one id all the same."""
    out = {}
    for piece, rank in ranks.items():
        ids = [ranks[piece[k : k + 1]] for k in range(len(piece))]
        while len(ids) > 1:
            low, at = min((pairs.get(pair, NO_RANK), k) for k, pair in enumerate(zip(ids, ids[1:])))
            if low == NO_RANK:
                break
            ids[at : at + 2] = [low]
        if ids != [rank]:
            out[piece] = rank
    return out


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Merges:
    """The merges of one vocabulary as columns. While a piece is merged, an id and the rank of the pair it begins are one
    number: rank * 2^32 + id."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        pairs = pair_ranks(ranks)
        # Plans show literals in full, so these are written in small numbers. A pair is left * size + right; its bucket is
        # the remainder, and the bucket holds null, then the quotient as a negative number and the rank of each pair.
        self.size = max(ranks.values()) + 1
        buckets: list[list] = [[] for _ in range(BUCKETS)]
        for (left, right), rank in pairs.items():
            quotient, bucket = divmod(left * self.size + right, BUCKETS)
            buckets[bucket] += [-1 - quotient, rank]
        listed = json.dumps([[None, *b] if b else b for b in buckets], separators=(",", ":"))
        first = [ranks[bytes([b])] for b in range(256)]
        begins = [first, [pairs.get((a, b), -1) for a in first for b in first]]
        # literals once Spark has folded them
        self.table = F.from_json(F.lit(listed), "array<array<bigint>>")
        self.begins = F.from_json(F.lit(json.dumps(begins, separators=(",", ":"))), "array<array<bigint>>")
        self.whole_pieces = not_made(ranks, pairs)

    def _rank(self, table: Column, left: Column, right: Column) -> Column:
        """Rank of a pair of ids."""

        def of(pair: Column) -> Column:
            bucket = F.get(table, (pair % BUCKETS).cast("int"))
            quotient = -1 - F.floor(pair / BUCKETS)
            # array_position counts from 1 and is 0 if the pair is not there, where the bucket has null
            return F.coalesce(F.get(bucket, F.array_position(bucket, quotient).cast("int")), F.lit(NO_RANK).cast("bigint"))

        return _with(left * self.size + right, of)

    def _joined(self, table: Column, left: Column, right: Column) -> Column:
        """left as a number, with the rank of its pair with right (null: none)."""
        rank = F.when(right.isNull(), F.lit(NO_RANK).cast("bigint")).otherwise(self._rank(table, left, right))
        return F.shiftleft(rank, 32) + left

    def _join_one(self, table: Column, s: Column, rank: Column) -> Column:
        """The leftmost pair of the rank becomes one id."""
        near = lambda k: F.get(s, k).bitwiseAND(ID)

        def joined(at: Column) -> Column:  # counted from 0; all before the pair stay, all after it move up
            def place(x: Column, k: Column) -> Column:
                return (F.when(k == at, self._joined(table, rank, near(at + 2))).when(k > at, F.get(s, k + 1))
                        .when(k == at - 1, self._joined(table, x.bitwiseAND(ID), rank)).otherwise(x))

            return F.transform(F.slice(s, F.lit(1), F.size(s) - 1), place)

        return _with((F.array_position(F.transform(s, lambda x: F.shiftright(x, 32)), rank) - 1).cast("int"), joined)

    def _join_all(self, table: Column, s: Column, rank: Column) -> Column:
        """All pairs of the rank, from the left and without overlap, if joining them one by one would do the same: no pair
        that arises on the way may have a lower rank."""
        marks = F.array_join(F.transform(s, lambda x: F.when(F.shiftright(x, 32) == rank, "1").otherwise("0")), "")
        chosen = F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")

        def joined(at: Column) -> Column:
            is_at = lambda k: F.coalesce(F.get(at, k) == "1", F.lit(False))
            id_of = lambda x: x.bitwiseAND(ID)
            left = F.filter(F.transform(s, lambda x, k: F.when(is_at(k), rank).when(is_at(k - 1), -1).otherwise(id_of(x))), lambda x: x >= 0)
            # between two joins the first stands beside the left part of the next
            between = F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda k: is_at(k) & is_at(k + 2) & (self._rank(table, rank, id_of(F.get(s, k + 2))) < rank))
            both = _with(left, lambda ids: F.transform(ids, lambda x, k: self._joined(table, x, F.get(ids, k + 1))))
            return _with(both, lambda b: F.when(between | (F.shiftright(F.array_min(b), 32) < rank), self._join_one(table, s, rank)).otherwise(b))

        return _with(chosen, joined)

    def ids(self, piece: Column) -> Column:
        """Ids of a piece that is not empty."""
        # one Latin letter for each byte
        letters = F.split(F.decode(piece.cast("binary"), "ISO-8859-1"), "")
        size = F.octet_length(piece)
        codes = F.slice(F.transform(letters, F.ascii), F.lit(1), size)

        def begin(codes: Column, begins: Column) -> Column:
            def number(c: Column, k: Column) -> Column:
                rank = F.get(F.get(begins, F.lit(1)), c * 256 + F.get(codes, k + 1))
                return F.shiftleft(F.when(rank >= 0, rank).otherwise(NO_RANK).cast("bigint"), 32) + F.get(F.get(begins, F.lit(0)), c)

            return F.transform(codes, number)

        def fold(table: Column, first: Column) -> Column:
            def state(s: Column) -> Column:
                return F.struct(s.alias("s"), F.shiftright(F.array_min(s), 32).alias("rank"))

            def step(held: Column, _: Column) -> Column:
                s, rank = held["s"], held["rank"]
                later = F.when(F.size(s) <= LONG, self._join_one(table, s, rank)).otherwise(self._join_all(table, s, rank))
                return F.when(rank == NO_RANK, held).otherwise(_with(later, state))

            return F.aggregate(F.sequence(F.lit(1), size), state(first), step, lambda held: F.transform(held["s"], lambda x: x.bitwiseAND(ID)))

        starts = _with(self.begins, lambda begins: _with(codes, lambda c: begin(c, begins)))
        merged = _with(self.table, lambda table: _with(starts, lambda first: fold(table, first))).cast("array<int>")
        for known, rank in self.whole_pieces.items():
            merged = F.when(piece.cast("binary") == F.lit(known), F.array(F.lit(rank))).otherwise(merged)
        return merged


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed by planes of their bytes."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _from_planes(planes: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(planes, 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)


def packs(docs: DataFrame, id_col: str, text_col: str, pattern: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """pack, ids, sizes (pieces of each text), codes (place of each piece in words), words (distinct pieces, the frequent
    first), as a table written in buckets of packs."""
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(whole(text_col), F.lit("(?U)" + pattern), F.lit(0)).alias("pieces"))
    kind = rows.schema["id"].dataType.simpleString()

    def packed(number: int, ids: list, sizes: list, pieces: list) -> pa.RecordBatch:
        found = pa.chunked_array(pieces, pa.string()).combine_chunks().dictionary_encode()
        codes = found.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(found.dictionary)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        lists = [pa.concat_arrays(ids), pa.array(np.concatenate(sizes), pa.int32()), found.dictionary.take(pa.array(order))]
        ids, sizes, words = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, sizes, pa.array([_planes(place[codes])], pa.binary()), words], names=["pack", "ids", "sizes", "codes", "words"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = ([], [], []), 0
        for batch in batches:
            lists = batch.column(1)
            begin, ends = 0, np.append(0, np.cumsum(pa.compute.binary_length(lists.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            upto = ends[at]  # bytes before each text
            while begin < len(lists):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + pack_bytes - size, "right")) - 1)
                part = lists.slice(begin, end - begin)
                held[0].append(batch.column(0).slice(begin, end - begin))
                held[1].append(np.diff(at[begin : end + 1]))
                held[2].append(part.flatten())
                size += int(upto[end] - upto[begin])
                begin = end
                if size >= pack_bytes or begin < len(lists):
                    yield packed(number, *held)
                    number += 1
                    held, size = ([], [], []), 0
        if held[0]:
            yield packed(number, *held)

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return keep_in_buckets(rows.mapInArrow(gather, f"pack long, ids array<{kind}>, sizes array<int>, codes binary, words array<string>"), "packs", "pack", size // (PACKS * pack_bytes))


def frequent_pieces(packed: DataFrame, merges: Merges, head: int) -> DataFrame:
    """word, merged of at most `head` pieces of at most HEAD_BYTES that many packs hold, as a written table. Which pieces
    these are is seen in the first packs alone; it saves work and changes no result."""
    first = [row.pack for row in packed.select("pack").orderBy("pack").limit(HEAD_PACKS).collect()]
    words = packed.where(F.col("pack").isin(first)).select(F.explode("words").alias("word")).where(F.octet_length("word") <= HEAD_BYTES)
    common = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(head).select("word")
    return keep(common.repartition("word").select("word", merges.ids(F.col("word")).alias("merged")), "head")


def encoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK_BYTES, head: int = HEAD, decode: bool = False,
) -> DataFrame:
    """id, ids (array of int) per row; with `decode` also decoded, the bytes that the ids stand for, in the same tasks."""
    packed = packs(docs, id_col, text_col, pattern, pack_bytes)
    ranks = read_ranks(path)
    merges = Merges(ranks)
    pieces = docs.sparkSession.sparkContext.broadcast(Vocabulary.listed(ranks) if decode else [])  # bounded by the vocabulary
    frequent = frequent_pieces(packed, merges, head)
    sent = docs.sparkSession.sparkContext.broadcast(frequent.toArrow())  # bounded by `head` and HEAD_BYTES
    # the first row of a piece has it merged, the piece's other packs take over what came out
    same = Window.partitionBy("word").orderBy("pack")
    words = packed.select("pack", F.posexplode("words").alias("place", "word")).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    words = words.withColumn("first", F.row_number().over(same) == 1).withColumn("merged", F.when(F.col("first"), merges.ids(F.col("word"))))
    words = words.withColumn("merged", F.first("merged").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def texts(held: pa.Table, found: pa.Table) -> pa.Table:
        """The texts of one pack: its codes replaced by the ids of its pieces."""
        names = ["id", "ids", "decoded"][: 3 if decode else 2]
        kinds = [held.schema.field("ids").type.value_type, pa.list_(pa.int32()), pa.binary()][: len(names)]
        vocabulary = Vocabulary(pieces.value) if decode else None
        if not held.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, sizes = (held.column(c).combine_chunks().flatten() for c in ("ids", "sizes"))
        known = sent.value
        at = pa.compute.index_in(held.column("words").combine_chunks().flatten(), known.column("word").combine_chunks())
        merged = pa.concat_arrays([
            known.column("merged").combine_chunks().cast(kinds[1]),
            found.column("merged").combine_chunks().take(pa.compute.sort_indices(found.column("place"))).cast(kinds[1])])
        rare = at.is_null().to_numpy(zero_copy_only=False)
        which = at.fill_null(0).to_numpy().astype(np.int64)
        which[rare] = known.num_rows + np.arange(rare.sum())
        start = merged.offsets.to_numpy().astype(np.int64)
        values, length, start = merged.values.to_numpy(), np.diff(start)[which], start[:-1][which]
        upto = np.append(0, np.cumsum(sizes.to_numpy(), dtype=np.int64))
        codes = _from_planes(held.column("codes")[0].as_py(), int(upto[-1]))
        out, begin = [], 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + SLICE, "right")) - 1)
            these = codes[upto[begin] : upto[end]]
            n = length[these]
            ends = np.append(0, np.cumsum(n))
            places = np.repeat(start[these] - ends[:-1], n) + np.arange(ends[-1])
            offsets = pa.array(ends[upto[begin : end + 1] - upto[begin]], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(values[places], pa.int32()))
            out.append(pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), lists, *([vocabulary.decode(lists)] if decode else [])], names=names))
            begin = end
        return pa.Table.from_batches(out)

    answers = words.select(F.col("pack").alias("of_pack"), "place", "merged").groupBy("of_pack")
    out = packed.groupBy("pack").cogroup(answers).applyInArrow(texts, f"id {kind}, ids array<int>" + ", decoded binary" * decode)
    return out.withColumnRenamed("id", id_col)


class Vocabulary:
    """Pieces by id."""

    def __init__(self, pieces: list[bytes | None]):
        self.pieces = pa.array(pieces, pa.large_binary())

    @staticmethod
    def listed(ranks: dict[bytes, int]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            out[rank] = piece
        return out

    def part(self, flat: pa.Array, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of some lists of ids, and where each list ends in them."""
        if flat.null_count or len(flat) and not (0 <= pa.compute.min(flat).as_py() and pa.compute.max(flat).as_py() < len(self.pieces)):
            raise ValueError("an id is not in the vocabulary")
        taken = self.pieces.take(flat)
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        if not len(flat):
            return b"", np.zeros(len(ends), np.int64)
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)
        return memoryview(data)[: at[len(flat)]].tobytes(), at[ends]

    def decode(self, lists: pa.Array) -> pa.Array:
        """Bytes of each list, worked out for about SLICE ids at a time."""
        flat = lists.flatten()
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
        texts, offsets, begin, before, length = [], [np.zeros(1, np.int64)], 0, 0, 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            text, at = self.part(flat.slice(before, ends[end - 1] - before), ends[begin:end] - before)
            texts.append(text)
            offsets.append(at + length)
            begin, before, length = end, ends[end - 1], length + len(text)
        there = pa.compute.is_valid(lists).to_numpy(zero_copy_only=False)
        buffers = [np.packbits(there, bitorder="little").tobytes(), np.concatenate(offsets).tobytes(), b"".join(texts)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [pa.py_buffer(b) for b in buffers]).cast(pa.binary())


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """Bytes of an array of ids; null stays null."""
    sent = spark.sparkContext.broadcast(Vocabulary.listed(read_ranks(path)))  # bounded by the vocabulary

    def join(lists: pa.Array) -> pa.Array:
        return Vocabulary(sent.value).decode(lists)

    join.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(join, "binary")(ids)
