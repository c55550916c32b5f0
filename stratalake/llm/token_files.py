"""Token files of patched frame-of-reference blocks.

A file row ("segment") holds the ids of whole documents, in ascending id order:

    magic, values, blocks, exceptions | block minima | widths | exceptions per block | block starts
    | packed payload | exception places | exception high bits

A block is 128 values less the block's minimum, packed at one width. The width is the bit length at one
of five percentiles of the block, whichever makes the block smallest; values that need more bits keep
their low bits in place and their high bits in the exception list. Block starts index the payload, so a
block can be read alone. Segments are rows of a Parquet table: Spark commits them, and a lost executor
leaves no half-written file.

Cases: null text counts as empty and gives just the end id; equal ids keep the order of their texts;
null ids come first; an empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratalake.llm.store import new_folder, whole
from stratalake.llm.tokens import encoded

BLOCK = 128
PERCENTILES = (100, 97, 94, 88, 75)
SEGMENT_IDS = 1 << 20
HEAD = struct.Struct("<4sQII")
MAGIC = b"PFR1"
END_ID = 0


BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    low = BITS[x & 0xFFFF]
    high = BITS[x >> 16]
    return np.where(high > 0, high + 16, low).astype(np.uint8) if high.any() else low


def _to_bits(rows: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each value of each row, packed."""
    if w in (8, 16, 32):
        return rows.astype(f"<u{w // 8}").view(np.uint8)
    size = 2 if w < 16 else 4
    planes = np.unpackbits(rows.astype(f"<u{size}").view(np.uint8).reshape(*rows.shape, size), axis=2, bitorder="little")
    return np.packbits(planes[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")


def _from_bits(packed: np.ndarray, w: int) -> np.ndarray:
    """The inverse of _to_bits."""
    if w in (8, 16, 32):
        return packed.view(f"<u{w // 8}").astype(np.uint32)
    size = 2 if w < 16 else 4
    planes = np.zeros((len(packed), BLOCK, size * 8), np.uint8)
    planes[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, w)
    return np.packbits(planes, axis=2, bitorder="little").view(f"<u{size}")[:, :, 0].astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as one segment."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = values
    if blocks:
        grid[n:] = grid[(blocks - 1) * BLOCK]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    bits = _bit_length(grid)
    ordered = np.sort(bits, axis=1)
    tries = np.stack([ordered[:, min(BLOCK - 1, BLOCK * p // 100 - (p == 100))] for p in PERCENTILES])
    cost = tries.astype(np.int64) * (BLOCK // 8) + 5 * (bits[None] > tries[:, :, None]).sum(axis=2)
    width = tries[cost.argmin(axis=0), np.arange(blocks)] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))))
    payload = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = _to_bits(grid[rows], int(w))
        payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    at_block, place = np.nonzero(over)
    high = (grid[at_block, place].astype(np.uint64) >> width[at_block].astype(np.uint64)).astype("<u4")
    return b"".join((
        HEAD.pack(MAGIC, n, blocks, len(place)), low.astype("<u4").tobytes(), width.tobytes(), over.sum(axis=1).astype(np.uint8).tobytes(),
        starts.astype("<u8").tobytes(), payload.tobytes(), place.astype(np.uint8).tobytes(), high.tobytes()))


class Segment:
    """Reads blocks of a segment."""

    def __init__(self, raw: bytes):
        magic, self.n, self.blocks, exceptions = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        take = lambda kind, n: np.frombuffer(raw, kind, n, at)
        self.low = take("<u4", self.blocks)
        at += 4 * self.blocks
        self.width = take(np.uint8, self.blocks)
        at += self.blocks
        self.outliers = np.concatenate(([0], np.cumsum(take(np.uint8, self.blocks).astype(np.int64))))
        at += self.blocks
        self.starts = take("<u8", self.blocks + 1).astype(np.int64)
        at += 8 * (self.blocks + 1)
        self.payload = take(np.uint8, int(self.starts[-1]))
        at += int(self.starts[-1])
        self.place = take(np.uint8, exceptions)
        at += exceptions
        self.high = take("<u4", exceptions)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The values of blocks first to last (excluded); all by default."""
        last = self.blocks if last is None else last
        width = self.width[first:last]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            packed = self.payload[self.starts[first + rows][:, None] + np.arange(int(w) * BLOCK // 8)]
            out[rows] = _from_bits(packed, int(w))
        span = slice(self.outliers[first], self.outliers[last])
        at = np.repeat(np.arange(last - first), np.diff(self.outliers[first : last + 1]))
        out[at, self.place[span]] |= self.high[span] << width[at].astype(np.uint32)
        out += self.low[first:last, None]
        return out.reshape(-1)[: self.n - first * BLOCK]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, add the end id, and write segments in ascending id order under path."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def segments(batches):
        shard, number, ids, sizes, held, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def segment():
            values = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "segment": pa.array([number], pa.int64()), "n_ids": pa.array([len(values)], pa.int64()),
                "ids": pa.array([ids], pa.list_(id_type)), "sizes": pa.array([sizes], pa.list_(pa.int64())), "data": pa.array([pack(values)], pa.binary())})

        id_type = None
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), encoded(tokenizer_path, batch.column(1))):
                held += (raw, end)
                ids.append(doc)
                sizes.append(len(raw) // 4 + 1)
                total += sizes[-1]
                if total >= segment_ids:
                    yield segment()
                    number, ids, sizes, held, total = number + 1, [], [], [], 0
        if ids:
            yield segment()

    kind = rows.schema["id"].dataType.simpleString()
    rows.mapInArrow(segments, f"shard long, segment long, n_ids long, ids array<{kind}>, sizes array<long>, data binary").write.parquet(path)


def read_token_files(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def read(batches):
        for batch in batches:
            for shard, segment, ids, sizes, data in zip(*(batch.column(k).to_pylist() for k in ("shard", "segment", "ids", "sizes", "data"))):
                values = Segment(data).read().astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * len(ids), pa.int64()), "segment": pa.array([segment] * len(ids), pa.int64()),
                    "id": pa.array(ids, batch.schema.field("ids").type.value_type), "inside": pa.array(ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(values[e - n : e]) for e, n in zip(ends, sizes)], pa.int64())})

    docs = files.select("shard", "segment", "ids", "sizes", "data").mapInArrow(
        read, f"shard long, segment long, id {kind}, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("shard", "segment", "n_ids")
    # one row per shard in the window over all, one per segment in the windows by shard
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    before = sizes.withColumn("own", own).join(shards, "shard").select("shard", "segment", (F.col("own") + F.col("before_shard")).alias("before"))
    return docs.join(before, ["shard", "segment"]).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (by default to a new folder in the shared checkpoint folder) and read them back."""
    path = path or new_folder(docs, "token-files")
    write_token_files(docs, tokenizer_path, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path, id_col)
