"""Exact deduplication by Grace hashing.

Each task first folds its own copies, so a text with any number of copies reaches its reducer once a
task. The reducer puts entries into an open-addressing table that compares complete contents. When the
table outgrows its budget, its entries and the rest of the input go to spill files by four bits of the
hash, and each file is handled the same way with the next four bits.

Cases: null text counts as empty; empty texts are copies of each other; rows with a null id lose
against any id; of rows alike in id and text one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stratalake.llm.store import keep, whole

BUDGET = 48 << 20
FAN_BITS = 4
HASH_BITS = 64
FLUSH_ROWS = 2000


class Entry:
    """A distinct text: its key and content, how many rows, the row that stays, how many are alike it in id."""

    __slots__ = ("key", "text", "rows", "top", "ties", "rest")

    def __init__(self, key, text, rows, top, ties, rest):
        self.key, self.text, self.rows, self.top, self.ties, self.rest = key, text, rows, top, ties, rest

    def fold(self, other: "Entry") -> None:
        self.rows += other.rows
        mine, theirs = _rank(self.top), _rank(other.top)
        if mine == theirs:
            self.ties += other.ties
            if repr(other.rest) > repr(self.rest):
                self.rest = other.rest
        elif theirs > mine:
            self.top, self.ties, self.rest = other.top, other.ties, other.rest


def _rank(value):
    return (value is not None, value if value is not None else 0)


class Table:
    """Open addressing with linear probing; equal means equal key and equal content."""

    def __init__(self):
        self.slots: list = [None] * 1024
        self.hashes: list[int] = [0] * 1024
        self.used = 0
        self.size = 0

    def add(self, value: int, entry: Entry) -> None:
        mask = len(self.slots) - 1
        at = value & mask
        while (there := self.slots[at]) is not None:
            if self.hashes[at] == value and there.key == entry.key and there.text == entry.text:
                there.fold(entry)
                return
            at = (at + 1) & mask
        self.slots[at], self.hashes[at] = entry, value
        self.used += 1
        self.size += len(entry.text) + 200
        if 2 * self.used > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        old = [(h, e) for h, e in zip(self.hashes, self.slots) if e is not None]
        n = 2 * len(self.slots)
        self.slots, self.hashes = [None] * n, [0] * n
        for value, entry in old:
            at = value & (n - 1)
            while self.slots[at] is not None:
                at = (at + 1) & (n - 1)
            self.slots[at], self.hashes[at] = entry, value

    def items(self) -> Iterator[tuple[int, Entry]]:
        return ((h, e) for h, e in zip(self.hashes, self.slots) if e is not None)


def _hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Entry]]:
    for batch in batches:
        columns = [c.cast(pa.binary()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
        for key, text, rows, top, ties, rest in zip(*(c.to_pylist() for c in columns)):
            yield _hash(text), Entry(key, text, rows, top, ties, rest)


def _batches(entries: Iterable[Entry], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e.text)
        if len(held) >= FLUSH_ROWS or size > 8 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[Entry], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field in schema:
        values = [getattr(e, field.name) for e in held]
        if field.name == "text":
            columns.append(pa.array(values, pa.binary()).cast(field.type))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def distinct(entries: Iterable[tuple[int, Entry]], schema: pa.Schema, budget: int, level: int = 0) -> Iterator[Entry]:
    """One entry per distinct (key, text), with bounded memory: the Grace recursion."""
    table = Table()
    entries = iter(entries)
    shift = HASH_BITS - FAN_BITS * (level + 1)
    for value, entry in entries:
        table.add(value, entry)
        if table.size > budget and shift >= 0:
            break
    else:
        yield from (e for _, e in table.items())
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [_Spill(os.path.join(folder, str(k)), schema) for k in range(1 << FAN_BITS)]
        for source in (table.items(), entries):
            for value, entry in source:
                files[value >> shift & (1 << FAN_BITS) - 1].write(entry)
            table = None
        for spill in files:
            spill.close()
        for spill in files:
            yield from distinct(_entries(spill.read()), schema, budget, level + 1)


class _Spill:
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema, self.held, self.size = path, schema, [], 0
        self.writer = pa.ipc.new_stream(path, schema)

    def write(self, entry: Entry) -> None:
        self.held.append(entry)
        self.size += len(entry.text)
        if self.size > 1 << 19 or len(self.held) >= FLUSH_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_batch(_batch(self.held, self.schema))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()

    def read(self) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(self.path) as reader:
            yield from reader
        os.unlink(self.path)


def _folded(docs: DataFrame, id_col: str, text_col: str, key: Column | None, carry: bool, budget: int) -> DataFrame:
    """One row per distinct text: key, text, rows, top id, ties, and with carry the staying row."""
    text = whole(text_col)
    rest = F.struct("*") if carry else F.lit(None).cast("string")
    rows = docs.select(
        (key if key is not None else F.sha2(text, 256)).alias("key"), text.alias("text"), F.lit(1).cast("long").alias("rows"),
        F.col(id_col).alias("top"), F.lit(1).cast("long").alias("ties"), rest.alias("rest"))

    def fold(batches):
        # what a task folds before the shuffle; a full table is passed on and begun anew
        table, schema = Table(), None
        for batch in batches:
            schema = schema or batch.schema
            for value, entry in _entries([batch]):
                table.add(value, entry)
                if table.size > budget:
                    yield from _batches((e for _, e in table.items()), schema)
                    table = Table()
        if schema is not None:
            yield from _batches((e for _, e in table.items()), schema)

    def reduce(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            schema = first.schema

            def again():
                yield first
                yield from batches

            yield from _batches(distinct(_entries(again()), schema, budget), schema)

    return rows.mapInArrow(fold, rows.schema).repartition("key").mapInArrow(reduce, rows.schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None,
                 budget: int = BUDGET) -> DataFrame:
    """Per row: its id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    key is a hash of the text that equal texts share (default: SHA-256). Texts that differ but share a key
    are told apart by content, also when rows are looked up.
    """
    folded = _folded(docs, id_col, text_col, key, False, budget)
    clash = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
    groups = keep(folded.withColumn("clash", clash).where("rows > 1 OR clash").select(
        "key", F.when(F.col("clash"), F.col("text")).alias("content"), F.col("top").alias("keep_id"),
        F.col("rows").alias("group_size"), "ties", "clash"), "groups")
    text = whole(text_col)
    clashes, repeats = groups.agg(F.max("clash"), F.max("ties")).first()
    rows = docs.select(F.col(id_col), F.sha2(text, 256).alias("text_sha256"), (key if key is not None else F.sha2(text, 256)).alias("key"),
                       *([text.alias("content")] if clashes else []))
    if clashes:
        clear = groups.where("NOT clash").drop("content", "clash").withColumnsRenamed({"keep_id": "k1", "group_size": "g1", "ties": "t1"})
        mixed = groups.where("clash").drop("clash").withColumnsRenamed({"keep_id": "k2", "group_size": "g2", "ties": "t2"})
        found = rows.join(clear, "key", "left").join(mixed, ["key", "content"], "left").select(
            "*", F.when(F.col("g2").isNotNull(), F.col("k2")).otherwise(F.col("k1")).alias("keep_id"),
            F.coalesce("g2", "g1").alias("group_size"), F.coalesce("t2", "t1").alias("ties"))
    else:
        found = rows.join(groups.drop("content", "clash"), "key", "left")
    single = F.col("group_size").isNull()
    found = found.select(
        id_col, F.when(single, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
        F.coalesce("ties", F.lit(1)).alias("ties"), *(["content"] if clashes else []))
    if (repeats or 1) > 1:
        alike = Window.partitionBy("text_sha256", *(["content"] if clashes else [])).orderBy(F.lit(0))
        tied = (F.col("ties") > 1) & F.col("kept")
        found = found.where(~tied).unionByName(found.where(tied).withColumn("kept", F.row_number().over(alike) == 1))
    return found.drop("ties", "content")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, all columns: of equal texts the row with the largest id. One shuffle."""
    return _folded(docs, id_col, text_col, None, True, budget).select("rest.*")
