"""Repeated substrings across documents, found with suffix arrays: each byte goes that is covered by a string of
LENGTH bytes which also starts in a document with a smaller id.

A window is LENGTH bytes of one document. Equal windows have the same smallest GRAM hash inside, so windows
are dealt by it: a run of windows with the same smallest hash is one segment, and equal windows meet in the
same shard whatever stands around them.

1. Documents are put into packs of about PACK_BYTES, which are written and keep their place.
2. Per pack the distinct smallest hashes go to their shard; the shard answers with a bit each: does it occur
   in another document? Windows with a hash of their own cannot repeat and go no further.
3. The other segments, once per pack with the smallest id, go to their shard, each distinct one with its
   smallest id. Suffix arrays of the shard are induced, places are grouped by permuted common prefixes of
   LENGTH bytes, and each window gets the smallest id of its group. The answer is a bit for each window.
4. Packs meet their answers, find their segments again, and bytes under answered windows are cut out.

A passage that a third of all documents hold reaches its shard once per pack. There are more shards for more
text, and shards are cut by more bits of the hash where their text is larger than one suffix array should be.
Where the segments of a single hash are larger (a common run of GRAM bytes, in ever other surroundings), their
windows are dealt anew by the smallest hash of the longer runs in LONGER, some of them at a time; the last of these
is the window itself, and equal windows are one text.

Cases: null text counts as empty and has nothing removed; texts shorter than LENGTH keep all; documents with
equal ids leave each other alone; a null id counts as smaller than all others. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.store import keep, whole
from stratalake.llm.suffix_array import permuted_prefixes, suffix_array
from stratalake.session import shuffles_freed

LENGTH = 50
GRAM = 20
LONGER = (35, LENGTH)
PACK_BYTES = 4 << 20
CHUNK = 1 << 19
SOME = 1 << 14  # segments at a time
ARRAY_BYTES = 1 << 20
ROUND = 4  # arrays whose bytes are cut anew at a time
SHARDS_EACH = 8
SHARD_BYTES = 1 << 20  # of packs as written, for each shard at most
MARK = 1  # between segments; 0 ends the text of a shard, bytes follow from 2
NO_ID = np.iinfo(np.int64).min


def _zip(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (a.tobytes() for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _bits(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask, bitorder="little")


def _mask(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n, bitorder="little").astype(bool)


def _smallest(data: np.ndarray, gram: int) -> np.ndarray:
    """For every window of LENGTH bytes: the smallest mixed hash of its runs of `gram` bytes."""
    with np.errstate(over="ignore"):
        h, base, have = data.astype(np.uint64) + np.uint64(1), tx.BASE, 1
        powers = {1: (h, base)} if gram & 1 else {}
        while 2 * have <= gram:
            h = h[:-have] * base + h[have:]
            base, have = base * base, 2 * have
            if gram & have:
                powers[have] = (h, base)
        left, total, done = gram - have, h, have
        for size in sorted(powers, reverse=True):
            if left >= size:
                more, factor = powers[size]
                n = len(data) - done - size + 1
                total = total[:n] * factor + more[done : done + n]
                left, done = left - size, done + size
    low, wide, want = tx.mix(total), 1, LENGTH - gram + 1
    while 2 * wide <= want:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    return np.minimum(low[: len(low) - (want - wide)], low[want - wide :])


def segments(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, hash) of each run of windows of a text with the same smallest hash."""
    found = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        end = min(begin + CHUNK, len(data) - LENGTH + 1)
        low = _smallest(data[begin : end + LENGTH - 1], gram)
        # windows that reach over the end of their text are not windows
        a, b = np.searchsorted(offsets, [begin, end + LENGTH])
        steps = np.zeros(end - begin + 1, np.int32)
        for e in offsets[max(0, a - 1) : b + 1]:
            lo, hi = max(e - LENGTH + 1, begin, 0), min(e, end)
            if lo < hi:
                steps[lo - begin] += 1
                steps[hi - begin] -= 1
        inside = np.cumsum(steps[:-1]) == 0
        edge = np.zeros(end - begin, bool)
        edge[0] = True
        edge[offsets[(offsets >= begin) & (offsets < end)] - begin] = True
        start = inside & edge
        start[1:] |= inside[1:] & (~inside[:-1] | (low[1:] != low[:-1]))
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        first, last = np.flatnonzero(start), np.flatnonzero(stop)
        # the smallest of many hashes is a small number; mixed once more they are spread evenly over the shards
        found.append((first + begin, last - first + 1, tx.mix(low[first])))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first, count, low = (np.concatenate(x) for x in zip(*found))
    return np.searchsorted(offsets, first, "right") - 1, first, count, low


def _shard(low: np.ndarray, shards: int) -> np.ndarray:
    return ((low >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _by(rows: Iterator[tuple], k: int) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows equal at k, of rows sorted by it."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][k] != row[k]:
            yield held[0][k], held
            held = []
        held.append(row)
    if held:
        yield held[0][k], held


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes)) + 64
        if weight > size << 10:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


#: Rows that travel: pack, kind, shard, blob. Kinds: a pack's texts, bits of shared hashes, segments, bits of windows.
PACK, SHARED, SEGMENTS, WINDOWS = range(4)
TRAVEL = "pack long, kind int, shard int, blob binary"
TRAVEL_ARROW = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary())])
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _packs(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0

        def made():
            nonlocal number
            for batch in batches:
                data, offsets = tx.buffer(batch.column(1))
                ids = batch.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(NO_ID).to_numpy()
                for a, b in tx.parts(offsets, pack_bytes):
                    yield (task << 32) + number, PACK, 0, _zip(ids[a:b], null[a:b], np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]])
                    number += 1

        yield from _out(made(), TRAVEL_ARROW)

    return keep(rows.mapInArrow(pack, TRAVEL), "packs")


def _opened(blob: bytes):
    ids, null, sizes, data = _unzip(blob, np.int64, bool, np.int64, np.uint8)
    return ids, null, np.concatenate(([0], np.cumsum(sizes))), data


def _five(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8)


def _shared(packs: DataFrame, shards: int) -> DataFrame:
    """Per pack and shard: which of the pack's distinct hashes occur in another document."""

    def ask(batches):
        def made():
            for pack, _, _, blob in _rows(batches):
                ids, _, offsets, data = _opened(blob)
                text, _, _, low = segments(data, offsets)
                order = np.lexsort((ids[text], low))
                low, who = low[order], ids[text][order]
                new = np.append(True, low[1:] != low[:-1]) if len(low) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                many = np.add.reduceat(np.append(False, (who[1:] != who[:-1]) & ~new[1:]), at) > 0 if len(at) else np.zeros(0, bool)
                low = low[at]
                cuts = np.searchsorted(_shard(low, shards), np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[s], cuts[s + 1])
                    yield pack, SHARED, int(s), b"".join((*(x.tobytes() for x in _five(low[part])), _bits(many[part]).tobytes()))

        yield from _out(made(), TRAVEL_ARROW)

    def answer(batches):
        def made():
            for shard, rows in _by(_rows(batches), 2):
                values, flags = [], []
                for *_, blob in rows:
                    n = 8 * len(blob) // 41
                    n = next(m for m in range(max(0, n - 2), n + 3) if 5 * m + -(-m // 8) == len(blob))
                    low, high = np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint8, n, 4 * n)
                    values.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
                    flags.append(_mask(np.frombuffer(blob, np.uint8, -1, 5 * n), n))
                every = np.sort(np.concatenate(values))
                again = np.concatenate((every[1:][every[1:] == every[:-1]], *(v[f] for v, f in zip(values, flags))))
                again = np.unique(again)
                for (pack, *_), own in zip(rows, values):
                    at = np.minimum(np.searchsorted(again, own), max(0, len(again) - 1))
                    yield pack, SHARED, shard, _bits(again[at] == own if len(again) else np.zeros(len(own), bool)).tobytes()

        yield from _out(made(), TRAVEL_ARROW)

    asked = packs.mapInArrow(ask, TRAVEL)
    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, TRAVEL)


def _cut(ids, null, offsets, data, gone: np.ndarray) -> Iterator[tuple]:
    """Results of a pack; gone: whether each byte is removed."""
    for k, (who, none) in enumerate(zip(ids.tolist(), null.tolist())):
        text = data[offsets[k] : offsets[k + 1]]
        mine = gone[offsets[k] : offsets[k + 1]]
        removed, spans = int(mine.sum()), int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
        text = text[~mine] if removed else text
        raw = text.tobytes()
        yield None if none else who, int(offsets[k + 1] - offsets[k]), removed, spans, hashlib.sha256(raw).hexdigest(), raw


class _Live:
    """The segments of a pack whose hash occurs in another document: place and windows of each, which distinct text it
    is, and of each distinct text the smallest id in the pack, its windows, shard, further hash bits and bytes."""

    def __init__(self, rows: list[tuple], shards: int):
        self.ids, self.null, self.offsets, self.data = _opened(rows[0][3])
        text, first, count, low = segments(self.data, self.offsets)
        known = np.unique(low)
        cuts = np.searchsorted(_shard(known, shards), np.arange(shards + 1))
        on = np.zeros(len(known), bool)
        for _, kind, shard, blob in rows[1:]:
            if kind == SHARED:
                on[cuts[shard] : cuts[shard + 1]] = _mask(np.frombuffer(blob, np.uint8), cuts[shard + 1] - cuts[shard])
        alive = on[np.searchsorted(known, low)] if len(known) else np.zeros(0, bool)
        text, first, count, low = (x[alive] for x in (text, first, count, low))
        shard = _shard(low, shards)
        order = np.lexsort((self.ids[text], shard))
        self.first, self.count, self.owner = first[order], count[order].astype(np.int64), self.ids[text][order]
        raw, names, heads = self.data.tobytes(), {}, []
        self.which = np.empty(len(order), np.int64)
        for k, (a, n) in enumerate(zip(self.first.tolist(), self.count.tolist())):
            number = self.which[k] = names.setdefault(raw[a : a + n + LENGTH - 1], len(names))
            if number == len(heads):
                heads.append(k)
        heads = np.array(heads, np.int64)
        self.texts, self.smallest, self.windows = list(names), self.owner[heads], self.count[heads]
        self.sub = (low[order][heads] >> np.uint64(8)).astype(np.uint8)
        self.cuts = np.searchsorted(shard[order][heads], np.arange(shards + 1))


def _sent(packs: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """The distinct live segments of each pack, by shard."""

    def send(batches):
        def made():
            for pack, rows in _by(_rows(batches), 0):
                live = _Live(rows, shards)
                for s in np.flatnonzero(np.diff(live.cuts)):
                    part = slice(live.cuts[s], live.cuts[s + 1])
                    joined = np.frombuffer(b"".join(live.texts[part]), np.uint8)
                    yield pack, SEGMENTS, int(s), _zip(live.smallest[part], live.windows[part].astype(np.int32), live.sub[part], joined)

        yield from _out(made(), TRAVEL_ARROW)

    return _met(packs.unionByName(shared)).mapInArrow(send, TRAVEL)


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("pack").sortWithinPartitions("pack", "kind", "shard")


def first_owners(texts: list[bytes], owners: np.ndarray) -> np.ndarray:
    """For each window of each distinct text, in their order: the smallest owner of a text that holds it."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.uint16) + 2
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    joined[starts[1:] - 1] = MARK
    s = np.append(joined, 0).astype(np.uint16)
    order = suffix_array(s, 258, LENGTH)
    # windows lie inside their text, so a common prefix of LENGTH never reaches over a mark
    inside = np.zeros(len(s), bool)
    windows = sizes - LENGTH + 1
    at = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    inside[at] = True
    owner = np.zeros(len(s), np.int64)
    owner[at] = np.repeat(owners, windows)
    order = order[inside[order]]
    prefix = permuted_prefixes(s, order, LENGTH)
    new = prefix[order] < LENGTH
    new[:1] = True
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(owner[order], heads)
    owner[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return owner[at]


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) of each pair."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def _named(raw: bytes, starts: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, list[bytes], list[int]] | None:
    """(number of each segment's text, distinct texts, place of the first segment of each), or nothing if the distinct
    texts make up more than `most` bytes."""
    which, names, heads, held = np.empty(len(starts), np.int64), {}, [], 0
    for a in range(0, len(starts), SOME):
        part = slice(a, a + SOME)
        for k, (start, size) in enumerate(zip(starts[part].tolist(), sizes[part].tolist()), a):
            number = which[k] = names.setdefault(raw[start : start + size], len(names))
            if number == len(heads):
                heads.append(k)
                held += size
        if held > most:
            return None
    return which, list(names), heads


def _before(raw: bytes, starts: np.ndarray, windows: np.ndarray, owners: np.ndarray, keys: np.ndarray, array_bytes: int,
            longer: tuple[int, ...] = LONGER) -> np.ndarray:
    """For each window of each segment of raw, in the order of the segments: does a segment of a smaller owner hold it?
    Equal windows stand in segments of the same key. Keys are joined up to the size of one array; one whose distinct
    segments make up more than that has them cut into segments of longer runs, until each window is one."""
    out = np.zeros(windows.sum(), bool)
    at, sizes = np.cumsum(windows) - windows, windows + LENGTH - 1
    order = np.argsort(keys, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]])), [len(order)]))
    weight = np.concatenate(([0], np.cumsum(sizes[order])))[cuts]
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(weight, weight[a] + array_bytes, "right")) - 1)
        group = order[cuts[a] : cuts[b]]
        named = _named(raw, starts[group], sizes[group], array_bytes if longer else np.inf)
        if named:
            which, texts, heads = named
            low, count, n = np.full(len(heads), np.iinfo(np.int64).max), windows[group[heads]], windows[group]
            np.minimum.at(low, which, owners[group])
            found = first_owners(texts, low) < np.repeat(low, count)
            # all windows of a segment are held that a smaller owner has whole
            out[_places(at[group], n)] = found[_places((np.cumsum(count) - count)[which], n)] | np.repeat(owners[group] > low[which], n)
        else:
            rounds = int(-(-(weight[b] - weight[a]) // (ROUND * array_bytes)))
            for k in range(rounds):
                text, first, n, key = _cut_anew(raw, starts[group], sizes[group], longer[0], array_bytes, rounds, k)
                if not len(text):
                    continue
                text = group[text]
                held = _before(raw, starts[text] + first, n, owners[text], key, array_bytes, longer[1:])
                out[_places(at[text] + first, n)] = held
        a = b
    return out


def _cut_anew(raw: bytes, starts: np.ndarray, sizes: np.ndarray, gram: int, array_bytes: int, rounds: int, k: int) -> list[np.ndarray]:
    """Segments of runs of `gram` bytes of the given ones: (which one, first window in it, windows, hash), those of round k by hash."""
    ends, found, a = np.concatenate(([0], np.cumsum(sizes))), [], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + array_bytes, "right")) - 1)
        joined = b"".join([raw[s : s + n] for s, n in zip(starts[a:b].tolist(), sizes[a:b].tolist())])
        text, first, count, key = segments(np.frombuffer(joined, np.uint8), ends[a : b + 1] - ends[a], gram)
        mine = _shard(key, rounds) == k
        text = text[mine] + a
        found.append((text, first[mine] - ends[text] + ends[a], count[mine], key[mine]))
        a = b
    return [np.concatenate(x) for x in zip(*found)]


def _answers(segments_: DataFrame, array_bytes: int) -> DataFrame:
    """Per pack and shard: whether each window of each segment starts in a document with a smaller id."""

    def answer(batches):
        def made():
            for shard, rows in _by(_rows(batches), 2):
                parts = [_unzip(blob, np.int64, np.int32, np.uint8, np.uint8) for *_, blob in rows]
                owners, windows, keys = (np.concatenate([p[k] for p in parts]) for k in range(3))
                raw, ends = b"".join(p[3].data for p in parts), np.cumsum([p[1].sum() for p in parts])
                del parts
                sizes = windows.astype(np.int64) + LENGTH - 1
                bits = _before(raw, np.cumsum(sizes) - sizes, windows.astype(np.int64), owners, keys, array_bytes)
                for (pack, *_), own in zip(rows, np.split(bits, ends)):
                    yield pack, WINDOWS, shard, _bits(own).tobytes()

        yield from _out(made(), TRAVEL_ARROW)

    return segments_.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, TRAVEL)


def _removed(packs: DataFrame, shared: DataFrame, answers: DataFrame, shards: int, text: bool) -> DataFrame:
    def cut(batches):
        def made():
            for _, rows in _by(_rows(batches), 0):
                live = _Live(rows, shards)
                total = np.concatenate(([0], np.cumsum(live.windows)))
                bits = np.zeros(total[-1], bool)
                for _, kind, s, blob in rows[1:]:
                    if kind == WINDOWS:
                        a, b = total[live.cuts[s]], total[live.cuts[s + 1]]
                        bits[a:b] = _mask(np.frombuffer(blob, np.uint8), b - a)
                # each window has a place of its own, so no place is counted twice
                step = np.zeros(len(live.data) + 1, np.int32)
                for a in range(0, len(live.count), SOME):
                    part = slice(a, a + SOME)
                    n, which = live.count[part], live.which[part]
                    # a segment that a smaller id of this pack also holds goes whole
                    hit = np.repeat(live.owner[part] > live.smallest[which], n) | bits[_places(total[which], n)]
                    start = _places(live.first[part], n)[hit]
                    step[start] += 1
                    step[start + LENGTH] -= 1
                yield from _cut(live.ids, live.null, live.offsets, live.data, np.cumsum(step, dtype=np.int32)[:-1] > 0)

        yield from _out((r if text else (*r[:5], None) for r in made()), RESULT_ARROW)

    return _met(packs.unionByName(shared).unionByName(answers)).mapInArrow(cut, RESULT)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, pack_bytes: int = PACK_BYTES,
                        array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 per row; with_text adds the remaining bytes as `kept`."""
    packs = _packs(docs, id_col, text_col, pack_bytes)
    written = packs.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    shards = max(SHARDS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written // SHARD_BYTES))
    with shuffles_freed(docs.sparkSession):
        shared = keep(_shared(packs, shards), "shared")
        answers = keep(_answers(_sent(packs, shared, shards), array_bytes), "answers")
    out = _removed(packs, shared, answers, shards, with_text).withColumnRenamed("doc_id", id_col)
    return out if with_text else out.drop("kept")
