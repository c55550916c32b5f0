"""Language-model scores by online logistic context mixing.

The text is its bytes (A-Z in lower case) and an end byte. Each bit is predicted in four contexts: the last
two, four and six bytes, and the word so far (its last seven bytes). For each context the bytes that followed
it are counted over all training documents; the counts give each bit of the next byte a probability, and its
log odds are the predictor's opinion. A document's opinions are combined by weights, one set for each bit of
a byte. They begin alike for every document and follow the gradient of the coding cost after each 64 bytes,
so a score depends on the document and the counts alone, not on its neighbours or on the task.

Every context of the corpus has counts of its own, so the model grows with the input and nothing of it is sent
to all tasks. Texts are written in packs. A pack deals its distinct (context, byte) with its training counts to
ranges of the context hash; a range adds up the counts of all packs and gives each pack the opinions for what
it sent; with these the pack's texts are mixed. The number of ranges grows with the text, so what a task holds
does not. Word counts for the unigram base cover every training word: the HEAD most frequent are sent to the
tasks, the others are joined.

Contexts are compared by a 47-bit hash, words by a 64-bit one. Cases: null text counts as empty; an empty text
is its end byte, and one end token; null ids are learnt from; repeated rows count each; with nothing to learn
all counts are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.store import keep, whole

CONTEXTS = 4
PACK_BYTES = 32 << 20
PART_BYTES = 2 << 20
RANGE_BYTES, MIN_RANGES = 16 << 20, 64
HASH_BITS = 47
HEAD = 1 << 18
END = 0xFF
DOCS, STRIP, BLOCK = 96, 1024, 64
SLICE = 1 << 16
BACK = 8
#: Bits of the last eight bytes that a context is made of.
REACH = np.array([(1 << 8 * n) - 1 for n in (2, 4, 6, BACK - 1)], np.uint64)
PRIOR = 0.05
SCALE, CLIP = 16.0, 7.9
FIRST_WEIGHT = 0.3
RATE = 0.4
END_TOKEN = np.uint64(1)

SPREAD = np.uint64(0x9FB21C651E98DF25)
SALTS = np.array([0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x5851F42D4C957F2D], np.uint64)
HALF = np.arange(16)
#: For each half byte: the nodes its four bits are decided in, and which way.
NODES = np.stack([(1 << k) + (HALF >> (4 - k)) for k in range(4)], axis=1).astype(np.int32)
SIGNS = np.stack([2 * (HALF >> (3 - k) & 1) - 1 for k in range(4)], axis=1).astype(np.int8)


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 7, is 2. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _strips(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(documents, bytes with BACK bytes before them, valid bytes of each row, whether a new group begins).

    Documents of like length go in groups, and a group in strips, so memory does not follow the longest text.
    """
    size = np.diff(offsets) + 1
    order = np.argsort(-size, kind="stable")
    for g in range(0, len(order), DOCS):
        group = order[g : g + DOCS]
        for begin in range(0, int(size[group[0]]), STRIP):
            docs = group[size[group] > begin]
            width = int(min(STRIP, size[docs[0]] - begin))
            at = begin - BACK + np.arange(BACK + width)
            rows = np.zeros((len(docs), BACK + width), np.uint8)
            inside = (at >= 0) & (at < size[docs, None] - 1)
            place = offsets[docs, None] + at
            rows[inside] = data[place[inside]]
            rows[at == size[docs, None] - 1] = END
            yield docs, rows, np.minimum(size[docs] - begin, width), begin == 0


def _context(rows: np.ndarray, k: int) -> np.ndarray:
    """Spread 64-bit value of context k before every byte."""
    n = rows.shape[1] - BACK
    # the last eight bytes as one number, the nearest byte lowest
    last = np.ndarray((len(rows), n), ">u8", np.ascontiguousarray(rows), strides=(rows.shape[1], 1)).astype(np.uint64)
    last &= REACH[k]
    if k == 3:
        index = np.where(tx.SPACE[rows], np.arange(rows.shape[1], dtype=np.int32), 0)
        since = np.minimum(np.arange(BACK - 1, BACK - 1 + n, dtype=np.int32) - np.maximum.accumulate(index, axis=1)[:, BACK - 1 : -1], BACK - 1).astype(np.uint64)
        last &= (np.uint64(1) << (since * np.uint64(8))) - np.uint64(1)
        last += since << np.uint64(56)
    with np.errstate(over="ignore"):
        key = (last + SALTS[k]) * SPREAD
        key ^= key >> np.uint64(32)
    return key


def _codes(rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of context k and the byte after it, for every byte; equal contexts lie side by side in order."""
    with np.errstate(over="ignore"):
        code = _context(rows, k) * tx.STEP
    code >>= np.uint64(64 - HASH_BITS)
    code <<= np.uint64(8)
    code |= rows[:, BACK:]
    return code


def _lines(rows: np.ndarray, bits: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For tables in memory, per context: 16 times the line of both half bytes of every byte, shape (rows, bytes, 2)."""
    n = rows.shape[1] - BACK
    with np.errstate(over="ignore"):
        later = ((rows[:, BACK:] >> 4).astype(np.uint64) + np.uint64(1)) * tx.BASE
        for k in range(CONTEXTS):
            key = _context(rows, k)
            out = np.empty((len(rows), n, 2), np.intp)
            out[:, :, 0] = (key * tx.STEP) >> np.uint64(64 - bits[k])
            out[:, :, 1] = ((key + later) * tx.STEP) >> np.uint64(64 - bits[k])
            out *= 16
            yield out


def _halves(rows: np.ndarray) -> np.ndarray:
    now = rows[:, BACK:]
    return np.stack([now >> 4, now & 15], axis=2)


def opinions(counts: np.ndarray) -> np.ndarray:
    """For counts of half-byte values (lines x 16): the log odds of a 1 in each of the 15 nodes of a line."""
    counts = counts.reshape(-1, 16).astype(np.float32)
    out = np.zeros((len(counts), 16), np.int8)
    for bit in range(4):
        ones = counts.reshape(len(counts), 1 << bit, 2, 8 >> bit).sum(axis=3)
        odds = np.log((ones[:, :, 1] + PRIOR) / (ones[:, :, 0] + PRIOR))
        out[:, 1 << bit : 2 << bit] = np.rint(np.clip(odds, -CLIP, CLIP) * SCALE)
    return out.reshape(-1)


class Opinions:
    """Tables in memory of all contexts, 16 bytes a line, spread out at first use."""

    def __init__(self, nodes: list[np.ndarray]):
        self.nodes, self.spread = nodes, None

    def tables(self) -> list[np.ndarray]:
        """Per context and half-byte value: the log odds of the four bits that are there, in a 32-bit integer."""
        if self.spread is None:
            self.spread = [np.ascontiguousarray(n.reshape(-1, 16)[:, NODES] * SIGNS).view(np.int32).reshape(-1) for n in self.nodes]
            self.nodes = None
        return self.spread


def log_probabilities(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], bits: tuple[int, ...]) -> np.ndarray:
    """Natural log of each text's probability, by tables in memory."""
    return _mixed(len(offsets) - 1, _strips(data, offsets), lambda rows, there: (tables[k].take(lines + _halves(rows)) for k, lines in enumerate(_lines(rows, bits))))


def _mixed(texts: int, strips: Iterable[tuple], opinion: Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]]) -> np.ndarray:
    """Natural log of each text's probability. opinion: per context, eight bytes for each byte of the rows."""
    out = np.zeros(texts)
    weights = None
    for docs, rows, valid, new in strips:
        weights = [np.full((len(docs), 8, 1), FIRST_WEIGHT / SCALE, np.float32) if new else w[: len(docs)] for w in weights or [None] * CONTEXTS]
        n = rows.shape[1] - BACK
        said = [x.view(np.int8).reshape(len(docs), n, 8) for x in opinion(rows, np.arange(n) < valid[:, None])]
        for j in range(0, n, BLOCK):
            # bits of a block by place in the byte, so that sums run along memory
            x = [s[:, j : j + BLOCK].transpose(0, 2, 1).astype(np.float32, order="C") for s in said]
            z = x[0] * weights[0]
            for k in range(1, CONTEXTS):
                z += x[k] * weights[k]
            np.clip(z, -20, 20, out=z)
            e = np.exp(-z)
            cost, slope = np.log1p(e), e / (1 + e)
            width = x[0].shape[2]
            if valid.min() < j + width:
                there = (np.arange(j, j + width) < valid[:, None])[:, None, :]
                cost, slope = cost * there, slope * there
            out[docs] -= cost.sum(axis=(1, 2), dtype=np.float64)
            step = np.float32(RATE / BLOCK / SCALE**2)
            weights = [w + step * (slope * v).sum(axis=2, keepdims=True) for w, v in zip(weights, x)]
    return out


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tx.buffer(texts)
    return tx.LOWER[data], offsets


def _tally(total: np.ndarray, places: np.ndarray) -> None:
    """total[p] += 1 for each p."""
    places = np.sort(places)
    last = np.flatnonzero(np.append(places[1:] != places[:-1], True))
    total[places[last]] += np.diff(last, prepend=-1).astype(total.dtype)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned values as planes of their bytes, no more than the largest needs: these compress well."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _packed(values: np.ndarray) -> bytes:
    """Unsigned values as compressed planes, and how many there are of these."""
    planes = _planes(values)
    return bytes([len(planes) // len(values)]) + pa.compress(planes, "zstd", asbytes=True)


def _restored(packed: bytes, n: int) -> np.ndarray:
    """The inverse of _packed, for n values."""
    return _values(pa.decompress(packed[1:], packed[0] * n, "zstd", asbytes=True), n)


def _values(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view("<u8").reshape(-1)


def _unpacked(said: bytes, n: int) -> np.ndarray:
    """Opinions as context_opinions() packs them."""
    return np.frombuffer(pa.decompress(said, 8 * n, "zstd"), np.uint8).reshape(8, n).T.copy().view("<i8").reshape(-1)


def _starts(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values is the first of its kind."""
    return np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))


def _said(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For sorted distinct codes and their counts: the opinions on the eight bits of the byte, as one 64-bit value."""
    out = np.empty((len(codes), 8), np.int8)
    line = np.cumsum(_starts(codes >> np.uint64(8))) - 1
    ends = np.searchsorted(line, np.arange(0, line[-1] + 1 + SLICE, SLICE)) if len(line) else []
    for a, b in zip(ends[:-1], ends[1:]):
        byte = (codes[a:b] & np.uint64(255)).astype(np.intp)
        for half, at, of in ((byte >> 4, 0, 8), (byte & 15, 4, 4)):
            lines = np.cumsum(_starts(codes[a:b] >> np.uint64(of))) - 1
            nodes = opinions(np.bincount(lines * 16 + half, counts[a:b], 16 * (lines[-1] + 1))).reshape(-1, 16)
            out[a:b, at : at + 4] = nodes[lines[:, None], NODES[half]] * SIGNS[half]
    return out.view("<i8").reshape(-1)


def compressed_packs(rows: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """pack, ids, held, sizes, data: rows of (id, text, held_out) in packs of about pack_bytes, as a written table. data: the
    texts in lower case, compressed as one."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["pack", "ids", "held", "sizes", "data"]

    def gather(batches):
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = _lower(batch.column(1))
            for a, b in tx.parts(offsets, pack_bytes):
                columns = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1]))
                blob = pa.compress(data[offsets[a] : offsets[b]], "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([n], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c) for c in columns), pa.array([blob], pa.binary())], names=names)
                n += 1

    return keep(rows.select("id", "text", "held_out").mapInArrow(gather, f"pack long, ids array<{kind}>, held array<boolean>, sizes array<long>, data binary"), "packs")


def packs(rows: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """pack, ids, held, texts: the packs with their texts in lower case, one by one."""
    kind = rows.schema["id"].dataType.simpleString()

    def opened(batches):
        for batch in batches:
            pack, ids, held, sizes, data = batch.columns
            for i in range(batch.num_rows):
                raw, offsets = _texts(sizes[i].values, data[i].as_py())
                texts = pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.utf8())
                yield pa.RecordBatch.from_arrays([pack.slice(i, 1), ids.slice(i, 1), held.slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)], names=["pack", "ids", "held", "texts"])

    return compressed_packs(rows, pack_bytes).mapInArrow(opened, f"pack long, ids array<{kind}>, held array<boolean>, texts array<string>")


def _texts(sizes: pa.Array, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a pack's texts."""
    offsets = np.concatenate(([0], np.cumsum(sizes.to_numpy(), dtype=np.int64)))
    return np.frombuffer(pa.decompress(data, int(offsets[-1]), "zstd"), np.uint8), offsets


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list]]:
    """(first text, end, strips) of parts of a pack: work on a part stays near the processor."""
    for a, b in tx.parts(offsets, PART_BYTES):
        yield a, b, list(_strips(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def _part_codes(strips: list, k: int) -> np.ndarray:
    return np.concatenate([_codes(rows, k)[np.arange(rows.shape[1] - BACK) < valid[:, None]] for _, rows, valid, _ in strips])


def _union(found: list[np.ndarray]) -> np.ndarray:
    """The distinct codes of all, in order."""
    codes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    codes.sort()
    return codes[_starts(codes)]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From lists of distinct codes and their counts: all codes in order, their counts, each list's places in them."""
    codes = _union([c for c, _ in found])
    places = [np.searchsorted(codes, c) for c, _ in found]
    total = np.zeros(len(codes), np.int64)
    for at, (_, n) in zip(places, found):
        total[at] += n
    return codes, total, places


def _learnt(strips: list, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a part in order and how often its training texts have them."""
    bit = np.concatenate([np.repeat(held[docs], np.minimum(valid, rows.shape[1] - BACK)) for docs, rows, valid, _ in strips])
    codes = (_part_codes(strips, k) << np.uint64(1)) | bit
    codes.sort()
    at = np.flatnonzero(_starts(codes))
    n, codes = np.diff(np.append(at, len(codes))), codes[at]
    n[(codes & np.uint64(1)) == 1] = 0
    codes >>= np.uint64(1)
    first = np.flatnonzero(_starts(codes))
    return codes[first], np.add.reduceat(n, first)


def context_counts(packed: DataFrame, ranges: int) -> DataFrame:
    """pack, context, range, n, codes, counts: the distinct codes of a pack and how often its training texts have them."""
    names = ["pack", "context", "range", "n", "codes", "counts"]
    source = ["texts"] if "texts" in packed.columns else ["sizes", "data"]

    def count(batches):
        bounds = np.array([(r << (HASH_BITS + 8)) // ranges for r in range(ranges + 1)], np.uint64)
        for batch in batches:
            for pack, held, *texts in zip(*batch.columns):
                held = held.values.to_numpy(zero_copy_only=False).astype(np.uint64)
                parts = list(_parts(*(_lower(texts[0].values) if source == ["texts"] else _texts(texts[0].values, texts[1].as_py()))))
                for k in range(CONTEXTS):
                    codes, learnt, _ = _summed([_learnt(strips, k, held[a:b]) for a, b, strips in parts])
                    cut = np.searchsorted(codes, bounds)
                    full = np.flatnonzero(cut[1:] > cut[:-1])
                    dealt = [(codes[a:b], learnt[a:b], bounds[r]) for r, a, b in zip(full, cut[full], cut[full + 1])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([pack.as_py()] * len(full), pa.int64()), pa.array([k] * len(full), pa.int32()), pa.array(full, pa.int32()),
                        pa.array([len(c) for c, _, _ in dealt], pa.int32()), pa.array([_packed(np.diff(c, prepend=low)) for c, _, low in dealt], pa.binary()),
                        pa.array([_packed(n) for _, n, _ in dealt], pa.binary())], names=names)

    return packed.select("pack", "held", *source).mapInArrow(count, "pack long, context int, range int, n int, codes binary, counts binary")


def context_opinions(counted: DataFrame, ranges: int) -> DataFrame:
    """pack, context, range, n, said: the opinions for the codes of each row, from the counts of all packs."""
    names = ["pack", "context", "range", "n", "said"]

    def answer(held):
        low = np.uint64((held[0][2] << (HASH_BITS + 8)) // ranges)
        codes, total, places = _summed([(np.cumsum(_restored(c, n)) + low, _restored(m, n).astype(np.int64)) for *_, n, c, m in held])
        said = _said(codes, total)
        for at, (pack, context, part, n, _, _) in zip(places, held):
            planes = pa.compress(said[at].view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([context], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([planes], pa.binary())], names=names)

    def look(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][2] != row[2]:
                    yield from answer(held)
                    held = []
                held.append(row)
        if held:
            yield from answer(held)

    return counted.repartition("range").sortWithinPartitions("range").mapInArrow(look, "pack long, context int, range int, n int, said binary")


def _placed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, the place of every code among them)."""
    bits = np.uint64(max(1, (len(codes) - 1).bit_length()))
    with np.errstate(over="ignore"):
        key = codes * tx.STEP
    # sorting numbers is much faster than sorting places: the top of the spread code, then the place
    key >>= bits
    key <<= bits
    key |= np.arange(len(codes), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.intp)
    met = codes[order]
    first = _starts(met)
    if np.count_nonzero(first) != np.count_nonzero(_starts(key >> bits)):  # two codes share that top
        order = np.argsort(codes)
        met = codes[order]
        first = _starts(met)
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return met[first], place


def _pack_logs(data: np.ndarray, offsets: np.ndarray, said: list[np.ndarray]) -> np.ndarray:
    """Natural log of each text's probability. said: per context, the opinions of the pack's distinct codes in order."""
    parts = list(_parts(data, offsets))
    known = []
    for k in range(CONTEXTS):
        found = []
        for _, _, strips in parts:
            codes = _part_codes(strips, k)
            codes.sort()
            found.append(codes[_starts(codes)])
        known.append(_union(found))
    out = np.empty(len(offsets) - 1)
    for a, b, strips in parts:
        given, at = [], 0
        for k in range(CONTEXTS):
            codes, place = _placed(_part_codes(strips, k))
            given.append((said[k][np.searchsorted(known[k], codes)], place))

        def opinion(rows, ok):
            nonlocal at
            n = int(ok.sum())
            for values, place in given:
                full = np.zeros(ok.shape, "<i8")
                full[ok] = values[place[at : at + n]]
                yield full
            at += n

        out[a:b] = _mixed(b - a, strips, opinion)
    return out


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(data, offsets)
    return tx.word_hashes(data, starts, ends) | np.uint64(2), first  # never END_TOKEN


def token_totals(docs: DataFrame) -> DataFrame:
    """token (hash), n over all documents, the end token too."""

    def count(batches):
        for batch in batches:
            hashes, first = _token_hashes(*_lower(batch.column(0)))
            token, n = np.unique(hashes, return_counts=True)
            token, n = np.append(token, END_TOKEN), np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"token": pa.array(token.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, pack_bytes: int = PACK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), held_out(id_col).alias("held_out"))
    learnt = rows.where("NOT held_out")
    totals = keep(token_totals(learnt), "tokens")
    tokens, kinds = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, -(-size // range_bytes))
    frequent = totals.orderBy(F.desc("n"), "token").limit(head).toArrow()  # bounded by `head`
    order = np.argsort(frequent["token"].to_numpy().view(np.uint64))
    known = frequent["token"].to_numpy().view(np.uint64)[order], frequent["n"].to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def gathered(batches):
        """(ids, held out, texts, opinions) of each pack: its row comes first, then its opinions by context and range."""
        pack, said = None, None
        for batch in batches:
            ids, held, sizes, data = (batch.column(k) for k in (3, 4, 5, 6))
            for i, (context, n, planes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 7, 8)))):
                if context is None:
                    if pack:
                        yield *pack, [np.concatenate(s) for s in said]
                    pack, said = (ids[i].values, held[i].values, _texts(sizes[i].values, data[i].as_py())), [[] for _ in range(CONTEXTS)]
                else:
                    said[context].append(_unpacked(planes, n))
        if pack:
            yield *pack, [np.concatenate(s) for s in said]

    def score(batches):
        head_tokens, head_counts = sent.value
        for ids, held, (data, offsets), said in gathered(batches):
            logs = _pack_logs(data, offsets, said)
            hashes, first = _token_hashes(data, offsets)
            n = np.diff(first) + 1
            hashes = np.insert(hashes, first[1:], END_TOKEN)
            first = np.concatenate(([0], np.cumsum(n)))
            at = np.minimum(np.searchsorted(head_tokens, hashes), max(0, len(head_tokens) - 1))
            hit = head_tokens[at] == hashes if len(head_tokens) else np.zeros(len(hashes), bool)
            count = np.where(hit, head_counts[at], 0) if len(head_tokens) else np.zeros(len(hashes))
            add = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[first])
            rest = np.concatenate(([0], np.cumsum(~hit)))[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids, held, pa.array(n), pa.array(np.rint(add(hit)).astype(np.int64)), pa.array(add(np.log10(count + 1))),
                pa.array(logs / np.log(10)), pa.array(-logs / np.log(2) / (np.diff(offsets) + 1)),
                pa.ListArray.from_arrays(rest, pa.array(hashes[~hit].view(np.int64)))], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "n_known", "logs", "score", "bits_per_byte", "rest"]
    packed = compressed_packs(rows, pack_bytes)
    said = context_opinions(context_counts(packed, ranges), ranges)
    both = packed.unionByName(said, allowMissingColumns=True).select("pack", "context", "range", "ids", "held", "sizes", "data", "n", "said")
    met = both.repartition("pack").sortWithinPartitions(F.asc("pack"), F.asc_nulls_first("context"), F.asc("range"))
    scored = keep(met.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double, rest array<long>")
                  .withColumn("row", F.monotonically_increasing_id()), "scored")
    # words beyond the head are rare in training; their counts are joined
    rare = scored.select("row", F.explode("rest").alias("token")).join(totals, "token").groupBy("row").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    each = float(np.log10(tokens + kinds + 1))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score", "bits_per_byte")
