"""Join of texts whose word 5-gram sets have a Jaccard similarity of 0.8 or more, with Bayesian pruning.

1. Texts with the same set of 5-grams are one class; only classes are compared. Classes are told apart by
   128 bits of their set.
2. Each class has 96 MinHash values of 16 bits in 24 bands. Classes that agree in a band are candidates;
   a pair is looked at in its first common band only. At a similarity of 0.8 a pair has no common band
   with a probability of 3e-6.
3. The MinHash values of a candidate pair are compared 16 at a time. The matches so far give the posterior
   distribution of the similarity; the pair is dropped when its probability of reaching the threshold is
   below TOLERANCE. What is left of a group is passed on as a forest, never as all its pairs.
4. Connected classes meet again with their whole sets. Pairs are pruned in the same way, and the rest is
   verified exactly. Links are counted there; again only a forest goes on, for the class ids.

Groups of any size are split into blocks, and blocks meet in pairs, so no task holds a whole group. Rows are
sorted by uid in a meeting, so the forests of many meetings hang on the same few roots.

Cases: words are split at ASCII white space and taken as they are; a text of 1 to 4 words has one run, all
its words; null and empty texts have none and link to nothing; repeated rows link to each other; null ids
are allowed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.graph import components, forest, whole_groups
from stratalake.llm.store import keep, whole

RUN = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
PAIRS_AT_ONCE = 1 << 17
PART_BYTES = 1 << 20

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed to go on): the posterior under a flat prior is a Beta distribution,
    whose tail above the threshold is a binomial sum."""
    t, out = float(threshold), []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def gram_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 5-gram hashes of each text, where each text's begin and the count)."""
    starts, ends, first = tx.words(data, offsets)
    runs, at = tx.grams(tx.word_hashes(data, starts, ends), first, RUN)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], np.searchsorted(doc[new], np.arange(n + 1))


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, one row per set; sets without members get zeros."""
    n = len(at) - 1
    out = np.zeros((n, VALUES), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(VALUES):
                mixed = sets * FACTORS[k]
                mixed ^= mixed >> np.uint64(29)
                mixed *= tx.STEP
                low = np.minimum.reduceat(mixed, at[:-1][some])
                out[some, k] = tx.mix(low) >> np.uint64(48)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    four = np.ascontiguousarray(values).reshape(len(values), BANDS, ROWS).view(np.uint64)[:, :, 0]
    with np.errstate(over="ignore"):
        return tx.mix(four * tx.STEP + np.arange(1, BANDS + 1, dtype=np.uint64) * tx.BASE)


def survivors(values: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Places of the pairs that pass: MinHash values compared step by step, hopeless pairs dropped on the way."""
    alive, matches, begin = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold):
        matches = matches + (values[a[alive], begin:n] == values[b[alive], begin:n]).sum(axis=1)
        on = matches >= least
        alive, matches, begin = alive[on], matches[on], n
    return alive


def _pairs(starts: np.ndarray, side: np.ndarray):
    """Pairs (row, later row of its group) of groups of rows, in pieces. side: 0 or 1 where two blocks meet, and
    only pairs across count; 2 in a block by itself."""
    size = np.diff(starts)
    ends = np.repeat(starts[1:], size)
    row = np.arange(starts[0], starts[-1])
    n = ends - row - 1
    total = np.concatenate(([0], np.cumsum(n)))
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS_AT_ONCE, "right")) - 1)
        many = n[i:j]
        a = np.repeat(row[i:j], many)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], many)
        ok = (side[a] == 2) | (side[a] != side[b])
        yield a[ok], b[ok]
        i = j


def _fixed(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _uid(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), whole(text_col)))


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, set (128 bits of the 5-gram set), grams, bands, values."""
    rows = docs.select(_uid(id_col, text_col).alias("uid"), F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def describe(batches):
        for batch in batches:
            data, offsets = tx.buffer(batch.column(2))
            names, sizes, keys, values = [], [], [], []
            for a, b in tx.parts(offsets, PART_BYTES):
                sets, at = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                v = sketches(sets, at)
                names += [hashlib.blake2b(sets[at[k] : at[k + 1]], digest_size=16).digest() for k in range(b - a)]
                sizes.append(np.diff(at))
                keys.append(band_keys(v).view(np.int64))
                values += [row.tobytes() for row in v]
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat)), pa.array(values, pa.binary())],
                names=["uid", "id", "set", "grams", "bands", "values"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"uid string, id {kind}, set binary, grams long, bands array<long>, values binary")


def _meet(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal each group over blocks of about `block` rows and let every two blocks meet: low, high, side."""
    n = F.expr(f"cast(ceil({size} / {block}) as int)")
    dealt = rows.withColumn("_n", n).withColumn("_block", F.pmod(F.xxhash64("uid"), F.col("_n")))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    return met.select(
        "*", F.least("_block", F.col("_other").cast("long")).alias("low"), F.greatest("_block", F.col("_other").cast("long")).alias("high"),
        F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1).alias("side")).drop(
            "_n", "_block", "_other", size)


def _candidates(classes: DataFrame, block: int) -> DataFrame:
    """Forests a, b (uids) over the pairs that share a band and are not pruned."""
    keys = keep(classes.where("grams > 0").select("uid", F.posexplode("bands").alias("band", "key")), "bands")
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = keys.join(shared, ["band", "key"]).join(classes.select("uid", "values"), "uid")
    met = _meet(member, "key", "size", block).repartition("key", "low", "high").sortWithinPartitions("key", "band", "low", "high", "uid")

    def prune(batches):
        for table, starts in whole_groups(batches, ["key", "band", "low", "high"], 1 << 15):
            values, uid = _fixed(table["values"], np.uint16, VALUES), table["uid"]
            band, side = table["band"].to_numpy(), table["side"].to_numpy()
            found = []
            for a, b in _pairs(starts, side):
                same = (values[a] == values[b]).reshape(len(a), BANDS, ROWS).all(axis=2)
                first = same.argmax(axis=1) == band[a]
                a, b = a[first], b[first]
                alive = survivors(values, a, b)
                found.append((a[alive], b[alive]))
            if found:
                low, node = forest(table.num_rows, *map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (uid.take(pa.array(low)), uid.take(pa.array(node)))], names=["a", "b"])

    return met.select("key", "band", "low", "high", "side", "uid", "values").mapInArrow(prune, "a string, b string").distinct()


def _verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """a, b, links: links of a class in one meeting of blocks (b null), and forests over linked classes (links null)."""
    size = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    wanted = keep(groups.join(size, "label").join(classes.select(F.col("uid").alias("node"), "rows"), "node").select(
        F.col("node").alias("uid"), F.xxhash64("label").alias("group"), "size", "rows"), "wanted")
    texts = docs.select(_uid(id_col, text_col).alias("uid"), whole(text_col).alias("text")).join(
        wanted.hint("merge"), "uid").dropDuplicates(["uid"])

    def describe(batches):
        for batch in batches:
            data, offsets = tx.buffer(batch.column(1))
            sets = []
            for a, b in tx.parts(offsets, PART_BYTES):
                s, at = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets += [s[at[k] : at[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["uid", "sets", *batch.schema.names[2:]])

    described = texts.select("uid", "text", "group", "size", "rows").mapInArrow(describe, "uid string, sets binary, group long, size long, rows long")
    met = _meet(described, "group", "size", block).repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "uid")

    def verify(batches):
        for table, starts in whole_groups(batches, ["group", "low", "high"], 1 << 11):
            uid, rows, side = table["uid"], table["rows"].to_numpy(), table["side"].to_numpy()
            raw = table["sets"].to_pylist()
            at = np.concatenate(([0], np.cumsum([len(r) // 8 for r in raw])))
            sets = np.frombuffer(b"".join(raw), np.uint64)
            values, size = sketches(sets, at), np.diff(at)
            found = []
            for a, b in _pairs(starts, side):
                near = 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])
                a, b = a[near], b[near]
                alive = survivors(values, a, b)
                found.append(_exact(sets, at, a[alive], b[alive]))
            a, b = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            links = np.bincount(a, rows[b], table.num_rows) + np.bincount(b, rows[a], table.num_rows)
            some = np.flatnonzero(links)
            low, node = forest(table.num_rows, a, b)
            first = pa.chunked_array([*uid.take(pa.array(some)).chunks, *uid.take(pa.array(low)).chunks], pa.string()).combine_chunks()
            second = pa.chunked_array([pa.nulls(len(some), pa.string()), *uid.take(pa.array(node)).chunks], pa.string()).combine_chunks()
            yield pa.RecordBatch.from_arrays([first, second, pa.array([*links[some].astype(int).tolist(), *[None] * len(low)], pa.int64())], names=["a", "b", "links"])

    return met.select("group", "low", "high", "side", "uid", "rows", "sets").mapInArrow(verify, "a string, b string, links long")


def _exact(sets: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of sets, sorted by a) whose similarity reaches the threshold."""
    keep_pair = np.zeros(len(a), bool)
    if len(a):
        order = np.argsort(a, kind="stable")
        heads, begin = np.unique(a[order], return_index=True)
        for head, pairs in zip(heads, np.split(order, begin[1:])):
            own = sets[at[head] : at[head + 1]]
            for some in np.array_split(pairs, -(-len(pairs) // 64)):
                n = at[b[some] + 1] - at[b[some]]
                ends = np.cumsum(n)
                other = sets[np.repeat(at[b[some]] - ends + n, n) + np.arange(ends[-1])]
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = np.add.reduceat((own[place] == other).astype(np.int64), ends - n)
                keep_pair[some] = THRESHOLD.denominator * both >= THRESHOLD.numerator * (len(own) + n - both)
    return a[keep_pair], b[keep_pair]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """uid, id, class_id (smallest id among all texts connected by links), n_links (other rows with a similarity
    of 0.8 or more, copies too), first (whether the row is its class's smallest by id and content)."""
    described = keep(_described(docs, id_col, text_col), "described")
    # texts without words stand alone: each row is a class of its own
    own = F.when(F.col("grams") > 0, F.col("set")).otherwise(F.unhex("uid"))
    by_set = described.withColumn("set", own).groupBy("set").agg(
        F.min("uid").alias("uid"), F.count(F.lit(1)).alias("rows"), F.max("grams").alias("grams"),
        F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))).alias("head"), F.first("bands").alias("bands"), F.first("values").alias("values"))
    classes = keep(by_set, "classes")
    edges = keep(_candidates(classes, block), "candidates")
    checked = keep(_verified(docs, classes, components(edges), id_col, text_col, block), "verified")
    links = checked.where("b IS NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    labels = components(checked.where("b IS NOT NULL")).withColumnRenamed("node", "uid")
    joined = classes.select("set", "uid", "rows", "grams", "head").join(links, "uid", "left").join(labels, "uid", "left").withColumn(
        "label", F.coalesce("label", "uid"))
    heads = joined.groupBy("label").agg(F.min("head").alias("head"))
    final = joined.drop("head").join(heads, "label").select(
        "set", "head", F.when(F.col("grams") > 0, F.coalesce("links", F.lit(0)) + F.col("rows") - 1).otherwise(0).cast("long").alias("n_links"))
    return described.select("uid", "id", own.alias("set")).join(final, "set").select(
        "uid", F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "n_links", (F.col("uid") == F.col("head.uid")).alias("first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group connected by links: the one with the smallest id. All columns. Rows alike in id
    and text are not told apart here."""
    gone = similar(docs, id_col, text_col).where("NOT first").select("uid")
    return docs.select(F.struct("*").alias("row"), _uid(id_col, text_col).alias("uid")).join(gone, "uid", "left_anti").select("row.*")


SIMILAR_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
         n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
         p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
         e AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
         r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
         k AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
    SELECT doc_id, min(other) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM r LEFT JOIN k ON k.x = doc_id GROUP BY doc_id"""
