"""Quality classifier: a generalised additive model with pairwise interactions.

Features describe the shape of a text, never its labels, language, source or id. Each is cut into bins at
quantiles of the training rows. Boosting goes round the features, one shallow tree each time, and adds the
tree's leaves to the feature's lookup table; then the pairs with the most to gain get tables over two
features in the same way. A score is a sum of table entries, looked up for a whole batch at once.

Training takes at most TRAIN_ROWS labelled rows, those with the smallest hash of their id, so that the fit
is bounded; of rows with equal ids one text is learnt from; scoring covers every row. Cases: null text counts as empty and is scored like any text; null
labels are left out; without labels of both kinds the score is the share of 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import text as tx
from stratalake.llm.store import whole

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE = 0.1
RIDGE = 1.0
PART_BYTES = 1 << 20

CLASSES = {
    "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "stop": b".!?", "comma": b",;:", "mark": b"!",
    "symbol": b"#$%&*+<=>@\\^_`|~{}[]/", "other": range(0x80, 0x100), "line": b"\n", "dash": b"-'\"()",
}
WORD_SHAPES = ("short", "long", "capital", "all_capital", "odd_end")
NAMES = ("bytes", "words", "word_mean", "word_spread", *CLASSES, *WORD_SHAPES, "distinct_words", "top_word", "repeated_runs", "line_words", "longest_word", "entropy")


def _is(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


TESTS = {k: _is(v) for k, v in CLASSES.items()}
LETTER = _is([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(groups: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, count of the most frequent one) in each group."""
    with np.errstate(over="ignore"):
        key = tx.mix(hashes + groups.astype(np.uint64) * tx.STEP)
    order = np.argsort(key)
    key, groups = key[order], groups[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(key)])))
    top = np.zeros(n)
    np.maximum.at(top, groups[at], size)
    return np.bincount(groups[at], minlength=n).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in NAMES."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = tx.words(data, offsets)
    count = np.diff(first).astype(float)
    some, one = np.maximum(count, 1), np.maximum(size, 1)
    length = (ends - starts).astype(float)
    mean = _sums(length, first) / some
    out = {"bytes": np.log1p(size), "words": np.log1p(count), "word_mean": mean,
           "word_spread": np.sqrt(np.maximum(_sums(length**2, first) / some - mean**2, 0))}
    for name, test in TESTS.items():
        out[name] = _sums(test[data], offsets) / one
    head, tail = data[starts] if len(starts) else data, data[ends - 1] if len(ends) else data
    upper = np.concatenate(([0], np.cumsum(TESTS["upper"][data])))
    shapes = {"short": length <= 3, "long": length >= 13, "capital": TESTS["upper"][head],
              "all_capital": (upper[ends] - upper[starts]) * 2 > length, "odd_end": ~(LETTER[tail] | TESTS["stop"][tail] | TESTS["comma"][tail])}
    for name in WORD_SHAPES:
        out[name] = _sums(shapes[name], first) / some
    hashes = tx.word_hashes(data, starts, ends, tx.LOWER)
    doc = np.repeat(np.arange(n), np.diff(first))
    kinds, top = _distinct(doc, hashes, n)
    runs, at = tx.grams(hashes, first, 5)
    run_kinds, _ = _distinct(np.repeat(np.arange(n), np.diff(at)), runs, n)
    out["distinct_words"], out["top_word"] = kinds / some, top / some
    out["repeated_runs"] = 1 - run_kinds / np.maximum(np.diff(at), 1)
    out["line_words"] = np.log1p(count / (1 + out["line"] * size))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out["longest_word"] = np.log1p(longest)
    entropy = np.zeros(n)
    for k in range(n):
        share = np.bincount(data[offsets[k] : offsets[k + 1]]) / one[k]
        share = share[share > 0]
        entropy[k] = -(share * np.log2(share)).sum()
    out["entropy"] = entropy
    return np.stack([out[k] for k in NAMES], axis=1).reshape(n, len(NAMES))


@dataclass
class Model:
    """Cuts of each feature into bins, a table per feature and a table per chosen pair."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.cuts:
            b = self.bins(x)
            total += self.tables[np.arange(b.shape[1]), b].sum(axis=1)
            for k, (i, j) in enumerate(self.pairs):
                total += self.pair_tables[k, b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _stump(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """(best cut, its gain) of a run of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    k = int(gain.argmax()) if len(gain) else 0
    return k + 1, float(gain[k]) if len(gain) else 0.0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over the bins of one feature, as a value per bin."""
    out = np.zeros(len(g))
    cut, _ = _stump(g, h)
    for a, b in ((0, cut), (cut, len(g))):
        mid = a + _stump(g[a:b], h[a:b])[0] if b - a > 1 else b
        for c, d in ((a, mid), (mid, b)):
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """(values, gain) of a tree that cuts the first feature once and the second on either side."""
    left_g, left_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
    best, score = 0, None
    total = 0
    for side_g, side_h in ((left_g, left_h), (g.sum(axis=0) - left_g, h.sum(axis=0) - left_h)):
        lg, lh = np.cumsum(side_g, axis=1)[:, :-1], np.cumsum(side_h, axis=1)[:, :-1]
        sg, sh = side_g.sum(axis=1, keepdims=True), side_h.sum(axis=1, keepdims=True)
        total = total + (_gain(lg, lh) + _gain(sg - lg, sh - lh)).max(axis=1)
    score, best = float(total.max()), int(total.argmax()) + 1
    out = np.zeros_like(g)
    for a, b in ((0, best), (best, len(g))):
        cut, _ = _stump(g[a:b].sum(axis=0), h[a:b].sum(axis=0))
        for c, d in ((0, cut), (cut, g.shape[1])):
            out[a:b, c:d] = g[a:b, c:d].sum() / (h[a:b, c:d].sum() + RIDGE)
    return out, score - _gain(g.sum(), h.sum())


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on features x and labels y (0 or 1)."""
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))))
    model = Model(float(np.log(share / (1 - share))))
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    wide = BINS + 1
    model.tables = np.zeros((x.shape[1], wide))
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = (np.bincount(b[:, k], v, wide) for v in slopes())
            step = RATE * _tree(g, h)
            model.tables[k] += step
            total += step[b[:, k]]
    grid = lambda i, j, v: np.bincount(b[:, i] * wide + b[:, j], v, wide * wide).reshape(wide, wide)
    g, h = slopes()
    gains = [(_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(x.shape[1]) if i != j]
    chosen: dict[frozenset, tuple[int, int]] = {}
    for _, i, j in sorted(gains, reverse=True):
        chosen.setdefault(frozenset((i, j)), (i, j))
    model.pairs = list(chosen.values())[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), wide, wide))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            model.pair_tables[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    data, offsets = tx.buffer(texts)
    rows = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.parts(offsets, PART_BYTES)]
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    """Rows never learnt from: crc32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that are not held out."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out("id"))
    sample = usable.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy(
        "id", "y").agg(F.min("text").alias("text"))  # bounded by `rows`, also where many rows share an id

    def describe(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "id"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.select("text", "y", "id").mapInArrow(describe, f"x array<double>, y double, id {kind}").toArrow()
    order = np.lexsort((got["y"].to_numpy(), got["id"].to_numpy()))[:rows]
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x[order], got["y"].to_numpy()[order])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, held_out, score, predicted per row; with carry the struct `row` too."""
    rows = docs.select(whole(text_col).alias("text"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), *([F.struct("*").alias("row")] if carry else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            p = sent.value.score(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(score, f"{fields}, score double, predicted int").withColumnRenamed("id", id_col)


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents predicted good, all columns."""
    return scores(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col, carry=True).where("predicted = 1").select("row.*")
