"""Helpers for joins by groups: whole groups from sorted batches, forests, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.store import keep


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, start of each group and the row count) with whole groups only, about `rows` rows at a time.

    The input has to be partitioned and sorted by `keys`, which are integers.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(table: pa.Table, last: bool) -> tuple[np.ndarray, int]:
        n = table.num_rows
        change = np.zeros(n, bool)
        change[:1] = True
        for k in keys:
            v = table[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        end = n if last else int(starts[-1])
        return np.append(starts[starts < end], end), end

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            starts, end = cut(table, False)
            if end:
                yield table.slice(0, end), starts
            held, count = table.slice(end).to_batches(), table.num_rows - end
            rows_left = count
            if rows_left >= rows:
                rows = 2 * rows_left  # one group larger than the step: wait for its end
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table, True)[0]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (a, b) over nodes 0 to n-1, (lowest node of its component, node) for all that are linked."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node it is connected with) of all nodes in edges(a, b).

    Labels go along edges and are then looked up by themselves, so long paths halve each round. Rounds are
    written tables; no node's edges are gathered anywhere, the smallest label is taken by partial sums.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = keep(
            labels.join(near, labels["node"] == near["a"]).join(far, "label").select(
                "node", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels
