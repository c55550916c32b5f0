import random

from stratalake.llm.graph import components, forest
from stratalake.llm.jaccard_join import drop_similar, least_matches, similar

import numpy as np


def grams(text):
    w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [grams(t) for _, t in rows]
    links = [[k for k, o in enumerate(sets) if k != i and s and o and 5 * len(s & o) >= 4 * len(s | o)] for i, s in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, own in enumerate(links):
            for k in own:
                label[i] = label[k] = min(label[i], label[k])
    least = {}
    for (doc, _), n in zip(rows, label):
        key = (doc is None, doc or 0)
        least[n] = min(least.get(n, key), key)
    return sorted([(doc, None if least[n][0] else least[n][1], len(own)) for (doc, _), n, own in zip(rows, label, links)], key=repr)


def near_copies(rng, n, vocabulary=5000):
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(30, 120))] for _ in range(n // 8)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    return rows


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in similar(docs, **options).collect()], key=repr)
    assert got == expected(rows)


def test_against_all_pairs(spark):
    check(spark, near_copies(random.Random(1), 300))


def test_one_large_group_in_blocks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(150):
        own = list(words)
        own[rng.randrange(100)] = f"new{k}"
        rows.append((k, " ".join(own)))
    check(spark, rows + [(1000 + k, f"other text {k} of its own kind") for k in range(50)], block=16)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in similar(odd_docs).collect()], key=repr)
    assert got == expected(rows)
    assert drop_similar(odd_docs).columns == odd_docs.columns
    kept = [r.text for r in drop_similar(odd_docs).collect() if grams(r.text)]
    assert {frozenset(grams(t)) for t in kept} == {frozenset(grams(t)) for _, t in rows if grams(t)}
    assert similar(no_docs).count() == 0 and drop_similar(no_docs).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    # the chance that a pair of similarity 0.8 is dropped at any step stays small
    rng = np.random.default_rng(0)
    same = rng.random((200_000, 96)) < 0.8
    dropped = np.zeros(len(same), bool)
    for n, least in least_matches():
        dropped |= same[:, :n].sum(axis=1) < least
    assert dropped.mean() < 1e-3
    assert least_matches()[-1][1] > 48


def test_components(spark):
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(60)] + [("900", "901"), ("901", "902"), ("905", "905")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{k:03}": "000" for k in range(61)} | {"900": "900", "901": "900", "902": "900"}


def test_forest_spans_its_components():
    low, node = forest(7, np.array([1, 2, 5]), np.array([2, 4, 6]))
    assert sorted(zip(low.tolist(), node.tolist())) == [(1, 2), (1, 4), (5, 6)]
