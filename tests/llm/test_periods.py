import hashlib
import random
import zlib

import numpy as np
import pytest

from stratalake.llm.queries import QUERIES
from stratalake.llm.periods import SuffixTree, collapsed, periodic_runs, word_runs


def plain_runs(words, shortest=6, repeats=4):
    """Every maximal stretch of every period, kept if the period is its smallest."""
    found = set()
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, repeats * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if not smaller:
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


def random_words(rng):
    """Words with planted periods, repeated over one another."""
    letters = "abcde"[: rng.randint(1, 5)]
    words = []
    while len(words) < rng.randint(0, 120):
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        words += piece * rng.choice([1, 1, 2, 4, 5, 9])
        words += [rng.choice("pqrstuvwxyz")] * rng.choice([0, 0, 1, 5, 6])
    return words


@pytest.mark.parametrize("seed", range(30))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(40):
        words = random_words(rng)
        got = word_runs(words)
        assert list(map(tuple, got)) == plain_runs(words), words
        assert collapsed(words, got) == plain_collapsed(words, plain_runs(words))


@pytest.mark.parametrize("shortest, repeats", [(1, 2), (2, 2), (4, 3), (10, 2), (1, 6)])
def test_other_limits(shortest, repeats):
    rng = random.Random(5)
    for _ in range(150):
        words = random_words(rng)
        assert list(map(tuple, word_runs(words, shortest, repeats))) == plain_runs(words, shortest, repeats), words


def test_extensions():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5):
        symbols = rng.integers(1, letters + 1, 80).tolist() + [0]
        tree = SuffixTree(symbols)
        one, other = rng.integers(0, 81, (2, 500))
        one, other = one[one != other], other[one != other]
        for a, b, n in zip(one, other, tree.extension(one, other)):
            k = 0
            while max(a, b) + k < 81 and symbols[a + k] == symbols[b + k]:
                k += 1
            assert n == k


def test_long_texts():
    assert word_runs(["x"] * 50_000).tolist() == [[0, 50_000, 1]]
    period = [str(k) for k in range(9_000)]
    assert word_runs(["y"] + period * 5 + ["z"]).tolist() == [[1, 45_000, 9_000]]
    rng = random.Random(1)
    assert word_runs([str(rng.randint(0, 5000)) for _ in range(50_000)]).tolist() == []


def test_rows(spark, odd_docs, no_docs):
    rng = random.Random(9)
    texts = [rng.choice(["", " ", "\t "]) + rng.choice([" ", "\n", " \x0b"]).join(random_words(rng)) for _ in range(200)] + ["é é é é é é", "a\x1cb " * 9, None, ""]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "q q q q q q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=repr)
    expected = []
    for k, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words)
        expected.append((k, len(words), runs, " ".join(plain_collapsed(words, runs))))
    assert got == sorted(expected, key=repr)
    assert periodic_runs(odd_docs.withColumn("runs", odd_docs["row"])).count() == odd_docs.count()
    assert periodic_runs(no_docs).count() == 0


def test_query(spark):
    """op13_periodic_runs over its whole table, each row by the rule."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        words = [w.decode() for w in (row.text or "").encode().split()]
        h = zlib.crc32(str(row.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = [tuple(r) for r in word_runs(words).tolist()]
        if n < 400:
            assert runs == plain_runs(words)
        widest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[row.doc_id] == {
            "doc_id": row.doc_id, "n_runs": len(runs), "start": widest and widest[0], "length": widest and widest[1], "period": widest and widest[2],
            "exponent_milli": widest and 1000 * widest[1] // widest[2], "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            "collapsed_sha256": sha(" ".join(plain_collapsed(words, runs)))}
    assert sum(r["n_runs"] for r in got.values()) > 5
