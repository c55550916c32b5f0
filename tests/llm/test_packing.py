import random
from collections import defaultdict

from stratalake.llm.packing import best_fit, plan, words_and_end
from stratalake.llm.queries import op10_best_fit_packing

import corpus_pipeline


def one_by_one(counts, capacities, cost):
    """Best fit on single pieces, longest first, opening as plan() does."""
    rooms = []
    shorter = sum(k * n for k, n in counts.items())
    for length in sorted(counts, reverse=True):
        shorter -= length * counts[length]
        left = counts[length]
        size = None
        while left:
            fits = [k for k, r in enumerate(rooms) if r >= length]
            if fits:
                k = min(fits, key=lambda k: rooms[k])
                rooms[k] -= length
                left -= 1
                continue
            size = min((c for c in capacities if c >= length), key=lambda c: (cost(c) / (c // length * length + min(c % length, shorter * (c // length) / left)), -c))
            rooms += [size] * -(-left // (size // length))
    return len(rooms)


def test_plan_agrees_with_single_pieces():
    for seed in range(30):
        rng = random.Random(seed)
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        groups = plan(counts, (16, 32, 64), lambda c: c + 2)
        got = defaultdict(int)
        for g in groups:
            assert sum(length * each for length, each in g.content) <= g.capacity
            for length, each in g.content:
                got[length] += each * g.bins
        assert dict(got) == counts
        assert sum(g.bins for g in groups) == one_by_one(counts, (16, 32, 64), lambda c: c + 2)


def test_bins_shrink_to_their_content():
    assert [g.capacity for g in plan({100: 1}, (512, 8192), lambda c: 1.0)] == [512]


def test_places(spark):
    rng = random.Random(1)
    rows = [(k, 7 if k % 3 == 0 else rng.randint(0, 300)) for k in range(3000)] + [(5000, None), (5001, -3), (5002, 1000), (7, 50), (7, 50)]
    got = best_fit(spark.createDataFrame(rows, "doc_id long, n long"), "n", (64, 128), bucket_rows=100).collect()
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        total[r.doc_id] += r.length
        assert r.length <= 128
        if r.bin is not None:
            bins[r.bin].append(r)
    want = defaultdict(int)
    for k, n in rows:
        want[k] += max(n or 0, 0)
    assert total == want
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert len({r.capacity for r in held}) == 1
        assert all(a.offset + a.length == b.offset for a, b in zip(held, held[1:]))
        end = held[-1].offset + held[-1].length
        assert held[0].offset == 0 and end <= held[0].capacity
        assert held[0].capacity == min(c for c in (64, 128) if c >= end)


def test_empty(odd_docs, no_docs):
    assert best_fit(odd_docs.selectExpr("doc_id", "length(text) AS n"), "n").where("bin IS NULL").count() == 4
    assert best_fit(no_docs.selectExpr("doc_id", "length(text) AS n"), "n").count() == 0


def test_lengths_are_words_and_an_end_token(spark, odd_docs, tmp_path):
    rows = odd_docs.select("text", words_and_end("text").alias("n")).collect()
    assert [r.n for r in rows] == [len((r.text or "").split()) + 1 for r in rows]
    texts = {1: None, 2: "", 3: "  two words\n", 4: "\t", 5: "one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: len((t or "").split()) + 1 for k, t in texts.items()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (op10_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.length for r in out.collect()} == want
