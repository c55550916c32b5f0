import random
from itertools import combinations

from stratalake.llm import decontaminate as d


def test_every_window_with_two_substitutions_keeps_a_seed():
    for wrong in combinations(range(d.WINDOW), d.SUBSTITUTED):
        assert any(not {s + p for p in mask} & set(wrong) for mask in d.MASKS for s in range(d.WINDOW - mask[-1]))


def test_every_short_item_with_one_substitution_keeps_a_seed():
    for n in range(d.SHORTEST, d.WINDOW):
        assert d.allowed(n) == 1
        for wrong in range(n):
            assert any(wrong not in mask for mask in d.masks_of(n))
    assert d.masks_of(4) == [(0, 1, 2, 3)] and d.allowed(4) == 0


def test_differences():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(40), rng.randint(1, 12))) for _ in range(2))
        assert d.differences(a, b) == sorted({x - y for x in a for y in b})


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else " " if c.isascii() and not c.isalnum() else c for c in text or "").split()


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, other in items:
            o = words(other)
            n = min(13, len(o))
            if len(o) < 5:
                continue
            covered = set()
            for i in range(len(w) - n + 1):
                for j in range(len(o) - n + 1):
                    if sum(a != b for a, b in zip(w[i : i + n], o[j : j + n])) <= (2 if n == 13 else 1):
                        covered |= set(range(i, i + n))
            if covered:
                out[doc, item] = (len(covered), min(covered), max(covered))
    return out


def test_against_brute_force(spark, no_docs):
    rng = random.Random(1)
    text = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([3, 5, 8, 12, 13, 14, 20, 40, 60])] + [(50, None), (51, "")]
    docs = [(0, None), (1, ""), (2, "few words")]
    for k in range(60):
        passage = items[k % 9][1].split()
        begin = rng.randint(0, max(0, len(passage) - 14))
        passage = passage[begin : begin + rng.randint(8, 40)]
        for _ in range(rng.choice([0, 1, 2, 3])):
            passage[rng.randrange(len(passage))] = "other"
        docs.append((10 + k, " ".join(text(rng.randint(0, 30))) + " " + ", ".join(passage).upper() + ". " + " ".join(text(rng.randint(0, 30)))))
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for options in ({}, {"block_words": 60}):
        got = {(r.doc_id, r.item_id): (r.words, r.first_word, r.last_word) for r in d.overlaps(left, right, **options).collect()}
        assert got == expected
    gone = {doc for doc, _ in expected}
    assert {r.doc_id for r in d.clean(left, right).collect()} == {doc for doc, _ in docs} - gone
    assert d.overlaps(no_docs, right).count() == 0
    assert d.overlaps(left, right.limit(0)).count() == 0


def test_odd_rows(odd_docs):
    items = odd_docs.sparkSession.createDataFrame([(1, "word " * 30)], "item_id long, text string")
    assert [(r.doc_id, r.words) for r in d.overlaps(odd_docs, items).collect()] == [(10, 4000)]
    assert d.clean(odd_docs, items).columns == odd_docs.columns
    assert d.clean(odd_docs, items).count() == odd_docs.count() - 1


def test_benchmark_does_not_go_through_the_driver(spark):
    """Texts and seeds are joined in shuffles; repeated rows of both sides are reported each."""
    passage = " ".join(f"p{k}" for k in range(15))
    left = spark.createDataFrame([(1, passage), (1, passage), (2, "x " + passage), (3, "nothing")], "doc_id long, text string")
    right = spark.createDataFrame([(7, passage), (7, passage), (8, None)], "item_id long, text string")
    found = d.overlaps(left, right)
    assert sorted((r.doc_id, r.item_id, r.words, r.first_word) for r in found.collect()) == [(1, 7, 15, 0)] * 4 + [(2, 7, 15, 1)] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and "LocalTableScan" not in plan


def test_short_items_are_found_as_whole_documents(spark):
    left = spark.createDataFrame([(1, "Forty, two!"), (2, "forty two men"), (3, "yes"), (4, ""), (5, "two")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "forty two"), (2, "Yes."), (3, ""), (4, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.words) for r in d.overlaps(left, right).collect()) == [(1, 1, 2), (3, 2, 1)]
    assert sorted(r.doc_id for r in d.clean(left, right).collect()) == [2, 4, 5]


def test_short_items_with_a_replaced_word(spark):
    """Recall over items of 5 to 12 words, each copied into a document with one word replaced or none: all are found."""
    rng = random.Random(11)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(text(5 + k % 8))) for k in range(80)]
    docs, planted = [], set()
    for k, item in items:
        for wrong in (None, *range(len(item.split()))):
            copy = item.split()
            if wrong is not None:
                copy[wrong] = "replaced"
            planted.add((len(docs), k))
            docs.append((len(docs), " ".join(text(rng.randint(0, 20)) + copy + text(rng.randint(0, 20)))))
    clean = [(len(docs) + k, " ".join(text(60))) for k in range(200)]
    found = d.overlaps(spark.createDataFrame(docs + clean, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == planted
    two = spark.createDataFrame([(1, "a b x d e y g"), (2, "a b c d e y g")], "doc_id long, text string")
    assert [r.doc_id for r in d.overlaps(two, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).collect()] == [2]


def test_one_repeated_word_does_not_multiply(spark):
    docs = spark.createDataFrame([(1, "la " * 30_000), (2, "la " * 9), (3, "lo la " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 2_000), (2, "la " * 8), (3, "la lo " * 30)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.words, r.first_word, r.last_word) for r in d.overlaps(docs, items).collect()}
    assert found == {(1, 1): (30_000, 0, 29_999), (1, 2): (30_000, 0, 29_999), (2, 2): (9, 0, 8), (3, 3): (100, 0, 99)}
