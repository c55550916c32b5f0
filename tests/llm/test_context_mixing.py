import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalake.llm import context_mixing as cm, text as tx

import pyarrow as pa


def base(rows):
    tokens = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] + [b""]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in rows]


def check(docs, rows, **options):
    got = sorted(cm.scores(docs, **options).collect(), key=lambda r: (repr(r.doc_id), r.base_score))
    want = sorted(base(rows), key=lambda r: (repr(r[0]), r[5]))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in got], [r[5] for r in want])
    assert all(r.score < 0 for r in got)


def test_base_with_and_without_joined_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)
    check(docs, rows, head=20)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()], head=2)
    assert cm.scores(no_docs).count() == 0


def test_unseen_texts_cost_less_than_without_contexts(spark):
    # the unigram base is no bar at this size: it gives an unknown word one share whatever its letters
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cm.scores(docs).where("held_out").selectExpr("avg(bits_per_byte) AS b").first()
    text = "".join(r.text for r in docs.collect()).lower().encode()
    share = np.bincount(np.frombuffer(text, np.uint8)) / len(text)
    share = share[share > 0]
    assert got.b < 0.7 * -(share * np.log2(share)).sum()


def tables(texts, bits):
    counts = [np.zeros(16 << b, np.uint32) for b in bits]
    for _, rows, valid, _ in cm._strips(*tx.buffer(pa.array(texts))):
        there = np.arange(rows.shape[1] - cm.BACK) < valid[:, None]
        for total, lines in zip(counts, cm._lines(rows, bits)):
            cm._tally(total, (lines + cm._halves(rows))[there].reshape(-1))
    return cm.Opinions([cm.opinions(c) for c in counts]).tables()


def test_next_byte_probabilities_sum_to_one():
    bits = (12,) * 4
    said = tables(["the cat sat on the mat", "the dog sat"], bits)
    nexts = [bytes([b]) for b in range(255)]
    texts = pa.array([b"the ca" + n for n in nexts], pa.binary())
    data, offsets = tx.buffer(texts)
    # without the end byte of the longer texts, and with the end byte after the prefix
    with_end = cm.log_probabilities(data, offsets, said, bits)
    ends = cm.log_probabilities(*tx.buffer(pa.array([b"the ca"], pa.binary())), said, bits)[0]
    prefix = math.exp(ends)
    longer = []
    for n, total in zip(nexts, with_end):
        # p(prefix + n) = p(prefix + n + END) / p(END | prefix + n); the last factor by all bytes again
        tails = cm.log_probabilities(*tx.buffer(pa.array([b"the ca" + n + bytes([b]) for b in range(255)], pa.binary())), said, bits)
        longer.append(math.exp(total))
        assert total > tails.max() - 60
    assert prefix + sum(longer) <= 1


@pytest.mark.parametrize("size", [0, 1, 63, 64, 1023, 1024, 1025, 5000])
def test_scores_do_not_depend_on_the_batch(size):
    bits = (12,) * 4
    said = tables(["some words and some more words " * 20], bits)
    texts = ["some words " * (size // 11 + 1)][0][:size]
    alone = cm.log_probabilities(*tx.buffer(pa.array([texts])), said, bits)[0]
    among = cm.log_probabilities(*tx.buffer(pa.array(["x" * 3000, texts, "", "y" * 7])), said, bits)[1]
    assert abs(alone - among) < 1e-6 * max(1, abs(alone))


def test_every_context_has_counts_of_its_own(spark):
    """Opinions of packs, met by range, are those of the counts of the whole corpus, whatever its size."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 700, 3000]))) for _ in range(120)]
    rows = [(k, t, k % 7 == 3) for k, t in enumerate(texts)]
    packed = cm.packs(spark.createDataFrame(rows, "id long, text string, held_out boolean").repartition(3), 20_000)
    assert packed.count() > 6
    got = cm.context_opinions(cm.context_counts(packed, 17), 17).collect()
    total = Counter()
    for _, t, held in rows:
        data = bytes(8) + t.encode() + b"\xff"
        total.update((data[p - 6 : p], data[p]) for p in range(8, len(data)) if not held)
    lines = {}
    for (c, b), n in total.items():
        lines.setdefault(c, np.zeros(256))[b] += n
    for pack in packed.collect():
        said = [np.concatenate([cm._unpacked(r.said, r.n).view(np.int8).reshape(-1, 8) for r in sorted(got, key=lambda r: r.range) if (r.pack, r.context) == (pack.pack, k)]) for k in range(4)]
        codes, here = [], []
        for docs, padded, valid, _ in cm._strips(*tx.buffer(pa.array(pack.texts))):
            code = cm._codes(padded, 2)
            for i in range(len(docs)):
                codes += code[i, : valid[i]].tolist()
                here += [(bytes(padded[i, p + 2 : p + 8]), int(padded[i, p + 8])) for p in range(valid[i])]
        assert len(set(codes)) == len(set(here)) == len(said[2])
        for place, (c, b) in enumerate(h for _, h in sorted(dict(zip(codes, here)).items())):
            counts = lines.get(c, np.zeros(256)).reshape(16, 16)
            want = [*cm.opinions(counts.sum(axis=1))[cm.NODES[b >> 4]] * cm.SIGNS[b >> 4], *cm.opinions(counts[b >> 4])[cm.NODES[b & 15]] * cm.SIGNS[b & 15]]
            assert said[2][place].tolist() == want


def test_scores_do_not_depend_on_packs_and_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, other = ({r.doc_id: r.score for r in cm.scores(docs, **o).collect()} for o in ({}, {"pack_bytes": 5000, "range_bytes": 1000}))
    assert one.keys() == other.keys() and np.allclose(list(one.values()), [other[k] for k in one])


def test_places_of_codes():
    rng = np.random.default_rng(5)
    for codes in (rng.integers(0, 1 << 55, 5000, np.uint64).repeat(3), np.arange(9, dtype=np.uint64) << np.uint64(46), np.zeros(4, np.uint64), np.arange(1, dtype=np.uint64)):
        rng.shuffle(codes)
        met, place = cm._placed(codes)
        assert (met[place] == codes).all() and len(met) == len(set(codes.tolist()))


def test_codes_that_share_the_sorted_bits_stay_apart():
    low = pow(int(tx.STEP), -1, 1 << 64)  # times STEP, k * low is k: all tops are 0
    codes = np.array([k * low % (1 << 64) for k in (0, 1, 0, 1, 2)], np.uint64)
    met, place = cm._placed(codes)
    assert (met[place] == codes).all() and len(met) == 3


def test_what_a_pack_sends_is_compressed(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(20_000)]
    rows = [(k, " ".join(rng.choice(words, 400)), False) for k in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string, held_out boolean").repartition(1)
    sent = cm.context_counts(cm.packs(docs), 8).selectExpr("sum(octet_length(codes) + octet_length(counts)) / sum(n)").first()[0]
    assert sent < 5
