import hashlib
import random

import numpy as np
import pytest

from stratalake.llm import substring_dedup
from stratalake.llm.substring_dedup import LENGTH, NO_ID, repeated_substrings, segments
from stratalake.llm.suffix_array import permuted_prefixes, suffix_array


def brute(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        b, own = (t or "").encode(), NO_ID if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, own), own)
    for i, t in rows:
        b, own = (t or "").encode(), NO_ID if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < own:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(20)]
    rows = [(k, " ".join(rng.choice(base)[rng.randint(0, 20) :][: rng.randint(30, 200)] + word() for _ in range(rng.randint(0, 4)))) for k in range(100)]
    return rows + [(5, "x" * 500), (6, "x" * 300), (7, "xy" * 200), (8, "yx" * 200), (7, "x" * 60), (200, "a" * 49), (201, "a" * 50),
                   (202, "a" * 50), (None, base[1]), (None, base[1])] + [(300 + k, base[0] * 3) for k in range(50)]


@pytest.mark.parametrize("options", [{}, {"pack_bytes": 2000, "array_bytes": 3000}])
def test_against_brute_force(spark, options):
    rows = passages(3)
    df = repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), with_text=True, **options)
    got = df.collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted([tuple(r) for r in repeated_substrings(odd_docs).collect()], key=repr) == brute(rows)
    assert repeated_substrings(no_docs).count() == 0


def test_equal_windows_have_equal_hashes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 400).astype(np.uint8)
    data, offsets = np.concatenate((text, rng.integers(97, 101, 77).astype(np.uint8), text)), np.array([0, 430, 877])
    _, first, count, low = segments(data, offsets)
    by_window = {int(f) + k: h for f, n, h in zip(first, count, low) for k in range(n)}
    assert set(by_window) == {k for k in range(877) if k + 50 <= 430 or 430 <= k and k + 50 <= 877}
    for k in range(351):
        assert by_window[k] == by_window[477 + k]


def test_shards_get_equal_shares():
    data = np.random.default_rng(2).integers(97, 123, 400_000).astype(np.uint8)
    _, _, count, low = segments(data, np.array([0, len(data)]))
    shares = np.bincount(substring_dedup._shard(low, 40), weights=count + LENGTH - 1, minlength=40)
    assert shares.max() < 1.5 * shares.mean() and shares.min() > shares.mean() / 2


@pytest.mark.parametrize("edges", [b"abcdefgh", b"ab"])
def test_a_common_run_in_many_surroundings(monkeypatch, edges):
    """One hash has more text than an array may hold: no array is larger, and the answers are those of brute force."""
    rng, largest = random.Random(4), []
    made = substring_dedup.first_owners
    monkeypatch.setattr(substring_dedup, "first_owners", lambda texts, low: largest.append(sum(map(len, texts))) or made(texts, low))
    around = [bytes(rng.choices(edges, k=25)) for _ in range(40)]
    texts = [rng.choice(around)[rng.randint(0, 9) :] + b"common words of many" + rng.choice(around)[: rng.randint(14, 25)] for _ in range(900)]
    texts = [t for t in texts if len(t) >= LENGTH]
    owners = np.array([rng.randint(1, 200) for _ in texts])
    first = {}
    for t, own in zip(texts, owners.tolist()):
        for k in range(len(t) - LENGTH + 1):
            w = t[k : k + LENGTH]
            first[w] = min(first.get(w, own), own)
    want = [first[t[k : k + LENGTH]] < own for t, own in zip(texts, owners.tolist()) for k in range(len(t) - LENGTH + 1)]
    sizes = np.array([len(t) for t in texts])
    got = substring_dedup._before(b"".join(texts), np.cumsum(sizes) - sizes, sizes - LENGTH + 1, owners, np.zeros(len(texts), np.uint8), 4000)
    assert got.tolist() == want and sizes.sum() > 20_000 and max(largest) <= 4000


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    b = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 300)))
    if seed % 3 == 0:
        b = np.tile(b[: max(1, len(b) // 7)], 8)
    s = np.append(b, 0).astype(np.uint16)
    order = suffix_array(s, int(s.max()) + 1, 2 * len(s))
    assert order.tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
    prefix = permuted_prefixes(s, order, 20)
    for a, b in zip(order, order[1:]):
        same = 0
        while same < 20 and max(a, b) + same < len(s) and s[a + same] == s[b + same]:
            same += 1
        assert prefix[b] == same
