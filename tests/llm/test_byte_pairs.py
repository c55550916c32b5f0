import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stratalake.llm.byte_pairs import Merges, decoded, encoded, not_made, pair_ranks, read_ranks
from stratalake.llm.queries import QUERIES

MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_ids(ranks, piece):
    """One pair at a time, the lowest rank first, then the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        at = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if at is None:
            return [ranks[p] for p in parts]
        parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]


def random_texts(rng, n):
    letters = ["a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "é", "ß", "日", "本", "🙂", "'s", "12", ".", "!!", " ", "\x1c", "\x85", "İ", " the", "ing", "́"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("head", [0, 40, 1 << 18])
def test_texts_against_the_library(spark, head):
    rng = random.Random(4)
    ranks = read_ranks(MULTI)
    texts = random_texts(rng, 1500) + ["", None, "x" * 3000, "ab" * 700, "".join(rng.choice("abcdefgh") for _ in range(900)), "日本語" * 100, "word " * 4000, "same", "same"]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = library(ranks)
    out = encoded(docs, MULTI, PATTERN, pack_bytes=20_000, head=head, decode=True)
    out = out.withColumn("back", decoded(spark, F.col("ids"), MULTI)).collect()
    assert all(r.decoded == r.back for r in out)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.back)) for r in out), key=repr)
    assert got == sorted(((k, own.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_ranks_that_no_training_gives(spark, seed):
    """Random vocabularies: joins may open pairs of lower rank, and whole pieces may be out of reach of the merges."""
    rng = random.Random(seed)
    pieces = {bytes([rng.choice(b"abc") for _ in range(rng.randint(2, 6))]) for _ in range(60)}
    kinds = [bytes([b]) for b in range(256)] + rng.sample(sorted(pieces), len(pieces))
    ranks = {p: k for k, p in enumerate(kinds)}
    merges = Merges(ranks)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 9, 20, 100]))) for _ in range(400)] + ["abc" * 60, "a" * 90] + [p.decode() for p in pieces]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    for r in frame.select("w", merges.ids(F.col("w")).alias("ids")).collect():
        assert r.ids == plain_ids(ranks, r.w.encode()), r.w
    assert not_made(ranks, pair_ranks(ranks))


def test_decoding(spark, tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate([b"a", b"bc", b"\xff"])))
    rows = spark.createDataFrame([(1, [0, 1, 2]), (2, []), (3, None), (4, [1, 1])], "k int, ids array<int>").repartition(2)
    got = {r.k: r.d and bytes(r.d) for r in rows.select("k", decoded(spark, F.col("ids"), str(path)).alias("d")).collect()}
    assert got == {1: b"abc\xff", 2: got[2], 3: None, 4: b"bcbc"} and not got[2]
    for wrong in ([3], [-1], [None]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            spark.createDataFrame([(wrong,)], "ids array<int>").select(decoded(spark, F.col("ids"), str(path))).collect()
    with pytest.raises(ValueError, match="single bytes"):
        Merges(read_ranks(str(path)))


def test_odd_rows(odd_docs, no_docs):
    own = library(read_ranks(MULTI))
    docs = odd_docs.withColumn("ids", F.lit("x")).withColumn("pack", F.lit(1))
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded(docs, MULTI, PATTERN).collect()), key=repr)
    assert got == sorted(((r.doc_id, own.encode_ordinary(r.text or "")) for r in odd_docs.collect()), key=repr)
    assert encoded(no_docs, MULTI, PATTERN).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    own = library(read_ranks(MULTI))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_byte_pair_encoding"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
