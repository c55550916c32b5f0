from collections import defaultdict

from stratalake.llm.sharding import shards, write_shards


def by_shard(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.shard].append(r)
    return out


def test_only_oversized_buckets_split(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 50 + 1)) for k in range(2000)], "doc_id long, text string").repartition(4)
    limit = 1000
    got = by_shard(shards(docs, limit))
    assert sum(map(len, got.values())) == 2000
    sizes = {s: sum(r.n_bytes for r in rows) for s, rows in got.items()}
    assert max(sizes.values()) <= limit
    # prefixes are disjoint, and the parent of each was too large
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:
        assert sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > limit


def test_rows_that_cannot_be_split_by_hash(spark):
    rows = [(1, "same text")] * 500 + [(2, "y" * 5000)] + [(k, "z") for k in range(10, 60)]
    got = by_shard(shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 900))
    assert sum(map(len, got.values())) == len(rows)
    for held in got.values():
        assert sum(r.n_bytes for r in held) <= 900 or len(held) == 1


def test_odd_rows(odd_docs, no_docs, tmp_path):
    assert shards(odd_docs, 500).count() == odd_docs.count()
    assert shards(no_docs, 500).count() == 0
    path = str(tmp_path / "shards")
    write_shards(odd_docs.drop("shard"), path, 500)
    assert odd_docs.sparkSession.read.parquet(path).count() == odd_docs.count()
