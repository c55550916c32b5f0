import zlib

import numpy as np
import pytest

from stratalake.llm import quality, text as tx

import pyarrow as pa

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    right = total = 0
    for r in labels.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if got[r.doc_id].held_out:
            total += 1
            right += got[r.doc_id].predicted == r.quality
    assert right / total > 0.95


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(a.tables, b.tables) and np.array_equal(a.pair_tables, b.pair_tables)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_scores_do_not_depend_on_the_batch():
    texts = ["Some plain words, and more.", "", "AAA!!! ### $$$", "word " * 500, "é ü"]
    data, offsets = tx.buffer(pa.array(texts))
    together = quality.features(data, offsets)
    for k, t in enumerate(texts):
        assert np.allclose(quality.features(*tx.buffer(pa.array([t])))[0], together[k])


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)], [(1, None), (2, 0), (2, 1), (3, 1), (3, 1), (77, 0)]])
def test_odd_rows(odd_docs, no_docs, rows):
    labels = odd_docs.sparkSession.createDataFrame(rows, "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    got = quality.scores(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.scores(no_docs, model).count() == 0
    assert quality.good(odd_docs, labels).columns == odd_docs.columns
