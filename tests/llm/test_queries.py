"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import pytest

from checks.compare import compare, connect
from stratalake.llm.queries import ORACLE, QUERIES

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    same, note = compare(spark, connect(SF), SF, QUERIES[name], ORACLE[name])
    assert same, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if not name.startswith(("op8", "op10")):
        assert len({r.doc_id for r in rows}) == len(rows) == 200


def test_native_sharding_has_no_python(spark):
    plan = QUERIES["op4_extendible_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "MapInArrow", "Cartesian", "NestedLoop") if w in plan]


def test_pipeline(spark):
    from tests.llm.plain import decontaminated, exact, near

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = decontaminated(near(exact(rows)), items)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {k for k, _ in left}
    words = {k: len(t.encode().split()) + 1 for k, t in left}
    for k, n in words.items():
        assert sum(r.length for r in out if r.doc_id == k) == n


def _sf(spark, path, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, uid string").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    names = ("x", "y", "z")
    rows = [(*r, *names) for r in documents]
    rows += [(None, None, None, None, None, None, None, None), (None, "null id", None, "s", 7, *names), (900_001, None, "en", "s", 0, *names), (900_002, "", "en", "s", 0, *names),
             (900_003, "word " * 30_000, "en", "s", 150_000, *names), (*documents[0], *names), (*documents[0], *names)]
    sf = _sf(spark, tmp_path / "odd", rows, [(1, None), (2, ""), (3, "one two three four five six seven")])
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("quality", "exact_copies", "near_copies", "decontaminated"):
        kept = stages[name](spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows}


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = _sf(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
