"""Profiles and exploration on hand-made frames: empty tables, NaN, booleans, long texts, ties."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators import explore, profiling
from stratalake.operators.profiling import (
    completeness, duplicated_rows, inventory, null_problems, profile, table_shape,
)
from stratalake.session import shared_dir

SCHEMA = "id bigint, name string, price double, ok boolean, day date, amount decimal(10,2)"


@pytest.fixture(scope="module")
def sample(spark):
    data = [(1, "a", 1.5, True, None, None), (2, "a", float("nan"), False, None, None), (3, None, 2.5, True, None, None),
            (4, "x" * 500, None, None, None, None), (4, "x" * 500, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def test_profile_of_all_kinds(sample):
    got = profile(sample, "t").toPandas().set_index("column")
    assert got.loc["id", ["nulls", "unique", "min", "max", "mean", "median"]].tolist() == [0, 4, 1, 4, 2.8, 3]
    assert got.loc["name", ["nulls", "unique"]].tolist() == [1, 2] and math.isnan(got.loc["name", "min"])
    assert got.loc["price", ["nulls", "unique", "min", "max", "mean", "median"]].tolist() == [3, 2, 1.5, 2.5, 2.0, 2.0]
    assert got.loc["ok", ["nulls", "unique", "min", "max", "mean", "median"]].tolist() == [2, 2, 0, 1, 0.67, 1]
    assert got.loc["day", ["nulls", "unique", "null_pct"]].tolist() == [5, 0, 100]
    assert got.loc["amount", ["nulls", "unique"]].tolist() == [5, 0] and math.isnan(got.loc["amount", "median"])
    assert got.loc["name", "null_pct"] == 20 and got.loc["id", "cardinality_pct"] == 80
    assert got.loc["amount", "dtype"] == "decimal(10,2)"


def test_profile_of_an_empty_table(spark):
    got = profile(spark.createDataFrame([], SCHEMA), "t").toPandas()
    assert len(got) == 6
    assert got[["nulls", "null_pct", "unique", "cardinality_pct"]].sum().tolist() == [0, 0, 0, 0]


def test_profile_equals_pandas(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"k": rng.integers(0, 50, n), "v": np.round(rng.normal(0, 9, n), 3), "big": rng.integers(2**60, 2**61, n)})
    pdf.loc[rng.random(n) < 0.34, "v"] = 1.25
    got = profile(spark.createDataFrame(pdf), "t").toPandas().set_index("column")
    for c in pdf:
        assert got.loc[c, "unique"] == pdf[c].nunique()
        assert got.loc[c, "median"] == pytest.approx(pdf[c].median(), abs=0.0051)
        assert got.loc[c, "mean"] == pytest.approx(pdf[c].astype(float).mean(), rel=1e-12, abs=0.0051)
        assert got.loc[c, "min"] == float(pdf[c].min()) and got.loc[c, "max"] == float(pdf[c].max())


def test_mean_of_huge_doubles_falls_back(spark):
    got = profile(spark.createDataFrame([(1e300,), (3e300,)], "v double"), "t").first()
    assert got["mean"] == 2e300


def test_approximate_profile_is_close(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).alias("k"), F.lit("c").alias("t"))
    got = profile(df, "t", approximate=True).toPandas().set_index("column")
    assert got.loc["id", "unique"] == pytest.approx(20000, rel=0.1)
    assert got.loc["k", "unique"] == pytest.approx(100, rel=0.1)
    assert got.loc["id", "median"] == pytest.approx(9999.5, rel=0.01)
    assert list(profile(df, "t").columns) == list(profile(df, "t", approximate=True).columns)


def test_full_row_duplicates_tell_nulls_and_separators_apart(spark):
    data = [("a", "b|c"), ("a|b", "c"), (None, "x"), ("", "x"), ("nan", "x"), ("~", "x"), ("a", "b|c"), (None, "x"), (None, "x")]
    got = duplicated_rows(spark.createDataFrame(data, "p string, q string"), "t").first()
    assert (got.total_rows, got.total_cols, got.duplicated_rows) == (9, 2, 3)
    empty = duplicated_rows(spark.createDataFrame([], "p string, q string"), "t").first()
    assert (empty.total_rows, empty.duplicated_rows) == (0, 0)


def test_completeness_and_shapes(spark, sample):
    empty = spark.createDataFrame([], SCHEMA)
    got = {r.tabla: r for r in completeness({"full": sample, "empty": empty}).collect()}
    assert (got["full"].total_filas, got["full"].total_columnas, got["full"].total_nulos) == (5, 6, 16)
    assert got["full"].pct_completitud == 46.67
    assert (got["empty"].total_nulos, got["empty"].pct_completitud) == (0, 0.0)
    assert rows(inventory({"full": sample, "empty": empty})) == [("empty", 0, 6), ("full", 5, 6)]
    assert table_shape(sample, "t").first().total_cols == 6


def test_null_problems_skip_audit_columns(sample):
    got = null_problems(profile(sample.withColumn("_row_hash", F.lit(None).cast("string")), "t"), ["_row_hash"])
    assert {r.column for r in got.collect()} == {"name", "price", "ok", "day", "amount"}


def test_null_columns_and_markers(sample):
    assert {r.column: r.nulls for r in explore.null_columns(sample).collect()} == {
        "name": 1, "price": 3, "ok": 2, "day": 5, "amount": 5}
    got = explore.marker_counts(sample, {"name": "a"}, ["name"]).first()
    assert (got.name_marker, got.name_blank) == (2, 1)


def test_value_counts_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, None)], "s string, n int")
    assert [tuple(r) for r in explore.value_counts(df, ["s", "n"]).collect()] == [
        ("n", "1", 2), ("n", "2", 1), ("s", "b", 2), ("s", "a", 1)]


@pytest.mark.parametrize("values", [[float(v * v % 97) for v in range(500)], [3.0, 3.0], [0.0, 20.0, 20.0, None]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = explore.histogram(df, "v").orderBy("bin").toPandas()
    counts, edges = np.histogram([v for v in values if v is not None], bins=20)
    assert got.rows.tolist() == counts.tolist()
    assert got["from"].tolist() == pytest.approx(edges[:-1].tolist()) and got["to"].tolist() == pytest.approx(edges[1:].tolist())


def test_shares_and_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert [tuple(r) for r in explore.category_share(df, "s").collect()] == [("a", 2, 66.7), ("b", 1, 33.3)]
    assert explore.repeated_keys(df, "s").first().rows == 1
    assert explore.count_where(df, F.col("s") == "a").first().rows == 2
    assert rows(explore.distinct_references(df, ["s"])) == [("s", 2)]
    summary = explore.numeric_summary(spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double"), "v").first()
    assert tuple(summary) == (1.0, 2.0, 1.5)


@pytest.mark.parametrize("few", [True, False])
def test_columns_in_steps(spark, monkeypatch, few):
    """Columns taken one at a time, hashes first, give the figures of all at once, and nothing of the steps stays."""
    df = spark.range(400).select(
        "id", (F.col("id") % 7).alias("k"), F.concat(F.lit("name "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.lit(20))).alias("alone"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 90).cast("string")).alias("some"), F.lit(None).cast("string").alias("none"))
    whole = rows(profile(df, "t"))
    monkeypatch.setattr(profiling, "PAIRS_AT_ONCE", 10)
    if not few:
        monkeypatch.setattr(profiling, "broadcast_if_small", lambda found: (found, False))
    assert rows(profile(df, "t")) == whole and {r[1]: r[5] for r in whole} == {"id": 400, "k": 7, "alone": 400, "some": 72, "none": 0}
    twice = df.unionByName(df.where("id < 30")).unionByName(df.where("id < 10"))
    assert duplicated_rows(twice, "t").first()[1:] == (440, 5, 40)
    assert [r.total_rows for r in profiling.table_profiles({"a": df, "b": twice}).collect()] == [400] * 5 + [440] * 5
    assert not [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("written-")]
