"""Ranks, buckets and medians against pandas, with ties and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalake.operators.ordering import group_medians, rank_bucket, sortable, with_rank


def qcut_bucket(n):
    return pd.qcut(pd.Series(range(1, n + 1)), q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


def test_rank_bucket_equals_quantile_cut(spark):
    sizes = [*range(2, 51), 261, 999]
    pairs = [(n, r) for n in sizes for r in range(1, n + 1)]
    df = spark.createDataFrame(pairs, "n bigint, r bigint")
    got = df.select("n", "r", rank_bucket(F.col("r"), F.col("n"), 5).alias("b")).toPandas()
    for n in sizes:
        mine = got[got.n == n].sort_values("r").b.tolist()
        assert mine == qcut_bucket(n), n


def test_single_row_is_bucket_one(spark):
    df = spark.range(1).select(rank_bucket(F.lit(1), F.lit(1), 5).alias("b"))
    assert df.first().b == 1


def test_rank_with_a_value_held_by_a_third_of_rows(spark):
    n = 9000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 31 % 1000).alias("v"))
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    got = with_rank(df, order, "rank", "total").toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["v", "id"])
    assert got["rank"].tolist() == list(range(1, n + 1))
    assert got["id"].tolist() == want["id"].tolist()
    assert set(got.total) == {n}


def test_rank_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, v int")
    got = with_rank(df, [F.col("v").asc_nulls_last(), F.col("id").asc()], "rank").toPandas()
    assert got.sort_values("rank")["id"].tolist() == [3, 2, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_group_medians_equal_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    n = 6000
    group = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    value = np.round(rng.normal(100, 30, n), 2)
    value[rng.random(n) < 0.3] = 55.5
    pdf = pd.DataFrame({"g": group, "v": value})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    pdf.loc[pdf.g == "3", "v"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double")
    got = {r.g: r.median for r in group_medians(df, ["g"], "v").collect()}
    want = pdf.groupby("g").v.median().dropna().to_dict()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_medians_of_one_and_two_rows(spark):
    df = spark.createDataFrame([("a", 4), ("b", 1), ("b", 2)], "g string, v int")
    assert {r.g: r.median for r in group_medians(df, ["g"], "v").collect()} == {"a": 4.0, "b": 1.5}


def hard_numbers():
    rng = np.random.default_rng(8)
    near = [np.nextafter(2.0**k, d) for k in range(-1074, 1024, 7) for d in (-np.inf, np.inf)] + [2.0**k for k in range(-1074, 1024, 13)]
    odd = [0.0, -0.0, np.inf, -np.inf, 5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308, 1.0, -1.0, 0.1, 1e16]
    random = rng.integers(0, 2**63 - 2**53, 2000).view(np.float64)
    return np.unique(np.concatenate([near, odd, -np.array(near), random, -random]))


def test_sortable_keeps_the_order_of_all_doubles(spark):
    numbers = hard_numbers()
    df = spark.createDataFrame([(float(x),) for x in numbers], "v double")
    got = df.select("v", F.expr(sortable("v")).alias("k")).toPandas().sort_values("v")
    assert got.k.is_monotonic_increasing and got.k.is_unique
    bits = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.k.to_numpy() == np.where(got.v < 0, -bits, bits)).all()
    none = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(F.expr(sortable("v")).alias("k"))
    assert [r.k for r in none.collect()] == [None, None]


@pytest.mark.parametrize("seed", range(3))
def test_medians_of_hard_numbers(spark, seed):
    rng = np.random.default_rng(seed)
    numbers = hard_numbers()
    numbers = numbers[np.isfinite(numbers) & (np.abs(numbers) < 1e300)]
    rows, want = [], {}
    for g in [None, *"abcdefgh"]:
        values = rng.choice(numbers, rng.integers(1, 200))
        values = np.concatenate([values, rng.choice(values, 50)]) if g in ("a", None) else values
        rows += [(g, float(v)) for v in values]
        want[g] = float(np.median(values))
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    assert {r.g: r.median for r in group_medians(df, ["g"], "v").collect()} == want


def test_weighted_medians_and_no_groups(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3), (None, 100), (7.0, 1)], "v double, w int")
    assert [tuple(r) for r in group_medians(df, [], "v", out="m", weight="w").collect()] == [(1.5,)]
    assert group_medians(df.limit(0), [], "v").collect() == []
    two = group_medians(df.withColumn("a", F.lit("x")).withColumn("b", F.lit(None).cast("int")), ["a", "b"], "v").collect()
    assert [tuple(r) for r in two] == [("x", None, 4.5)]


def test_medians_of_a_column_of_one_value(spark):
    df = spark.range(100_000).select(F.lit(3.25).alias("v"), (F.col("id") % 3).alias("g"))
    assert {r.g: r.median for r in group_medians(df, ["g"], "v").collect()} == {0: 3.25, 1: 3.25, 2: 3.25}


def test_the_sort_key_is_worked_out_once_and_after_the_grouping(spark):
    assert sortable("price").count("price") == 1
    counted = spark.range(100).selectExpr("id % 3 AS g", "cast(id % 7 AS string) AS t").groupBy("g", "t").agg(F.count("*").alias("n"))
    medians = group_medians(counted.withColumn("v", F.expr("try_cast(t AS double)")), ["g"], "v", weight="n")
    plan = medians._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "LOG2" in line.upper()]
    assert {r.g: r["median"] for r in medians.collect()} == {0: 3.0, 1: 3.0, 2: 3.0}
