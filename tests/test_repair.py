"""Repairs: placeholders, first rows of a key, medians with their fallback, and the log."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators.ordering import group_medians
from stratalake.operators.repair import fill_blank, fill_group_median, fill_null, fill_null_int, keep_first, nullify
from stratalake.plans.silver import clean, repairs_of, transformation_log


def test_constants(spark):
    df = spark.createDataFrame([(None,), ("N/A",), ("  ",), ("",), ("x",)], "c string")
    first = lambda f: [r[0] for r in f.collect()]
    assert first(fill_null(df, "c", "p")) == ["p", "N/A", "  ", "", "x"]
    assert first(nullify(df, "c", "N/A")) == [None, None, "  ", "", "x"]
    assert first(fill_blank(df, "c", "u")) == ["u", "N/A", "u", "u", "x"]
    stock = spark.createDataFrame([(47.0,), (None,)], "s double")
    filled = fill_null_int(stock, "s")
    assert filled.schema["s"].dataType.simpleString() == "int" and first(filled) == [47, 0]


def test_keep_first_is_ordered_and_idempotent(spark):
    df = spark.createDataFrame(
        [("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x"), (None, 9, "n"), (None, 4, "m")], "k string, o int, v string")
    once = keep_first(df, ["k"], ["o"], unique_order=True)
    assert rows(once) == sorted([("a", 1, "y"), ("b", 2, "x"), (None, 4, "m")], key=repr)
    assert rows(keep_first(once, ["k"], ["o"])) == rows(once)


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, plan


def pandas_fill(pdf):
    gap = pdf.v.isna()
    out = pdf.v.where(~gap, pdf.groupby("g").v.transform("median"))
    return out.fillna(out.median())


@pytest.mark.parametrize("with_empty_group", [False, True])
def test_median_fill_equals_pandas(spark, with_empty_group):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 9, n).astype(str)),
                        "v": rng.integers(1, 600, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    if with_empty_group:
        pdf.loc[pdf.g == "4", "v"] = np.nan
        pdf.loc[pdf.id % 100 == 0, "g"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, g string, v double")
    got = fill_group_median(df, "g", "v").toPandas().sort_values("id").v.tolist()
    assert got == pandas_fill(pdf).tolist()


def test_median_fill_by_shuffled_joins(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).cast("string").alias("g"),
                                 F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fill_group_median(df, "g", "v").toPandas().sort_values("id").v.tolist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == pandas_fill(df.toPandas().sort_values("id")).tolist()


def test_the_fill_is_lazy(spark):
    """No job while the plan is built, and no median for a query that does not ask for the column."""
    df = spark.range(600).select("id", (F.col("id") % 5).cast("string").alias("tipo_evento"), F.col("id").cast("double").alias("duracion_seg"))
    spark.sparkContext.setJobGroup("lazy-fill", "lazy-fill")
    filled = clean("eventos", df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-fill")
    spark.sparkContext._jsc.sc().clearJobGroup()
    plan = filled.groupBy("tipo_evento").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "log2" not in plan.lower(), plan


def test_long_keys_are_not_broadcast(spark):
    from stratalake.session import broadcast_if_small

    long = spark.range(100).select(F.repeat(F.lit("x"), 100_000).alias("k"))
    assert not broadcast_if_small(long)[1]
    assert broadcast_if_small(long.limit(10))[1]
    assert not broadcast_if_small(spark.range(20), max_rows=19)[1]
    assert broadcast_if_small(long.limit(0))[1]


def test_nan_counts_as_a_gap(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None)], "g string, v double")
    assert sorted(r.v for r in fill_group_median(df, "g", "v").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert group_medians(df, ["g"], "v").first().median == 2.0


def test_nothing_to_take_a_median_from(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "g string, v double")
    assert rows(fill_group_median(df, "g", "v")) == [("a", None), ("b", None)]
    assert rows(fill_group_median(df.limit(0), "g", "v")) == []


def test_log_counts_and_order_of_repairs(spark):
    customers = spark.createDataFrame(
        [("C1", "N", "A", None, "N/A", ""), ("C2", "N", "A", "a@b.co", "3001234567", "Lima")],
        "cliente_id string, nombre string, apellido string, email string, telefono string, ciudad string")
    orders = spark.createDataFrame([("P1",), ("P1",), ("P2",)], "pedido_id string")
    log = transformation_log({"clientes": customers, "pedidos": orders, "detalle_pedidos": orders}, "now")
    assert rows(log.select("campo", "registros_afectados")) == [("ciudad", 1), ("email", 1), ("pedido_id", 1), ("telefono", 1)]
    assert log.filter("registros_afectados > 0").count() == 4
    assert clean("clientes", customers).filter("cliente_id = 'C1'").first().email == "unknown@example.com"
    assert repairs_of("detalle_pedidos") == []
