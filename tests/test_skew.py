"""One key with a third of all rows: results stay exact and no join puts the key into one task."""

import pytest
from pyspark.sql import functions as F

from stratalake.operators.sales import product_sales
from stratalake.plans import reports

ROWS = 300_000

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def shuffled_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_lines(spark, column):
    """Lines of which a third share one value in ``column``."""
    other = {"pedido_id": "producto_id", "producto_id": "pedido_id"}[column]
    return spark.range(0, ROWS, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias(column),
        (F.col("id") % 70).alias(other), F.lit(1).alias("cantidad"), F.lit(2).cast("decimal(14,2)").alias("subtotal"))


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_order_is_split_in_the_join(spark, shuffled_joins):
    orders = spark.range(5000).select(F.col("id").alias("pedido_id"), F.lit("2024-08-01").cast("date").alias("fecha_pedido"))
    products = spark.range(70).select(
        F.col("id").alias("producto_id"), F.lit("n").alias("nombre_producto"), F.lit("c").alias("categoria"))
    rows, plan = executed(reports.top_products_between(hot_lines(spark, "pedido_id"), orders, products, limit=100))
    assert sum(r.unidades for r in rows) == ROWS and sum(r.revenue for r in rows) == 2.0 * ROWS
    assert "SortMergeJoin(skew=true)" in plan


def test_best_seller_is_added_up_before_the_join(spark, shuffled_joins):
    products = spark.range(5000).select(
        F.col("id").alias("producto_id"), *[F.lit("x").alias(c) for c in ("nombre_producto", "categoria", "subcategoria")])
    rows, plan = executed(product_sales(hot_lines(spark, "producto_id"), products))
    assert rows[0].producto_id == 0 and rows[0].unidades_vendidas == ROWS // 3 + sum(
        1 for i in range(ROWS) if i % 5000 == 0 and i % 3)
    assert sum(r.unidades_vendidas for r in rows) == ROWS
    # Plans print the join above what feeds it: a partial sum lies below the join.
    assert plan.rindex("partial_sum(") > plan.rindex("SortMergeJoin")
