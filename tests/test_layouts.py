"""Catalog tables in buckets: joins and sums by their key need no shuffle."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators.sales import product_sales, segment_sales
from stratalake.plans import gold, reports, silver
from stratalake.sources import catalog


@pytest.fixture(scope="module")
def frames(spark):
    n = 4000
    orders = spark.range(n).select(
        F.concat(F.lit("P"), "id").alias("pedido_id"), F.concat(F.lit("C"), F.col("id") * 7 % 200).alias("cliente_id"),
        F.expr("date '2024-01-01' + cast(id % 366 as int)").alias("fecha_pedido"), F.lit("Perú").alias("pais_envio"),
        (F.col("id") % 97 * 1000).cast("decimal(14,2)").alias("total_neto"))
    lines = spark.range(3 * n).select(
        F.concat(F.lit("P"), F.col("id") % n).alias("pedido_id"), F.concat(F.lit("A"), F.col("id") * 11 % 300).alias("producto_id"),
        (F.col("id") % 5).cast("int").alias("cantidad"), (F.col("id") % 89).cast("decimal(14,2)").alias("subtotal"))
    customers = spark.range(200).select(F.concat(F.lit("C"), "id").alias("cliente_id"), F.when(F.col("id") % 2 == 0, "B2B").otherwise("B2C").alias("segmento"))
    products = spark.range(300).select(
        F.concat(F.lit("A"), "id").alias("producto_id"), F.concat(F.lit("name "), "id").alias("nombre_producto"), F.concat(F.lit("k"), F.col("id") % 9).alias("categoria"),
        F.lit("s").alias("subcategoria"), (F.col("id") + 20).cast("decimal(12,2)").alias("precio_venta"), (F.col("id") + 5).cast("decimal(12,2)").alias("costo"))
    return {"clientes": customers, "productos": products, "pedidos": orders, "detalle_pedidos": lines}


@pytest.fixture(scope="module")
def saved(spark, frames, tmp_path_factory):
    spark.sql("CREATE DATABASE layouts")
    spark.sql("USE layouts")
    made = catalog.save_layouts(frames, gold.LAYOUTS, 4, str(tmp_path_factory.mktemp("layouts")))
    yield made
    spark.sql("USE default")
    spark.sql("DROP DATABASE layouts CASCADE")


def below_first_join(plan):
    """The plan's text below its innermost joins: all lines deeper than the last join."""
    lines = plan.split("\n")
    at = max(k for k, line in enumerate(lines) if "Join" in line)
    return "\n".join(lines[at + 1 :])


QUERIES = {
    "q04": lambda t: reports.REPORTS["q04_clientes_b2b_grandes"](t),
    "q06": lambda t: reports.REPORTS["q06_top5_productos_h2_2024"](t),
    "q09": lambda t: reports.REPORTS["q09_margen_bruto_categoria"](t),
    "g4": lambda t: gold.BUILDERS["gold_top_productos"](t),
    "g5": lambda t: gold.BUILDERS["gold_segmento_clientes"](t),
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_joins_read_buckets_without_a_shuffle(spark, frames, saved, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = QUERIES[name](saved)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Exchange" not in below_first_join(plan), plan
        assert rows(result) == rows(QUERIES[name](frames))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_is_not_put_into_one_bucket(spark, tmp_path):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    even = hot.select(F.col("id").alias("k"), "id")
    assert catalog.spread(hot, "k", 64) > 15 and catalog.spread(even, "k", 64) < 2
    assert catalog.spread(hot.limit(0), "k", 64) == 1
    for name, df, bucketed in (("hot_rows", hot, False), ("even_rows", even, True)):
        saved = catalog.save_bucketed(df, name, "k", 64, str(tmp_path / name))
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        assert ("Num Buckets" in described) == bucketed
        assert saved.count() == 3000
        spark.sql(f"DROP TABLE {name}")


def test_layouts_are_found_by_key(frames, saved):
    assert catalog.by(saved, "pedidos", "cliente_id") is saved["pedidos__cliente_id"]
    assert catalog.by(saved, "pedidos", "pedido_id") is saved["pedidos"]
    assert catalog.by(frames, "pedidos", "cliente_id") is frames["pedidos"]
    assert silver.TABLES and set(saved) == {"clientes", "productos", "pedidos", "pedidos__cliente_id", "detalle_pedidos", "detalle_pedidos__producto_id"}
    assert rows(product_sales(saved["detalle_pedidos__producto_id"], saved["productos"])) and rows(segment_sales(saved["pedidos__cliente_id"], saved["clientes"]))
