"""Aggregates with null keys, null values, ties and hot keys; reports at their limits."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators.funnel import conversion_funnel
from stratalake.operators.rfm import rfm_scores
from stratalake.operators.sales import monthly_sales, product_sales, sales_by_channel, sales_by_country, segment_sales
from stratalake.plans import reports

SCHEMA = (
    "pedido_id string, cliente_id string, fecha_pedido date, pais_envio string, canal string, metodo_pago string, "
    "estado string, total_bruto decimal(14,2), descuento_pct decimal(5,2), total_neto decimal(14,2)"
)


def order(key, customer="C1", day="2024-05-01", country="Perú", channel="web", pay="PSE", state="enviado", gross=10, disc=0, net=10):
    number = [None if v is None else Decimal(str(v)) for v in (gross, disc, net)]
    return (key, customer, date.fromisoformat(day) if day else None, country, channel, pay, state, *number)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([
        order("P1", net=10), order(None, net=20), order("P3", country=None, net=99), order("P4", country="Chile", net=None, gross=None),
        order("P5", "C2", "2024-06-30", channel=None, disc="0.10", net=5), order("P6", None, None, net="0.10"),
        order("P7", "C9", "2024-06-01", "Chile", "app", "efectivo", "cancelado", net=30),
    ], SCHEMA)


def test_null_keys_leave_and_null_ids_are_not_counted(orders):
    assert [tuple(r) for r in sales_by_country(orders).select("pais_envio", "total_pedidos", "revenue_neto").collect()] == [
        ("Perú", 3, 35.1), ("Chile", 2, 30.0)]
    assert {r.canal: r.total_pedidos for r in sales_by_channel(orders).collect()} == {"web": 4, "app": 1}


def test_group_of_nulls_sums_to_zero(orders):
    only = sales_by_country(orders.filter("pedido_id = 'P4'")).first()
    assert (only.revenue_neto, only.ticket_promedio) == (0.0, None)


def test_months_leave_out_missing_dates(orders):
    assert rows(monthly_sales(orders)) == [("2024-05", 3, 129.0), ("2024-06", 2, 35.0)]


def test_products_join_and_duplicated_product_rows(spark):
    lines = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 5.5), ("B", 1, 1.0), ("Z", 9, 9.0), (None, 1, 1.0)],
                                  "producto_id string, cantidad int, subtotal double")
    products = spark.createDataFrame(
        [("A", "a", "c", "s"), ("A", "a", "c", "s"), ("B", "b", "c", None), ("C", "c", "c", "s")],
        "producto_id string, nombre_producto string, categoria string, subcategoria string")
    assert rows(product_sales(lines, products)) == [("A", "a", "c", "s", 6, 21.0)]


def test_segments_with_unknown_and_repeated_customers(spark, orders):
    customers = spark.createDataFrame([("C1", "B2B"), ("C2", "B2C"), ("C2", "B2C"), ("C3", "B2B")], "cliente_id string, segmento string")
    got = {r.segmento: tuple(r)[1:] for r in segment_sales(orders, customers).collect()}
    assert got == {"B2B": (1, 3, 129.0, 43.0), "B2C": (1, 2, 10.0, 5.0)}
    big = reports.big_customers(orders, customers, "B2C", 9.99)
    assert rows(big) == [("C2", "B2C", 2, 10.0)]
    assert reports.big_customers(orders, customers, "B2C", 10).count() == 0


def test_funnel_skips_missing_steps(spark):
    kinds = ["page_view"] * 100 + ["add_to_cart"] * 60 + ["purchase"] * 90 + ["search"] * 500
    events = spark.createDataFrame([(str(i), k) for i, k in enumerate(kinds)], "evento_id string, tipo_evento string")
    assert [tuple(r) for r in conversion_funnel(events).collect()] == [
        ("page_view", 100, 0.0), ("add_to_cart", 60, -0.4), ("purchase", 90, 0.5)]


def test_empty_orders_give_empty_tables(orders):
    none = orders.limit(0)
    for table in (rfm_scores(none), sales_by_country(none), monthly_sales(none), reports.monthly_retention(none),
                  reports.lost_order_share(none)):
        assert table.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_rfm_of_few_customers(spark, n):
    data = [order(f"P{i}", f"C{i}", f"2024-01-{i + 1:02d}", net=i) for i in range(n)]
    got = rfm_scores(spark.createDataFrame(data, SCHEMA)).orderBy("cliente_id").collect()
    assert [r.recency for r in got] == list(range(n, 0, -1))
    assert got[-1].recency_score == 5
    assert [r.monetary_score for r in got] == sorted(r.monetary_score for r in got)
    if n > 1:
        assert got[0].monetary_score == 1 and got[-1].monetary_score == 5


def test_rfm_score_sizes_with_ties(spark):
    df = spark.range(1003).select(
        F.col("id").cast("string").alias("pedido_id"), F.col("id").alias("cliente_id"),
        F.lit("2024-01-01").cast("date").alias("fecha_pedido"), F.lit(5).cast("decimal(14,2)").alias("total_neto"))
    sizes = [r["count"] for r in rfm_scores(df).groupBy("monetary_score").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_period_ends_are_included(spark, orders):
    lines = spark.createDataFrame([(f"P{i}", "A", 1, 1.0) for i in range(1, 8)], "pedido_id string, producto_id string, cantidad int, subtotal double")
    products = spark.createDataFrame([("A", "a", "c")], "producto_id string, nombre_producto string, categoria string")
    got = reports.top_products_between(lines, orders, products, "2024-06-01", "2024-06-30")
    assert rows(got) == [("A", "a", "c", 2, 2.0)]


def test_margin_is_weighted_by_lines(spark):
    lines = spark.createDataFrame([("A", 1, 5.0), ("A", 1, 5.0), ("B", 1, 1.0), ("F", 2, 3.0)], "producto_id string, cantidad int, subtotal double")
    products = spark.createDataFrame([("A", "c", 10.0, 5.0), ("B", "c", 10.0, 8.0), ("F", "c", 0.0, 8.0)],
                                     "producto_id string, categoria string, precio_venta double, costo double")
    assert rows(reports.category_margin(lines, products)) == [("c", 40.0, 14.0, 5)]


def test_lost_orders_are_a_share_of_all(orders):
    assert rows(reports.lost_order_share(orders)) == [("cancelado", 1, 14.29)]


def test_retention(spark):
    data = [order("1", "A", "2024-01-31"), order("2", "A", "2024-02-01"), order("3", "A", "2024-02-20"), order("4", "B", "2023-12-05"),
            order("5", "B", "2024-02-05"), order("6", None), order("7", "C", None)]
    got = reports.monthly_retention(spark.createDataFrame(data, SCHEMA))
    assert [tuple(r) for r in got.collect()] == [
        (date(2023, 12, 1), 0, 1), (date(2023, 12, 1), 2, 1), (date(2024, 1, 1), 0, 1), (date(2024, 1, 1), 1, 1)]
