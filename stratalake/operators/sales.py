"""Sales aggregates. Money is summed in decimal and leaves as double; null keys are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalake.functions.scalars import MONEY, as_double, exact_mean, exact_sum, ratio


def sales_by_country(orders: DataFrame) -> DataFrame:
    """Orders, gross and net revenue and mean ticket per shipping country, best first."""
    return (
        orders.filter(F.col("pais_envio").isNotNull())
        .groupBy("pais_envio")
        .agg(
            F.count("pedido_id").alias("total_pedidos"),
            as_double(exact_sum("total_bruto")).alias("revenue_bruto"),
            as_double(exact_sum("total_neto")).alias("revenue_neto"),
            exact_mean("total_neto", MONEY).alias("ticket_promedio"),
        )
        .orderBy(F.desc("revenue_neto"), "pais_envio")
    )


def sales_by_channel(orders: DataFrame) -> DataFrame:
    """Orders, net revenue and mean discount per channel, best first."""
    return (
        orders.filter(F.col("canal").isNotNull())
        .groupBy("canal")
        .agg(
            F.count("pedido_id").alias("total_pedidos"),
            as_double(exact_sum("total_neto")).alias("revenue_neto"),
            exact_mean("descuento_pct").alias("descuento_promedio"),
        )
        .orderBy(F.desc("revenue_neto"), "canal")
    )


def monthly_sales(orders: DataFrame) -> DataFrame:
    """Orders and net revenue per ``yyyy-MM``; orders without a date are left out."""
    return (
        orders.filter(F.col("fecha_pedido").isNotNull())
        .groupBy(F.date_format("fecha_pedido", "yyyy-MM").alias("mes"))
        .agg(F.count("pedido_id").alias("total_pedidos"), as_double(exact_sum("total_neto")).alias("revenue_neto"))
        .orderBy("mes")
    )


def product_sales(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Units and revenue per product, best first. Lines without a known product are left out.

    Lines are added up per product before the join: one row per product and task is shuffled,
    so a best seller does not make a hot partition, and the join sees products, not lines.
    """
    named = ["nombre_producto", "categoria", "subcategoria"]
    per_product = lines.filter(F.col("producto_id").isNotNull()).groupBy("producto_id").agg(
        F.sum("cantidad").alias("_units"), exact_sum("subtotal").alias("_revenue"))
    known = products.select("producto_id", *named).dropna()
    return (
        per_product.join(known, "producto_id")
        .groupBy("producto_id", *named)
        .agg(
            F.coalesce(F.sum("_units"), F.lit(0)).alias("unidades_vendidas"),
            as_double(F.sum("_revenue")).alias("revenue"),
        )
        .orderBy(F.desc("revenue"), "producto_id")
    )


def segment_sales(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers, orders, net revenue and mean ticket per customer segment.

    Orders are added up per customer first, so the join and the distinct count see one row per
    customer, even when one customer holds a large part of all orders.
    """
    per_customer = orders.filter(F.col("cliente_id").isNotNull()).groupBy("cliente_id").agg(
        F.count("pedido_id").alias("_orders"),
        F.count("total_neto").alias("_priced"),
        exact_sum("total_neto").alias("_net"),
    )
    segments = customers.filter(F.col("segmento").isNotNull()).select("cliente_id", "segmento")
    return (
        per_customer.join(segments, "cliente_id")
        .groupBy("segmento")
        .agg(
            F.count_distinct("cliente_id").alias("total_clientes"),
            F.sum("_orders").alias("total_pedidos"),
            as_double(F.sum("_net")).alias("revenue_neto"),
            ratio(F.sum("_net"), F.sum("_priced")).alias("ticket_promedio"),
        )
    )
