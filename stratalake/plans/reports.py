"""Named business reports over gold and silver frames, and a registry to run them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.functions.scalars import MONEY, as_double, exact_mean, exact_sum, ratio
from stratalake.plans.access import QueryRefused, check_read_only
from stratalake.plans.together import together
from stratalake.settings import LOST_STATES
from stratalake.sources.catalog import by
from stratalake.sources.layers import Lake

Frames = Mapping[str, DataFrame]


def top_products(products: DataFrame, limit: int = 10) -> DataFrame:
    """Best products by revenue, from the product gold table."""
    return products.select(
        "producto_id", "nombre_producto", "categoria", "unidades_vendidas", F.round("revenue", 2).alias("revenue"),
    ).orderBy(F.desc("revenue"), "producto_id").limit(limit)


def country_ranking(countries: DataFrame) -> DataFrame:
    return countries.select(
        F.col("pais_envio").alias("pais"), "total_pedidos",
        F.round("revenue_neto", 2).alias("revenue_neto"), F.round("ticket_promedio", 2).alias("ticket_promedio"),
    ).orderBy(F.desc("revenue_neto"), "pais")


def channel_revenue(channels: DataFrame) -> DataFrame:
    """Net revenue and revenue per order by channel."""
    return channels.select(
        "canal", "total_pedidos", F.round("revenue_neto", 2).alias("revenue_neto"),
        F.round(ratio(F.col("revenue_neto"), F.col("total_pedidos")), 2).alias("revenue_por_pedido"),
    ).orderBy(F.desc("revenue_neto"), "canal")


def big_customers(orders: DataFrame, customers: DataFrame, segment: str = "B2B", above: float = 500_000) -> DataFrame:
    """Customers of a segment whose orders add up to more than a limit.

    The limit is applied to the totals per customer before the join, which then sees only the
    customers that can be in the result. A customer id that occurs more than once in the
    customer table is counted once for each time, as a plain join of the rows does.
    """
    totals = orders.filter(F.col("cliente_id").isNotNull()).groupBy("cliente_id").agg(
        F.count("pedido_id").alias("_orders"), exact_sum("total_neto").alias("_net"))
    listed = customers.filter(F.col("segmento") == segment).groupBy("cliente_id", "segmento").agg(
        F.count("*").alias("_times"))
    return (
        totals.join(listed, "cliente_id")
        .select(
            "cliente_id", "segmento", (F.col("_orders") * F.col("_times")).alias("total_pedidos"),
            (F.col("_net") * F.col("_times")).alias("_sum"),
        )
        .filter(F.col("_sum") > above)
        .select("cliente_id", "segmento", "total_pedidos", F.round(as_double("_sum"), 2).alias("total_compras"))
        .orderBy(F.desc("total_compras"), "cliente_id")
    )


def compare_countries(orders: DataFrame, first: str = "Colombia", second: str = "México") -> DataFrame:
    return orders.filter(F.col("pais_envio").isin(first, second)).groupBy(F.col("pais_envio").alias("pais")).agg(
        F.count("*").alias("total_pedidos"),
        F.round(as_double(exact_sum("total_neto")), 2).alias("revenue_neto"),
        F.round(exact_mean("total_neto", MONEY), 2).alias("ticket_promedio"),
        F.round(exact_mean(F.col("descuento_pct") * 100), 2).alias("descuento_prom_pct"),
    )


def top_products_between(
    lines: DataFrame, orders: DataFrame, products: DataFrame,
    start: str = "2024-07-01", end: str = "2024-12-31", limit: int = 5,
) -> DataFrame:
    """Best products among the orders of a period, both ends included.

    The period reaches the order scan. Lines meet orders in a join on the order id, which
    adaptive execution splits where one order is hot, and are added up per product before the
    product table is joined.
    """
    period = orders.filter(
        (F.col("fecha_pedido") >= F.lit(start).cast("date")) & (F.col("fecha_pedido") <= F.lit(end).cast("date"))
    ).select("pedido_id")
    sold = lines.select("pedido_id", "producto_id", "cantidad", "subtotal").join(period, "pedido_id").groupBy(
        "producto_id").agg(F.sum("cantidad").alias("_units"), exact_sum("subtotal").alias("_revenue"))
    return (
        sold.join(products.select("producto_id", "nombre_producto", "categoria"), "producto_id")
        .groupBy("producto_id", "nombre_producto", "categoria")
        .agg(F.sum("_units").alias("unidades"), F.round(as_double(F.sum("_revenue")), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "producto_id")
        .limit(limit)
    )


def payment_by_country(orders: DataFrame) -> DataFrame:
    """Orders and net revenue of every payment method in every country, most used first."""
    return (
        orders.groupBy(F.col("pais_envio").alias("pais"), "metodo_pago")
        .agg(F.count("*").alias("total_pedidos"), F.round(as_double(exact_sum("total_neto")), 2).alias("revenue_neto"))
        .orderBy("pais", F.desc("total_pedidos"), "metodo_pago")
    )


def lost_order_share(orders: DataFrame) -> DataFrame:
    """Cancelled and returned orders and their share of all orders, in percent."""
    everything = orders.agg(F.count("*")).scalar()
    lost = orders.filter(F.col("estado").isin(*LOST_STATES)).groupBy("estado").agg(F.count("*").alias("total"))
    return lost.select("estado", "total", F.round(ratio(F.col("total") * 100, everything), 2).alias("porcentaje"))


def category_margin(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Mean gross margin in percent over the order lines of a category, revenue and units.

    Lines are counted and added up per product before the join; the mean over lines is then
    the mean over products weighted by their lines.
    """
    per_product = lines.filter(F.col("producto_id").isNotNull()).groupBy("producto_id").agg(
        F.count("*").alias("_lines"), exact_sum("subtotal").alias("_revenue"), F.sum("cantidad").alias("_units"))
    price, cost = as_double("precio_venta"), as_double("costo")
    margins = products.select("producto_id", "categoria", (F.try_divide(price - cost, price) * 100).alias("_margin"))
    weighed = F.sum(F.col("_margin") * F.col("_lines"))
    return (
        per_product.join(margins, "producto_id")
        .groupBy("categoria")
        .agg(
            F.round(ratio(weighed, F.sum(F.when(F.col("_margin").isNotNull(), F.col("_lines")))), 2).alias("margen_bruto_pct"),
            F.round(as_double(F.sum("_revenue")), 2).alias("revenue_total"),
            F.sum("_units").alias("unidades_vendidas"),
        )
        .orderBy(F.desc("revenue_total"), "categoria")
    )


def hourly_activity(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(F.hour("timestamp").alias("hora"), "tipo_evento")
        .agg(F.count("*").alias("total_eventos"))
        .orderBy("hora", F.desc("total_eventos"), "tipo_evento")
    )


def rfm_distribution(rfm: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent score codes with the means of their customers."""
    return (
        rfm.groupBy("rfm_score")
        .agg(
            F.count("*").alias("total_clientes"),
            F.round(exact_mean("recency"), 1).alias("recency_promedio"),
            F.round(exact_mean("frequency"), 1).alias("frequency_promedio"),
            F.round(exact_mean("monetary"), 2).alias("monetary_promedio"),
        )
        .orderBy(F.desc("total_clientes"), "rfm_score")
        .limit(limit)
    )


def monthly_retention(orders: DataFrame) -> DataFrame:
    """Customers of each first-order month that are active 0, 1, 2... months later.

    Orders shrink to one row per customer and month first. The first month then comes from a
    window over a customer's months, a handful of rows, so no second read and no join.
    """
    month = F.trunc("fecha_pedido", "MM").alias("_month")
    active = orders.filter(F.col("cliente_id").isNotNull() & F.col("fecha_pedido").isNotNull()).select(
        "cliente_id", month).distinct()
    from pyspark.sql import Window

    first = active.withColumn("cohorte", F.min("_month").over(Window.partitionBy("cliente_id")))
    later = (F.year("_month") - F.year("cohorte")) * 12 + F.month("_month") - F.month("cohorte")
    return (
        first.groupBy("cohorte", later.cast("bigint").alias("meses_desde_cohorte"))
        .agg(F.count("*").alias("clientes_activos"))
        .orderBy("cohorte", "meses_desde_cohorte")
    )


def countries_by_revenue(countries: DataFrame) -> DataFrame:
    return countries.select("pais_envio", "total_pedidos", F.round("revenue_neto", 0).alias("revenue_neto")).orderBy(
        F.desc("revenue_neto"), "pais_envio")


def best_sellers(products: DataFrame, limit: int = 10) -> DataFrame:
    best = products.orderBy(F.desc("revenue"), "producto_id").limit(limit)
    return best.select("nombre_producto", "categoria", "unidades_vendidas", F.round("revenue", 0).alias("revenue"))


def average_ticket(channels: DataFrame) -> DataFrame:
    ticket = F.round(ratio(F.col("revenue_neto"), F.col("total_pedidos")), 0)
    return channels.select("canal", ticket.alias("ticket_promedio")).orderBy(F.desc("ticket_promedio"), "canal")


def payment_in_country(orders: DataFrame, country: str = "Colombia") -> DataFrame:
    return (
        orders.filter(F.col("pais_envio") == country).groupBy("metodo_pago")
        .agg(F.count("*").alias("total_pedidos")).orderBy(F.desc("total_pedidos"), "metodo_pago")
    )


def customers_per_segment(customers: DataFrame) -> DataFrame:
    return (
        customers.filter(F.col("segmento").isNotNull()).groupBy("segmento")
        .agg(F.count("*").alias("total_clientes")).orderBy(F.desc("total_clientes"), "segmento")
    )


# Names are fixed values; each report takes the gold and silver frames by table name.
REPORTS: dict[str, Callable[[Frames], DataFrame]] = {
    "q01_top_productos_ingreso": lambda t: top_products(t["gold_top_productos"]),
    "q02_ventas_por_pais": lambda t: country_ranking(t["gold_ventas_por_pais"]),
    "q03_conversion_por_canal": lambda t: channel_revenue(t["gold_ventas_por_canal"]),
    "q04_clientes_b2b_grandes": lambda t: big_customers(by(t, "pedidos", "cliente_id"), t["clientes"]),
    "q05_colombia_vs_mexico": lambda t: compare_countries(t["pedidos"]),
    "q06_top5_productos_h2_2024": lambda t: top_products_between(t["detalle_pedidos"], t["pedidos"], t["productos"]),
    "q07_metodo_pago_por_pais": lambda t: payment_by_country(t["pedidos"]),
    "q08_tasa_cancelacion_devolucion": lambda t: lost_order_share(t["pedidos"]),
    "q09_margen_bruto_categoria": lambda t: category_margin(by(t, "detalle_pedidos", "producto_id"), t["productos"]),
    "q10_actividad_horaria": lambda t: hourly_activity(t["eventos"]),
    "q11_segmentacion_rfm": lambda t: rfm_distribution(t["gold_clientes_rfm"]),
    "q12_cohorte_retencion_mensual": lambda t: monthly_retention(t["pedidos"]),
    "paises_por_ingreso": lambda t: countries_by_revenue(t["gold_ventas_por_pais"]),
    "productos_mas_vendidos": lambda t: best_sellers(t["gold_top_productos"]),
    "ticket_promedio_por_canal": lambda t: average_ticket(t["gold_ventas_por_canal"]),
    "metodo_pago_en_pais": lambda t: payment_in_country(t["pedidos"]),
    "clientes_por_segmento": lambda t: customers_per_segment(t["clientes"]),
}


def load_sql_reports(path: str) -> dict[str, str]:
    """Name to SQL text from a file of blocks, each headed by a ``-- @name: ...`` line. Any path Spark reads."""
    whole = "\n".join(row.value for row in SparkSession.active().read.text(path, wholetext=True).collect())
    blocks = re.split(r"(?m)^--\s*@name:\s*(\S+).*$", whole)[1:]
    texts = {}
    for name, body in zip(blocks[::2], blocks[1::2]):
        text = re.sub(r"(?m)^\s*--.*$", "", body).strip().rstrip(";").strip()
        if text:
            texts[name] = text
    return texts


def run_reports(
    lake: Lake, frames: Frames, sql_reports: Mapping[str, str] | None = None,
    reports: Mapping[str, Callable[[Frames], DataFrame]] = REPORTS,
) -> DataFrame:
    """Run every report, several at a time, and write one CSV each; a failing report does not stop the others.

    ``sql_reports`` are SQL texts over the session's views; a text that is not a plain read is not run. Returns (name,
    rows, error).
    """
    spark: SparkSession = lake.spark

    def read(text: str) -> DataFrame:
        safe, reason = check_read_only(text, spark=spark)
        if not safe:
            raise QueryRefused(reason)
        return spark.sql(text)

    jobs = {**{n: (lambda b=b: b(frames)) for n, b in reports.items()},
            **{n: (lambda s=s: read(s)) for n, s in (sql_reports or {}).items()}}

    def status(name: str, build: Callable[[], DataFrame]) -> tuple[str, int | None, str | None]:
        try:
            return name, lake.write_report_csv(build(), name), None
        except Exception as error:  # noqa: BLE001 - reported, not raised
            return name, None, str(error).splitlines()[0]

    done = together(spark, {n: lambda n=n, b=b: status(n, b) for n, b in jobs.items()})
    return spark.createDataFrame([done[n] for n in jobs], "name string, rows bigint, error string")
