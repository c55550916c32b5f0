"""Gold: the aggregate tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from stratalake.operators.funnel import conversion_funnel
from stratalake.operators.profiling import completeness, inventory
from stratalake.operators.rfm import rfm_scores
from stratalake.operators.sales import monthly_sales, product_sales, sales_by_channel, sales_by_country, segment_sales
from stratalake.plans.together import together
from stratalake.settings import GOLD_TABLES, TABLES
from stratalake.sources.catalog import by, layout_name, register, save_layouts, save_table
from stratalake.sources.layers import GOLD, SILVER, Lake

BUILDERS = {
    "gold_ventas_por_pais": lambda t: sales_by_country(t["pedidos"]),
    "gold_ventas_por_canal": lambda t: sales_by_channel(t["pedidos"]),
    "gold_ventas_mensuales": lambda t: monthly_sales(t["pedidos"]),
    "gold_top_productos": lambda t: product_sales(by(t, "detalle_pedidos", "producto_id"), t["productos"]),
    "gold_segmento_clientes": lambda t: segment_sales(by(t, "pedidos", "cliente_id"), t["clientes"]),
    "gold_conversion_funnel": lambda t: conversion_funnel(t["eventos"]),
    "gold_clientes_rfm": lambda t: rfm_scores(by(t, "pedidos", "cliente_id")),
    "gold_resumen_calidad": lambda t: completeness({name: t[name] for name in TABLES}),
}


def build(name: str, silver: Mapping[str, DataFrame]) -> DataFrame:
    """One gold table from the silver frames."""
    return BUILDERS[name](silver)


# Keys the silver tables are joined and summed by.
LAYOUTS = {"clientes": ("cliente_id",), "productos": ("producto_id",), "pedidos": ("pedido_id", "cliente_id"),
           "detalle_pedidos": ("pedido_id", "producto_id"), "eventos": ()}


def saved(lake: Lake) -> dict[str, DataFrame]:
    """The catalog's silver tables in all their layouts, and the gold tables."""
    names = [*(n for t, keys in LAYOUTS.items() for n in (t, *(layout_name(t, k) for k in keys[1:]))), *GOLD_TABLES]
    return {name: lake.spark.table(name) for name in names}


def run(lake: Lake, as_tables: bool = False, buckets: int | None = None) -> dict[str, DataFrame]:
    """Write every gold table and their inventory; make gold and silver visible to SQL.

    ``as_tables`` saves the gold and silver tables in the session's catalog, silver first and in ``buckets`` (by default
    as many as shuffle partitions) of the keys it is joined by, so that gold and the reports join them without a shuffle.
    """
    silver = lake.read_all(SILVER)
    if as_tables:
        for name in (*TABLES, *GOLD_TABLES):
            lake.spark.catalog.dropTempView(name)  # a view would hide the table
        silver = save_layouts(silver, LAYOUTS, buckets or int(lake.spark.conf.get("spark.sql.shuffle.partitions")))
    gold = together(lake.spark, {name: lambda name=name: lake.write(build(name, silver), GOLD, name) for name in GOLD_TABLES})
    if as_tables:
        for name, df in gold.items():
            save_table(df, name)
    else:
        register({**silver, **gold})
    lake.write_report(inventory(gold), "gold_inventory")
    return gold
