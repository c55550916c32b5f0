"""Silver: repaired, masked and checked tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stratalake.functions.scalars import is_blank, is_missing
from stratalake.operators.ingest import FILE_ORDER
from stratalake.operators.masking import mask_customers
from stratalake.operators.profiling import table_profiles
from stratalake.operators.repair import (
    Repair, apply_all, fill_blank, fill_group_median, fill_null, fill_null_int, keep_first, log_lines, nullify, repair_log,
)
from stratalake.operators.rules import check_all
from stratalake.operators.tallies import ROWS, Tally, tallies
from stratalake.plans.together import together
from stratalake.session import pin
from stratalake.settings import (
    ACTION_CITY, ACTION_DURATION, ACTION_EMAIL, ACTION_ORDERS, ACTION_PHONE, ACTION_STOCK, DEFAULT_SITE, INVALID_PHONE,
    TABLES, UNKNOWN_CITY, Site,
)
from stratalake.sources.catalog import register
from stratalake.sources.dictionary import RESCUED
from stratalake.sources.layers import BRONZE, SILVER, Lake


def _first_order(df: DataFrame) -> DataFrame:
    """First occurrence in the file."""
    if FILE_ORDER not in df.columns:
        raise ValueError(f"orders need {FILE_ORDER}, their place in the file, to tell which row came first")
    return keep_first(df, ["pedido_id"], [FILE_ORDER], unique_order=True)


def repairs_of(table: str, site: Site = DEFAULT_SITE) -> list[Repair]:
    """The repairs of a table, in the order they apply."""
    repairs = {
        "clientes": [
            Repair("clientes", "email", ACTION_EMAIL.format(placeholder=site.missing_email),
                   lambda df: fill_null(df, "email", site.missing_email), lambda df: F.col("email").isNull()),
            Repair("clientes", "telefono", ACTION_PHONE,
                   lambda df: nullify(df, "telefono", INVALID_PHONE), lambda df: F.col("telefono") == INVALID_PHONE),
            Repair("clientes", "ciudad", ACTION_CITY,
                   lambda df: fill_blank(df, "ciudad", UNKNOWN_CITY), lambda df: is_blank(F.col("ciudad"))),
        ],
        "productos": [
            Repair("productos", "stock_disponible", ACTION_STOCK,
                   lambda df: fill_null_int(df, "stock_disponible"), lambda df: is_missing("stock_disponible", df.schema["stock_disponible"].dataType)),
        ],
        "pedidos": [
            Repair("pedidos", "pedido_id", ACTION_ORDERS, _first_order, surplus_of="pedido_id"),
        ],
        "eventos": [
            Repair("eventos", "duracion_seg", ACTION_DURATION,
                   lambda df: fill_group_median(df, "tipo_evento", "duracion_seg"),
                   lambda df: is_missing("duracion_seg", df.schema["duracion_seg"].dataType)),
        ],
    }
    return repairs.get(table, [])


def clean(table: str, df: DataFrame, site: Site = DEFAULT_SITE) -> DataFrame:
    """A silver table from its bronze table. Order lines pass unchanged.

    Customers are masked last, so that the placeholder for a missing address is not hashed.
    """
    repaired = apply_all(df, repairs_of(table, site)).drop(FILE_ORDER, RESCUED)
    return mask_customers(repaired, site) if table == "clientes" else repaired


def transformation_log(bronze: Mapping[str, DataFrame], run_time: str, site: Site = DEFAULT_SITE) -> DataFrame:
    """One row per repair with the number of rows it touched."""
    return reduce(DataFrame.unionByName, [
        repair_log(df, repairs_of(table, site), run_time) for table, df in bronze.items() if repairs_of(table, site)])


def _log(bronze: Mapping[str, DataFrame], counted: Mapping[str, Tally] | None, left: Mapping[str, Tally], run_time: str, site: Site) -> DataFrame:
    """The repair log, from counts if there are any."""
    if counted is None:
        return transformation_log(bronze, run_time, site)
    return reduce(DataFrame.unionByName, [
        log_lines(df.sparkSession, repairs_of(t, site), run_time, counted[t], counted[t][ROWS] - left[t][ROWS])
        for t, df in bronze.items() if repairs_of(t, site)])


def run(
    lake: Lake, run_time: str, site: Site = DEFAULT_SITE, approximate: bool = False, counted: Mapping[str, Tally] | None = None,
) -> dict[str, DataFrame]:
    """Clean every table; write rule reports of both phases, profile and log as report tables.

    ``counted``: what was counted while bronze was written, in the same run; without it bronze is counted here. Tables are
    cleaned at the same time, and so are the reports made.
    """
    bronze = lake.read_all(BRONZE)
    cleaned = {table: clean(table, bronze[table], site) for table in TABLES}
    # tables that lose repeated rows are shuffled whole: they are written first, while the disk holds little else
    whole = [t for t in TABLES if any(r.surplus_of for r in repairs_of(t, site))]
    written = {}
    for some in (whole, [t for t in TABLES if t not in whole]):
        written |= together(lake.spark, {t: lambda t=t: lake.write_counted(cleaned[t], SILVER, t, tallies(cleaned[t], t)) for t in some})
    silver, left = {t: written[t][0] for t in TABLES}, {t: written[t][1] for t in TABLES}

    def rules_and_profile() -> None:
        # one phase after the other, and the profile after them, so that the disk holds what one of them shuffles
        before = pin(check_all(bronze, counted=counted).withColumn("phase", F.lit("before")))
        after = pin(check_all(silver, counted=left).withColumn("phase", F.lit("after")))
        lake.write_report(before.unionByName(after), "silver_rules")
        lake.write_report(table_profiles(silver, approximate), "silver_profile")

    together(lake.spark, {
        "silver_rules": rules_and_profile,
        "silver_log": lambda: lake.write_report_csv(
            lake.write_report(_log(bronze, counted, left, run_time, site), "silver_log"), "log_transformaciones"),
    })
    register(silver)
    return silver
