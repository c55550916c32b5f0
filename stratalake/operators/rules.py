"""Quality rules as data: row tests, unique keys and references, with counts and violating rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.functions.scalars import is_blank, is_missing
from stratalake.session import broadcast_if_small, pin
from stratalake.settings import INVALID_PHONE, ORDER_STATES

KEYS = {"clientes": "cliente_id", "productos": "producto_id", "pedidos": "pedido_id", "detalle_pedidos": "item_id", "eventos": "evento_id"}

REPORT_SCHEMA = (
    "rule_id string, table string, description string, severity string, violations bigint, passed boolean"
)


@dataclass(frozen=True)
class Rule:
    """A rule of one table. Exactly one of the three checks is set.

    ``violates``: makes a Column over the table that is true for a violating row.
    ``unique``: a column whose values may occur only once.
    ``refers_to``: (column, parent table, parent column) that must exist in the parent.
    """

    rule_id: str
    table: str
    description: str
    severity: str
    violates: Callable[[DataFrame], Column] | None = None
    unique: str | None = None
    refers_to: tuple[str, str, str] | None = None


# Tests for the common kinds of row rule.

def when_null(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: is_missing(name, df.schema[name].dataType)


def when_value(name: str, value: object) -> Callable[[DataFrame], Column]:
    return lambda df: F.col(name) == value


def when_blank(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: is_blank(F.col(name))


def when_outside(name: str, allowed: Sequence[object]) -> Callable[[DataFrame], Column]:
    """Not one of the allowed values; null is not allowed either."""
    return lambda df: ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))


def when_net_off(net: str, gross: str, discount: str, tolerance: float) -> Callable[[DataFrame], Column]:
    return lambda df: F.abs(F.col(net) - F.col(gross) * (1 - F.col(discount))) > tolerance


def when_before(later: str, earlier: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.col(later) < F.col(earlier)


def when_not_above(high: str, low: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.col(high) <= F.col(low)


# Ids, tables and severities are fixed values.
RULES = (
    Rule("R001", "clientes", "customer key is unique", "error", unique="cliente_id"),
    Rule("R002", "pedidos", "order key is unique", "error", unique="pedido_id"),
    Rule("R003", "clientes", "email is present", "warning", when_null("email")),
    Rule("R004", "clientes", "phone is not the invalid marker", "warning", when_value("telefono", INVALID_PHONE)),
    Rule("R005", "clientes", "city is not blank", "warning", when_blank("ciudad")),
    Rule("R006", "productos", "stock is present", "warning", when_null("stock_disponible")),
    Rule("R007", "pedidos", "customer of the order exists", "error", refers_to=("cliente_id", "clientes", "cliente_id")),
    Rule("R008", "productos", "sale price is above cost", "warning", when_not_above("precio_venta", "costo")),
    Rule("R009", "pedidos", "net total agrees with gross and discount", "warning",
         when_net_off("total_neto", "total_bruto", "descuento_pct", 1.0)),
    Rule("R010", "pedidos", "delivery is not before the order", "warning", when_before("fecha_entrega", "fecha_pedido")),
    Rule("R011", "pedidos", "order state is a known one", "error", when_outside("estado", ORDER_STATES)),
    Rule("R012", "eventos", "event key is unique", "error", unique="evento_id"),
)


def rows_with_keys(df: DataFrame, keys: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows whose columns equal a row of ``keys``; nulls are equal. ``columns``: column to key column.

    The keys are written once and counted. A proven small set is broadcast, so that the rows
    themselves are not shuffled; a larger one is joined by shuffle, where adaptive execution
    splits a hot key.
    """
    found, _ = broadcast_if_small(pin(keys))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in columns.items()])
    return df.join(found, same, "left_semi")


def rows_of_repeated_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once, not just the extra ones.

    Keys are counted first, with partial counts before the shuffle, and the rows are then looked
    up. A window over the key would put all rows of a hot key into one task.
    """
    counted = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    return rows_with_keys(df, counted.filter("_n > 1").drop("_n"), {k: f"_k_{k}" for k in keys})


def orphan_keys(keys: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of ``keys`` whose reference is not in the parent; a null reference counts as missing.

    Parent keys are made distinct first: that needs no shuffle of its own, and a key that fills
    much of the parent arrives once per task.
    """
    known = parent.select(F.col(parent_column).alias("_parent")).distinct()
    return keys.join(known, F.col(column) == F.col("_parent"), "left_anti")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is not in the parent. Only distinct references are compared."""
    references = df.select(F.col(column).alias("_reference")).distinct()
    return rows_with_keys(
        df, orphan_keys(references, "_reference", parent, parent_column), {column: "_reference"})


def violating_rows(rule: Rule, df: DataFrame, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``df`` that break the rule."""
    if rule.violates is not None:
        return df.filter(rule.violates(df))
    if rule.unique is not None:
        return rows_of_repeated_key(df, [rule.unique])
    column, parent, parent_column = rule.refers_to
    return orphans(df, column, parents[parent], parent_column)


def violations(frames: Mapping[str, DataFrame], keys: Mapping[str, str] = KEYS, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule_id, table, key, rows): every key with rows that break a rule, and how many of them, for all rules at once.

    Each table is scanned once: its rows are counted per key together with what breaks each row rule, with partial counts
    before the shuffle, so a key that occurs more than once shows in the same counts. A reference is looked up in the
    parent's distinct keys; only these are read of the parent.
    """
    parts = []
    for table, df in frames.items():
        mine = [r for r in rules if r.table == table]
        if not mine:
            continue
        tests: dict[str, Column] = {r.rule_id: r.violates(df) for r in mine if r.violates is not None}
        for rule in (r for r in mine if r.refers_to is not None):
            column, parent, parent_column = rule.refers_to
            known = frames[parent].select(F.col(parent_column).alias(f"_{rule.rule_id}")).distinct()
            df = df.join(known, F.col(column) == F.col(f"_{rule.rule_id}"), "left")
            tests[rule.rule_id] = F.col(f"_{rule.rule_id}").isNull()
        unique = [r for r in mine if r.unique is not None]
        if any(r.unique != keys[table] for r in unique):
            raise ValueError(f"the unique rule of {table} is not over its key {keys[table]}")
        per_key = df.groupBy(F.col(keys[table]).cast("string").alias("key")).agg(
            F.count("*").alias("_n"), *[F.count_if(test).alias(rule_id) for rule_id, test in tests.items()])
        found = [F.struct(F.lit(rule_id).alias("rule_id"), F.col(rule_id).alias("rows")) for rule_id in tests]
        found += [F.struct(F.lit(r.rule_id).alias("rule_id"), F.when(F.col("_n") > 1, F.col("_n")).otherwise(0).alias("rows")) for r in unique]
        listed = per_key.select("key", F.inline(F.filter(F.array(*found), lambda hit: hit["rows"] > 0)))
        parts.append(listed.select("rule_id", F.lit(table).alias("table"), "key", "rows"))
    return reduce(DataFrame.unionByName, parts)


def _report(rule: Rule, count: Column) -> list[Column]:
    return [
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.table).alias("table"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.severity).alias("severity"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("violations"),
        (F.coalesce(count, F.lit(0)) == 0).alias("passed"),
    ]


def check_table(
    table: str, df: DataFrame, parents: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES, counted: Mapping[str, int] | None = None,
) -> DataFrame:
    """Violation count of every rule of one table.

    All row tests share one pass, or none if ``counted`` has their counts by rule id. Key and reference rules first count rows per key, so that
    only one row per distinct key and task is shuffled, however hot a key is.
    """
    mine = [r for r in rules if r.table == table]
    parts: list[DataFrame] = []

    row_rules = [r for r in mine if r.violates is not None]
    if row_rules and counted is not None:
        lines = [(r.rule_id, r.table, r.description, r.severity, counted[r.rule_id], counted[r.rule_id] == 0) for r in row_rules]
        parts.append(df.sparkSession.createDataFrame(lines, REPORT_SCHEMA))
    elif row_rules:
        sums = df.agg(*[F.count_if(r.violates(df)).alias(r.rule_id) for r in row_rules])
        lines = [F.struct(*_report(r, F.col(r.rule_id))) for r in row_rules]
        parts.append(sums.select(F.inline(F.array(*lines))))

    for rule in mine:
        if rule.unique is not None:
            per_key = df.groupBy(rule.unique).agg(F.count("*").alias("_n")).filter("_n > 1")
            parts.append(per_key.agg(F.sum("_n").alias("_v")).select(*_report(rule, F.col("_v"))))
        elif rule.refers_to is not None:
            column, parent, parent_column = rule.refers_to
            per_key = df.groupBy(column).agg(F.count("*").alias("_n"))
            lost = orphan_keys(per_key, column, parents[parent], parent_column)
            parts.append(lost.agg(F.sum("_n").alias("_v")).select(*_report(rule, F.col("_v"))))

    if not parts:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def check_all(frames: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES, counted: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Rule report over all tables at once. ``counted``: counts of the row rules by table and rule id, if there are any."""
    return reduce(DataFrame.unionByName, [
        check_table(table, df, frames, rules, (counted or {}).get(table)) for table, df in frames.items()
        if any(r.table == table for r in rules)
    ])


def check_phases(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Rule report before and after cleaning, told apart by ``phase``."""
    return check_all(before).withColumn("phase", F.lit("before")).unionByName(
        check_all(after).withColumn("phase", F.lit("after")))
