"""Repairs of known defects, each with the count of rows it touches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratalake.functions.scalars import is_blank, is_missing
from stratalake.operators.ordering import median_steps, number_of, sort_key

LOG_SCHEMA = "tabla string, campo string, accion string, registros_afectados bigint, timestamp string"


def fill_null(df: DataFrame, name: str, value: object) -> DataFrame:
    """Null becomes a constant."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))


def nullify(df: DataFrame, name: str, value: object) -> DataFrame:
    """A marker value becomes null."""
    return df.withColumn(name, F.nullif(F.col(name), F.lit(value)))


def fill_blank(df: DataFrame, name: str, value: str) -> DataFrame:
    """Null, empty or white space becomes a constant."""
    return df.withColumn(name, F.when(is_blank(F.col(name)), F.lit(value)).otherwise(F.col(name)))


def fill_null_int(df: DataFrame, name: str, value: int = 0) -> DataFrame:
    """Null or NaN becomes a constant and the column an integer; what no integer can hold becomes null."""
    missing = is_missing(name, df.schema[name].dataType)
    return df.withColumn(name, F.when(missing, F.lit(value)).otherwise(F.col(name).try_cast("int")))


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], unique_order: bool = False) -> DataFrame:
    """First row per key in the given order; null keys form one group.

    Written as ``row_number() = 1``, which Spark also applies before the shuffle: each task
    sends at most one row per key, so a hot key costs no more than any other.
    Unless the order columns are known to be unique, all other columns break ties, so the
    surviving row never depends on the run. With a unique order, columns nobody asks for later
    are never read.
    """
    ties = [] if unique_order else [c for c in df.columns if c not in (*keys, *order_by)]
    order = Window.partitionBy(*keys).orderBy(*order_by, *ties)
    return df.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def fill_group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Null values become the median of their group, else the median of the whole column.

    The second median is taken after the first filling, so filled rows count in it; it reads no rows unless some null
    row has no group median (group all null, or group name null). All is one lazy plan: a query that does not ask for
    the column computes no median.
    """
    steps = [
        f"numbers AS (SELECT *, {sort_key('_v')} AS _k, 1L AS _w FROM (SELECT `{group}` AS _g, {number_of(f'`{value}`')} AS _v FROM {{rows}}))",
        "grouped AS (SELECT * FROM numbers WHERE _g IS NOT NULL)",
        *median_steps("grouped", ["_g"], "fills"),
        "sizes AS (SELECT _g, count(_v) AS _values, count_if(_v IS NULL) AS _gaps FROM numbers GROUP BY _g)",
        "unfilled AS (SELECT coalesce(sum(_gaps), 0) > 0 AS some FROM sizes WHERE _g IS NULL OR _values = 0)",
        "again AS (SELECT s._gaps, f._median AS _v FROM sizes AS s JOIN fills AS f ON s._g = f._g WHERE (SELECT some FROM unfilled))",
        # equal values are counted once, and all passes of the selection read these counts
        f"""counts AS (SELECT 1 AS _g, _v, _k, sum(_w) AS _w FROM (SELECT _v, _k, _w FROM numbers WHERE (SELECT some FROM unfilled)
            UNION ALL SELECT _v, {sort_key('_v')}, _gaps FROM again) GROUP BY _v, _k)""",
        *median_steps("counts", ["_g"], "overall"),
    ]
    shown = [f"coalesce({number_of(f'r.`{c}`')}, f._median, (SELECT _median FROM overall)) AS `{c}`" if c == value else f"r.`{c}`" for c in df.columns]
    # one statement, so that the plan is analysed once
    return df.sparkSession.sql(f"WITH {', '.join(steps)} SELECT {', '.join(shown)} FROM {{rows}} AS r LEFT JOIN fills AS f ON r.`{group}` = f._g", rows=df)


@dataclass(frozen=True)
class Repair:
    """One repair and how to count what it touches: a row test, or surplus rows of a key."""

    table: str
    column: str
    action: str
    apply: Callable[[DataFrame], DataFrame]
    touches: Callable[[DataFrame], Column] | None = None
    surplus_of: str | None = None


def apply_all(df: DataFrame, repairs: Sequence[Repair]) -> DataFrame:
    for repair in repairs:
        df = df.transform(repair.apply)
    return df


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with the number of rows beyond the first of their key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows"))


def log_lines(spark: SparkSession, repairs: Sequence[Repair], run_time: str, touched: Mapping[str, int], removed: int) -> DataFrame:
    """The log of repairs whose rows were counted while the tables were written. ``touched``: by action; ``removed``:
    rows that a repair of surplus rows left out."""
    rows = [(r.table, r.column, r.action, removed if r.surplus_of else touched[r.action], run_time) for r in repairs]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def repair_log(df: DataFrame, repairs: Sequence[Repair], run_time: str) -> DataFrame:
    """One row per repair: table, field, action, touched rows, time of the run.

    All row tests are counted in a single pass over the unrepaired frame.
    """
    parts = []
    tested = [r for r in repairs if r.touches is not None]
    if tested:
        counted = df.agg(*[F.count_if(r.touches(df)).alias(f"c{i}") for i, r in enumerate(tested)])
        entries = [
            F.struct(F.lit(r.table).alias("tabla"), F.lit(r.column).alias("campo"),
                     F.lit(r.action).alias("accion"), F.col(f"c{i}").alias("registros_afectados"))
            for i, r in enumerate(tested)
        ]
        parts.append(counted.select(F.inline(F.array(*entries))))
    for repair in repairs:
        if repair.surplus_of is not None:
            parts.append(surplus_rows(df, [repair.surplus_of]).select(
                F.lit(repair.table).alias("tabla"), F.lit(repair.column).alias("campo"),
                F.lit(repair.action).alias("accion"), F.col("rows").alias("registros_afectados")))
    if not parts:
        return df.sparkSession.createDataFrame([], LOG_SCHEMA)
    return reduce(DataFrame.unionByName, parts).withColumn("timestamp", F.lit(run_time))
