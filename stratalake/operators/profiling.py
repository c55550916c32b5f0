"""Profiles of whole tables: one row per column, exact unless asked otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalake.functions.digests import digest, row_text, short_key
from stratalake.functions.scalars import as_number, is_missing, mean_of, percent
from stratalake.operators.ordering import group_medians
from stratalake.operators.rules import rows_of_repeated_key
from stratalake.plans.together import together
from stratalake.session import broadcast_if_small, pin, shuffles_freed, written

# Pairs of a column and a value that are counted in one step.
PAIRS_AT_ONCE = 1 << 24


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def _number(field: T.StructField) -> Column:
    """The column as double; booleans count as 0 and 1, NaN as null."""
    column = F.col(field.name)
    return as_number(column.cast("int") if isinstance(field.dataType, T.BooleanType) else column)


def _null_count(field: T.StructField) -> Column:
    return F.count_if(is_missing(field.name, field.dataType))


def _measures(df: DataFrame, approximate: bool) -> DataFrame:
    """One row per column with all figures that need no shuffle, from one pass."""
    sums: list[Column] = [F.count("*").alias("n")]
    lines: list[Column] = []
    for i, field in enumerate(df.schema.fields):
        sums.append(_null_count(field).alias(f"nulls{i}"))
        figures = {"min": None, "max": None, "mean": None}
        if _is_numeric(field.dataType):
            number = _number(field)
            sums += [F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}"), mean_of(F.col(field.name), field.dataType).alias(f"mean{i}")]
            figures = {"min": F.col(f"min{i}"), "max": F.col(f"max{i}"), "mean": F.round(F.col(f"mean{i}"), 2)}
        entry = [
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col("n"),
            F.col(f"nulls{i}").alias("nulls"),
        ]
        entry += [
            (F.lit(None) if c is None else c).cast("double").alias(name) for name, c in figures.items()
        ]
        if approximate:
            sums.append(F.approx_count_distinct(F.col(field.name)).alias(f"unique{i}"))
            entry.append(F.col(f"unique{i}").alias("unique"))
            middle = F.lit(None).cast("double")
            if _is_numeric(field.dataType):
                sums.append(F.percentile_approx(_number(field), 0.5, 10_000).alias(f"median{i}"))
                middle = F.col(f"median{i}")
            entry.append(F.round(middle, 2).alias("median"))
        lines.append(F.struct(*entry))
    return df.agg(*sums).select(F.inline(F.array(*lines)))


def _distinct_values(df: DataFrame, fields: Sequence[T.StructField], key) -> DataFrame:
    """(column, value, rows) for the non-null values of the given columns, counted once each."""
    texts = df.select(*[key(f).alias(f.name) for f in fields])
    tall = texts.unpivot([], [f.name for f in fields], "column", "value")
    return tall.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("rows"))


def _numbers(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, unique, median) of numeric columns."""
    def as_text(f: T.StructField) -> Column:
        shown = F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        return F.when(~is_missing(f.name, f.dataType), shown.cast("string"))

    # Written once, since the passes of the selection and the distinct count all read them.
    with written(_distinct_values(df, fields, as_text).select("column", F.col("value").try_cast("double").alias("number"), "rows")) as counts:
        unique = counts.groupBy("column").agg(F.count("*").alias("unique"))
        medians = group_medians(counts, ["column"], "number", weight="rows", few_groups=True)
        return pin(unique.join(F.broadcast(medians), "column", "left").select("column", "unique", F.round("median", 2).alias("median")))


def _others(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, unique, median) of other columns, which have no median."""
    counts = _distinct_values(df, fields, lambda f: short_key(F.col(f.name).cast("string")))
    return pin(counts.groupBy("column").agg(F.count("*").alias("unique")).withColumn("median", F.lit(None).cast("double")))


def _large_others(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """As `_others`, of columns with many values: a value whose 64-bit hash occurs once is one of its own, and only values
    with a hash that occurs again are compared. If these hashes are many, there are fewer distinct values to compare."""
    tall = df.select(*[F.col(f.name).cast("string").alias(f.name) for f in fields]).unpivot([], [f.name for f in fields], "column", "value")
    tall = tall.filter(F.col("value").isNotNull()).withColumn("_key", F.xxhash64("column", "value"))
    with written(tall.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_key").alias("_again"))) as repeated:
        again, few = broadcast_if_small(repeated)
        if not few:
            return _others(df, fields)
        value = F.when(F.col("_again").isNotNull(), short_key(F.col("value"))).alias("value")
        counts = tall.join(again, F.col("_key") == F.col("_again"), "left").groupBy("column", value).agg(F.count("*").alias("rows"))
        unique = F.count("value") + F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0))
        return pin(counts.groupBy("column").agg(unique.alias("unique")).withColumn("median", F.lit(None).cast("double")))


def _exact_distribution(df: DataFrame, rows: int) -> DataFrame:
    """Distinct count per column, and the median of the numeric ones.

    Columns are turned into (column, value) pairs and equal pairs are counted before the
    shuffle. Distinct counts and medians of numeric columns come from the same counted
    pairs, which are written for that time only, and no column has to fit into one task.
    As many columns are taken at a time as have PAIRS_AT_ONCE pairs, at least one; with ``shuffles_freed``
    the disk holds the pairs of these only.
    """
    at_once, parts = max(1, PAIRS_AT_ONCE // max(1, rows)), []
    with shuffles_freed(df.sparkSession):
        for measure, numeric in ((_numbers, True), (_others, False)):
            fields = [f for f in df.schema.fields if _is_numeric(f.dataType) == numeric]
            if at_once < len(fields) and not numeric:
                measure = _large_others
            parts += [measure(df, fields[k : k + at_once]) for k in range(0, len(fields), at_once)]
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """One row per column: type, nulls, distinct values, and figures of numeric columns.

    ``approximate`` takes sketches for distinct counts and medians, in the same single pass.
    """
    measures = _measures(df, approximate)
    if not approximate:
        # At most one row per column of the table on either side.
        measures = measures.join(F.broadcast(_exact_distribution(df, df.count())), "column", "left")
    unique = F.coalesce(F.col("unique"), F.lit(0))
    return measures.select(
        F.lit(table).alias("table"), "column", "dtype", "nulls",
        percent(F.col("nulls"), F.col("n")).alias("null_pct"),
        unique.alias("unique"),
        percent(unique, F.col("n")).alias("cardinality_pct"),
        "min", "max", "mean", "median",
    )


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Nulls of every column and their share, in one pass without sketches."""
    counted = df.agg(F.count("*").alias("_n"), *[
        F.count_if(is_missing(f.name, f.dataType)).alias(f"_c{i}") for i, f in enumerate(df.schema.fields)])
    lines = [F.struct(F.lit(name).alias("column"), F.col(f"_c{i}").alias("nulls"), F.col("_n").alias("n")) for i, name in enumerate(df.columns)]
    return counted.select(F.inline(F.array(*lines))).select(
        F.lit(table).alias("table"), "column", "nulls", percent(F.col("nulls"), F.col("n")).alias("null_pct"))


def table_shape(df: DataFrame, table: str) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count("*").alias("total_rows")).select(
        F.lit(table).alias("table"), "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_cols"))


def duplicated_rows(df: DataFrame, table: str) -> DataFrame:
    """Row count, column count and number of rows that repeat an earlier identical row.

    Rows are counted by a 64-bit hash first. Only those whose hash occurs again are compared by digest; if these are
    many, all are, which needs no join.
    """
    texts = df.select(row_text(df.columns).alias("_text"))
    counted = texts.groupBy(F.xxhash64("_text").alias("_hash")).agg(F.count("*").alias("_n"))
    again, few = broadcast_if_small(pin(counted.filter("_n > 1").select("_hash")))
    compared = texts.join(again, F.xxhash64("_text") == F.col("_hash"), "left_semi") if few else texts
    per_row = compared.groupBy(digest(F.col("_text")).alias("_row")).agg(F.count("*").alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated_rows")).select(
        F.lit(table).alias("table"), F.coalesce(df.agg(F.count("*").alias("n")).scalar(), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_cols"), "duplicated_rows")


def table_profile(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """The profile of the columns, each line with the table's rows, columns and duplicated rows."""
    whole = pin(duplicated_rows(df, table))  # one row
    return profile(df, table, approximate).withColumns({
        name: whole.select(name).scalar() for name in ("total_rows", "total_cols", "duplicated_rows")})


def table_profiles(frames: Mapping[str, DataFrame], approximate: bool = False) -> DataFrame:
    """The profiles of several tables, written. Tables are taken at the same time as long as they have PAIRS_AT_ONCE values
    together, larger ones one after the other, so that the disk holds what one of them shuffles."""
    batches: list[dict[str, DataFrame]] = []
    room = 0
    for table, df in frames.items():
        values = df.count() * len(df.columns)
        if not batches or values > room:
            batches.append({})
            room = PAIRS_AT_ONCE
        batches[-1][table] = df
        room -= values
    made = {}
    for batch in batches:
        made |= together(next(iter(batch.values())).sparkSession, {t: lambda t=t, df=df: pin(table_profile(df, t, approximate)) for t, df in batch.items()})
    return reduce(DataFrame.unionByName, made.values())


def duplicates_by_key(df: DataFrame, key: str) -> DataFrame:
    """All rows of repeated keys, sorted by key.

    The other columns follow in the sort, so that the rows of a hot key spread over tasks.
    """
    rest = [c for c in df.columns if c != key]
    return rows_of_repeated_key(df, [key]).orderBy(key, *rest)


def null_problems(profiles: DataFrame, technical: Sequence[str]) -> DataFrame:
    """Columns of a profile that hold nulls, audit columns left out."""
    return profiles.filter((F.col("nulls") > 0) & ~F.col("column").isin(*technical)).select(
        "table", "column", "nulls", "null_pct")


def completeness(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, nulls over all cells, and share of filled cells in percent."""
    parts = []
    for table, df in frames.items():
        width = len(df.columns)
        cells_missing = reduce(lambda a, b: a + b, [
            is_missing(f.name, f.dataType).cast("bigint") for f in df.schema.fields])
        sums = df.agg(F.count("*").alias("total_filas"), F.coalesce(F.sum(cells_missing), F.lit(0)).alias("total_nulos"))
        cells = F.col("total_filas") * width
        parts.append(sums.select(
            F.lit(table).alias("tabla"), "total_filas",
            F.lit(width).cast("bigint").alias("total_columnas"), "total_nulos",
            percent(cells - F.col("total_nulos"), cells).alias("pct_completitud"),
        ))
    return reduce(DataFrame.unionByName, parts)


def inventory(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of each table."""
    return reduce(DataFrame.unionByName, [table_shape(df, name) for name, df in frames.items()])
