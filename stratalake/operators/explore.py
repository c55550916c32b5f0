"""Exploration: counts of values, nulls, references, shares and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.functions.scalars import is_blank, is_missing, mean_of, percent, ratio
from stratalake.operators.repair import surplus_rows


def null_columns(df: DataFrame) -> DataFrame:
    """(column, nulls, null_share) of the columns that hold nulls, from one pass."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
    lines = [F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("nulls"), F.col("n"))
             for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*lines))).filter("nulls > 0").select(
        "column", "nulls", percent(F.col("nulls"), F.col("n"), 1).alias("null_share"))


def marker_counts(df: DataFrame, markers: dict[str, object], blanks: Sequence[str] = ()) -> DataFrame:
    """One row: how often each column holds its marker value, and how often it is blank."""
    return df.agg(
        *[F.count_if(F.col(c) == value).alias(f"{c}_marker") for c, value in markers.items()],
        *[F.count_if(is_blank(F.col(c))).alias(f"{c}_blank") for c in blanks],
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) for several columns in one pass, most frequent first; nulls left out."""
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counted = tall.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("rows"))
    return counted.orderBy("column", F.desc("rows"), "value")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
        mean_of(F.col(column), df.schema[column].dataType).alias("mean"))


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("rows"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key."""
    return surplus_rows(df, [key])


def distinct_references(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) for reference columns."""
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    seen = tall.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("_one"))
    counted = seen.groupBy("column").agg(F.count("*").alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the range of the column, last bin closed; empty bins are listed.

    A column with a single value gets a range one wide around it.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    bounds = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("b")).select(
        F.when(F.col("b.low") == F.col("b.high"), F.struct(
            (F.col("b.low") - 0.5).alias("low"), (F.col("b.high") + 0.5).alias("high"))).otherwise(F.col("b")).alias("b"))
    edge = bounds.scalar()
    placed = values.select(F.col("x"), edge["low"].alias("low"), edge["high"].alias("high")).select(
        F.least(F.floor((F.col("x") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("rows"))
    # One row per bin on both sides.
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (edge["low"] + F.col("bin") * (edge["high"] - edge["low"]) / bins).alias("from"),
        (edge["low"] + (F.col("bin") + 1) * (edge["high"] - edge["low"]) / bins).alias("to"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"))


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all non-null rows in percent."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    whole = counts.agg(F.sum("rows")).scalar()
    return counts.select(column, "rows", F.round(ratio(F.col("rows") * 100, whole), 1).alias("share_pct")).orderBy(
        F.desc("rows"), column)
