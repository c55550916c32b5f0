"""Null tests, exact sums, shares, lenient casts, and running totals of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(18, 4)


def is_missing(name: str, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating point column."""
    column = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def as_number(column: Column | str) -> Column:
    """Double, with NaN as null."""
    return F.nullif(as_double(column), F.lit(float("nan")))


def is_blank(column: Column) -> Column:
    """Null, empty or only white space."""
    return column.isNull() | column.rlike(r"(?U)^\s*$")


def exact_sum(column: Column | str, scale: T.DecimalType = MONEY) -> Column:
    """Sum in decimal, so that the order of the rows cannot change it; 0 when all are null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(column.cast(scale)), F.lit(0).cast(scale))


def as_double(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, null when the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def exact_mean(column: Column | str, scale: T.DecimalType = RATE) -> Column:
    """Mean from a decimal sum; null when there is no value."""
    column = F.col(column) if isinstance(column, str) else column
    return ratio(F.sum(column.cast(scale)), F.count(column))


def mean_of(column: Column, dtype: T.DataType) -> Column:
    """Mean as double. Whole numbers and decimals are summed exactly; floating point numbers are averaged."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.avg(as_number(column))
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    number = column.cast("int") if isinstance(dtype, T.BooleanType) else column
    wide = number.cast(T.DecimalType(min(38, 28 + scale), scale))
    return ratio(F.sum(wide), F.count(number))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, rounded half up; 0 when the whole is 0."""
    return F.coalesce(F.round(ratio(part * 100, whole), digits), F.lit(0.0))


def lenient(column: Column, target: T.DataType) -> Column:
    """Cast that gives null where the text does not fit the type.

    Whole numbers may come as ``47.0``, so they are read as a decimal first.
    """
    if isinstance(target, (T.IntegerType, T.LongType)):
        return column.try_cast(T.DecimalType(38, 6)).try_cast(target)
    return column.try_cast(target)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """Sums up to each place of an array of whole numbers.

    After pass k every place holds the sum of the last 2^k numbers, so the passes are as many as the size has bits, and
    none of them appends to an array.
    """

    def add(sums: Column, k: Column) -> Column:
        return once(F.pow(F.lit(2.0), k).cast("int"), lambda back: F.transform(
            sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0))))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(numbers)))), numbers, add)
