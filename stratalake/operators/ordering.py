"""Exact order statistics without pulling a whole column, or a whole group, into one task.

Ranks: rows are range-partitioned on a key that is unique, so hot values are split over partitions, and the placed
rows are written once; ranks then come from per-partition totals, one row per partition. Medians: radix selection,
without placing rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.functions.scalars import as_number
from stratalake.session import pin

_PARTITION_BITS = 33  # monotonically_increasing_id: partition above, row number below


def with_rank(df: DataFrame, order_by: Sequence[Column], rank: str, total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in the order, and the number of rows.

    ``order_by`` should end in a unique column: that gives a stable rank and even partitions.
    """
    placed = pin(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _PARTITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition, so this window is bounded by the partition count.
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    row_in_part = F.col("_slot").bitwiseAND((1 << _PARTITION_BITS) - 1)
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    added = {rank: F.col("_before") + row_in_part + 1}
    if total:
        added[total] = F.col("_total")
    return ranked.withColumns(added).select(*df.columns, *added)


def rank_bucket(rank: Column, total: Column, buckets: int) -> Column:
    """Bucket of a rank when the range 1..total is cut into equal widths, closed on the right.

    All integer arithmetic: ceil((rank - 1) * buckets / (total - 1)), at least 1. A single row
    falls into bucket 1.
    """
    span = F.greatest(total - 1, F.lit(1))
    scaled = (rank - 1) * buckets + span - 1
    whole = (scaled - F.pmod(scaled, span)) / span
    return F.greatest(F.lit(1), whole.cast("int"))


# The 64 bits of a number are fixed in three steps, the leading ones first. Few leading bits keep the first counts few.
DIGITS = (16, 24, 24)


def sortable(number: str) -> str:
    """SQL for a bigint for each double, in the same order: sign, exponent and fraction as IEEE 754 lays them out.

    Worked out exactly, since dividing by a power of two loses nothing; the logarithm may be off by one beside a power
    of two, which is put right. Both zeros are 0; NaN and null are null. The number, its size and the exponent are each
    worked out once, as the values of lambdas, however often the formula names them.
    """
    def once(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    fixed = "_guess + CASE WHEN pow(2.0D, _guess + 1) <= _size THEN 1 WHEN pow(2.0D, _guess) > _size THEN -1 ELSE 0 END"
    laid_out = f"shiftleft(cast(_exponent + 1023 AS bigint), 52) + cast((_size / pow(2.0D, _exponent) - 1) * {2.0**52!r}D AS bigint)"
    bits = f"""CASE WHEN isnan(_size) THEN NULL WHEN _size = 0 THEN 0L WHEN _size = double('Infinity') THEN {2047 << 52}L
        WHEN _size < {2.0**-1022!r}D THEN cast(_size / {2.0**-1074!r}D AS bigint)
        ELSE {once("cast(floor(log2(_size)) AS int)", "_guess", once(fixed, "_exponent", laid_out))} END"""
    return once(number, "_number", f"{once('abs(_number)', '_size', bits)} * CASE WHEN _number < 0 THEN -1L ELSE 1L END")


def number_of(name: str) -> str:
    """SQL for a column as double, NaN as null."""
    return f"nullif(cast({name} AS double), double('NaN'))"


def sort_key(number: str) -> str:
    """SQL for `sortable`, 0 for null."""
    return f"coalesce({sortable(number)}, 0L)"


def median_steps(source: str, keys: Sequence[str], made: str, few_groups: bool = False) -> list[str]:
    """Common table expressions that end in `made` (keys and _median) with the exact median of each group of `source`
    (keys, _v, _k = sortable of _v, _w = how often it counts). Rows without _v are left out. _k should never be null, or
    Spark works it out once more to test that, before any grouping below.

    Radix selection: values are counted by the leading 16 bits of their sortable form, with partial counts before the
    shuffle; a running total over the counts of a group tells in which of them the middle ranks lie; only rows in those
    take part in the next 24 bits, and so in the last 24. At most 2^24 counts of a group meet in a task, whatever its
    rows and values. ``few_groups``: the targets, two of a group at most, are broadcast, so that no rows are shuffled.
    """
    hint = "/*+ BROADCAST(t) */ " if few_groups else ""
    by, same = ", ".join(keys), " AND ".join(f"r.{key} <=> t.{key}" for key in keys)
    # A target is a middle rank: an odd number of values has one, an even number two. _prefix holds the bits fixed so
    # far, _rank the target's rank among the values that have them.
    shift = 64 - DIGITS[0]
    steps = [
        f"{made}_counts0 AS (SELECT {by}, shiftright(_k, {shift}) AS _prefix, sum(_w) AS _n, max(_v) AS _value FROM {source} WHERE _v IS NOT NULL GROUP BY ALL)",
        f"""{made}_totals0 AS (SELECT *, sum(_n) OVER (PARTITION BY {by} ORDER BY _prefix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto,
            sum(_n) OVER (PARTITION BY {by}) AS _all FROM {made}_counts0)""",
        f"{made}_wanted0 AS (SELECT {by}, _prefix, _value, _n, _upto, explode(array_distinct(array((_all + 1) div 2, _all div 2 + 1))) AS _target FROM {made}_totals0)",
        f"{made}_found0 AS (SELECT {by}, _target, _target - _upto + _n AS _rank, _prefix, _value FROM {made}_wanted0 WHERE _upto - _n < _target AND _target <= _upto)"]
    for k, bits in enumerate(DIGITS[1:], 1):
        before, shift = shift, shift - bits
        steps += [
            f"""{made}_counts{k} AS (SELECT {hint}t.{", t.".join(keys)}, t._target, t._rank, shiftright(r._k, {shift}) AS _prefix, sum(r._w) AS _n, max(r._v) AS _value
                FROM {source} AS r JOIN {made}_found{k - 1} AS t ON shiftright(r._k, {before}) = t._prefix AND {same}
                WHERE r._v IS NOT NULL GROUP BY ALL)""",
            f"""{made}_totals{k} AS (SELECT *, sum(_n) OVER (PARTITION BY {by}, _target ORDER BY _prefix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS _upto FROM {made}_counts{k})""",
            f"{made}_found{k} AS (SELECT {by}, _target, _rank - _upto + _n AS _rank, _prefix, _value FROM {made}_totals{k} WHERE _upto - _n < _rank AND _rank <= _upto)"]
    # all bits are fixed, so the rows of a target have one value
    return [*steps, f"{made} AS (SELECT {by}, (min(_value) + max(_value)) / 2 AS _median FROM {made}_found{len(DIGITS) - 1} GROUP BY {by})"]


def group_medians(df: DataFrame, groups: Sequence[str], value: str, out: str = "median", weight: str | None = None, few_groups: bool = False) -> DataFrame:
    """Exact median per group as one lazy plan, nulls and NaN left out. ``weight``: how often a row counts. ``few_groups``: as in `median_steps`."""
    keys = [f"_g{k}" for k in range(max(1, len(groups)))]
    columns = [F.col(g) for g in groups] or [F.lit(1)]
    rows = df.select(*[c.alias(key) for c, key in zip(columns, keys)], as_number(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    steps = [f"numbers AS (SELECT *, {sort_key('_v')} AS _k FROM {{rows}})", *median_steps("numbers", keys, "medians", few_groups)]
    listed = "".join(f"{key} AS `{g}`, " for key, g in zip(keys, groups))
    # one statement, so that the plan is analysed once
    return df.sparkSession.sql(f"WITH {', '.join(steps)} SELECT {listed}_median AS `{out}` FROM medians", rows=rows)
