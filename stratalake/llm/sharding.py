"""Sharding by extendible hashing, with DataFrame operations only.

A row's 60-bit hash is that of its id and text. A shard is a hash prefix: the shortest one whose rows fit
the byte limit, so only oversized buckets are split on another bit. The directory is kept as cells, hash
prefixes of one fixed depth that point to their shard; cells that are still too large are split further
by a deeper directory over their rows alone.

Cases: null text counts as empty, null ids as one value; a row larger than the limit is a shard by itself;
rows alike in id and text share their hash, so they are dealt out over numbered pages of one prefix, as
many as the limit asks for; an empty table gives an empty result. Every row gets exactly one shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.llm.store import keep, whole

BITS = 60
LIMIT = 16 << 20
MARGIN = 3


def _hash(id_col: str, text_col: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), whole(text_col))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _prefix(value: str, have: int, want) -> Column:
    return F.expr(f"shiftright({value}, {have} - {want})")


def _directory(rows: DataFrame, low: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(cell -> shard at depths low to depth, or null where the cell is still too large; the cells)."""
    cells = keep(rows.groupBy(_prefix("h", BITS, depth).alias("cell")).agg(
        F.sum("n_bytes").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")), "cells")
    levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")).withColumn(
        "prefix", _prefix("cell", depth, "depth"))
    nodes = levels.groupBy("depth", "prefix").agg(F.sum("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
    fitting = nodes.where((F.col("size") <= limit) | (F.col("first") == F.col("last"))).select("depth", "prefix")
    # a fitting prefix has fitting descendants, so the shortest one is the shard
    shortest = levels.join(fitting, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(shortest, "cell", "left"), cells


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, n_bytes, shard (prefix bits, and a page where one hash needs several), depth; with carry also `row`."""
    rows = keep(docs.select(
        F.col(id_col).alias("id"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"), _hash(id_col, text_col).alias("h"),
        *([F.struct("*").alias("row")] if carry else [])), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + MARGIN)
    done = []
    while True:
        directory, _ = _directory(rows, low, depth, limit)
        found = rows.withColumn("cell", _prefix("h", BITS, depth)).join(directory, "cell").drop("cell")
        done.append(found.where("depth IS NOT NULL"))
        if depth == BITS:
            break
        left = found.where("depth IS NULL").drop("depth")
        if directory.where("depth IS NULL").isEmpty():
            break
        rows, low, depth = keep(left, "rows"), depth + 1, min(BITS, depth + MARGIN + 1)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return _paged(placed.withColumn("prefix", _prefix("h", BITS, "depth")), limit).select(
        F.col("id").alias(id_col), "n_bytes",
        F.concat(F.when(F.col("depth") == 0, F.lit("all")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))),
                 F.when(F.col("page") > 0, F.concat(F.lit("-"), F.col("page").cast("string"))).otherwise(F.lit(""))).alias("shard"),
        "depth", *(["row"] if carry else []))


def _paged(placed: DataFrame, limit: int) -> DataFrame:
    """Add `page`: 0, but counted up where equal rows of one hash exceed the limit together."""
    alike = keep(placed.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.max("n_bytes").alias("each")).where(
        (F.col("rows") > 1) & (F.col("rows") * F.col("each") > limit)), "alike")
    if alike.isEmpty():
        return placed.withColumn("page", F.lit(0).cast("long"))
    # equal rows: number them inside input partitions, then add the counts of the partitions before
    few = keep(placed.join(alike, "h").withColumn("part", F.spark_partition_id()), "paged")
    before = few.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "h", "part", (F.sum("n").over(Window.partitionBy("h").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("h", "part").orderBy("n_bytes")) - 1
    paged = few.withColumn("number", number).join(before, ["h", "part"]).withColumn(
        "page", F.expr(f"(number + before) div greatest(1, {limit} div greatest(each, 1))"))
    return placed.join(alike, "h", "left_anti").withColumn("page", F.lit(0).cast("long")).unionByName(
        paged.drop("rows", "each", "part", "number", "before"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows as Parquet, one folder per shard."""
    shards(docs, limit, id_col, text_col, carry=True).select("shard", "row.*").repartition("shard").write.partitionBy("shard").parquet(path)


def shards_sql(limit: int = LIMIT) -> str:
    return f"""
        WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                          CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(31), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
                   FROM documents),
             n AS (SELECT d, h >> ({BITS} - d) AS p, sum(n_bytes) AS size, min(h) = max(h) AS one FROM r, range(0, 41) AS g(d) GROUP BY ALL),
             f AS (SELECT doc_id, n_bytes, h, min(d)::INT AS depth
                   FROM r, range(0, 41) AS g(e) JOIN n ON n.d = e AND n.p = h >> ({BITS} - e) WHERE size <= {limit} OR one GROUP BY ALL)
        SELECT doc_id, n_bytes, depth,
               CASE WHEN depth = 0 THEN 'all' ELSE lpad(ltrim(bin(h >> ({BITS} - depth)), '0'), depth, '0') END AS shard
        FROM f"""
