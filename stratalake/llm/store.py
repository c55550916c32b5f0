"""Intermediate tables, written to the shared checkpoint folder so that they outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.session import shared_dir

#: What Spark allows by itself.
MOST_BUCKETS = 100_000


def new_folder(df: DataFrame, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet now and go on from the written rows."""
    path = new_folder(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_in_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write df as Parquet now, dealt into buckets by a column, and go on from the written rows: what groups by the column
    needs no shuffle of them. There are at least as many buckets as shuffle partitions."""
    session = df.sparkSession
    n = min(MOST_BUCKETS, max(buckets, int(session.conf.get("spark.sql.shuffle.partitions"))))
    table = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, column).options(path=new_folder(df, name), compression="zstd").saveAsTable(table)
    rows = session.table(table)
    session.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay
    return rows


def whole(text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))
