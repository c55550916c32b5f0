"""Tables and views of the SQL catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: How much fuller than the mean a bucket may be.
MOST_SPREAD = 4.0


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a catalog table; ``path`` keeps its files in a folder of the caller."""
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def spread(df: DataFrame, key: str, buckets: int) -> float:
    """Rows of the fullest bucket over the mean, if ``df`` were dealt into buckets by ``key``."""
    counts = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    rows, fullest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return fullest * buckets / rows if rows else 1.0


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, most: float = MOST_SPREAD) -> DataFrame:
    """Create or replace a catalog table in buckets of ``key``, sorted by it, so that joins and sums by the key need no
    shuffle. A bucket is read by one task; where a hot key would fill one, the table is saved plain, and its joins stay
    with shuffles that adaptive execution can split."""
    if spread(df, key, buckets) > most:
        return save_table(df, name, path)
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def layout_name(table: str, key: str) -> str:
    return f"{table}__{key}"


def save_layouts(frames: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], buckets: int, folder: str | None = None) -> dict[str, DataFrame]:
    """Save each table in buckets of its first key under its own name, and once more for every other key.

    Returns the saved tables by name; a table without keys is saved plain.
    """
    saved = {}
    for table, df in frames.items():
        names = [table, *[layout_name(table, key) for key in keys.get(table, ())[1:]]]
        for name, key in zip(names, keys.get(table, ()) or [None]):
            path = f"{folder}/{name}" if folder else None
            saved[name] = save_bucketed(df, name, key, buckets, path) if key else save_table(df, name, path)
    return saved


def by(frames: Mapping[str, DataFrame], table: str, key: str) -> DataFrame:
    """The table, in the layout of the key if there is one."""
    name = layout_name(table, key)
    return frames[name] if name in frames else frames[table]


def register(frames: Mapping[str, DataFrame]) -> None:
    """Make frames visible to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views the session sees."""
    return spark.sql("SHOW TABLES").select("tableName").distinct().withColumnRenamed("tableName", "name").orderBy("name")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """(column_name, column_type) of a table or view."""
    described = spark.sql(f"DESCRIBE TABLE `{name}`")
    return described.select(described.col_name.alias("column_name"), described.data_type.alias("column_type"))
