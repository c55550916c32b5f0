"""Files of the layers: raw CSV in, Parquet between layers, reports out.

A table of a layer is a folder of versions. A version is written in full, then an empty file with its name is put into
the folder of committed versions; readers take the newest committed one. So a job that is lost half way leaves the old
version readable, on any store that creates files whole. A report keeps the rows of every run, each in a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from stratalake.operators.ingest import FILE_ORDER, with_file_order
from stratalake.settings import TABLES
from stratalake.sources.dictionary import apply_schema, read_dictionary, table_schema

RAW, BRONZE, SILVER, GOLD, REPORTS = "raw", "bronze", "silver", "gold", "reports"
COMMITTED = "_committed"
NO_RUN = "none"

# A quote inside a quoted value is doubled; a backslash is a plain character.
DIALECT = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, **options) -> DataFrame:
    """UTF-8 CSV with a header. Every column is text: markers such as ``N/A`` stay as they are.

    ``multi_line`` reads values that hold line breaks; such a file cannot be split over tasks.
    """
    return spark.read.options(**DIALECT, multiLine=multi_line, **options).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Version 2 of the format, which writes differences of numbers and of the beginnings of texts."""
    df.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").parquet(path, compression="zstd")


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header; white space inside values is kept as it is. ``compression``: ``gzip``, for one."""
    df.write.mode("overwrite").options(
        **DIALECT, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, compression=compression)


class Lake:
    """The layer folders under one root, any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, multi_line: Iterable[str] = (), run_time: str | None = None, kept_versions: int = 2):
        """``multi_line``: raw tables whose values hold line breaks. ``run_time``: the run that reports belong to; by
        default the newest one there is. ``kept_versions``: of a table; older ones are removed after a commit."""
        self.spark = spark
        self.multi_line = frozenset(multi_line)
        self.root = root.rstrip("/")
        self.run_time = run_time
        self.kept_versions = max(1, kept_versions)

    def path(self, layer: str, table: str) -> str:
        suffix = ".csv" if layer == RAW else ".parquet"
        return f"{self.root}/{layer}/{table}{suffix}"

    def _names(self, folder: str) -> list[str]:
        """Names in a folder of any store, in order; none if there is no such folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(status.getPath().getName() for status in files.listStatus(path)) if files.exists(path) else []

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def versions(self, layer: str, table: str) -> list[str]:
        """Committed versions of a table, the newest last."""
        return self._names(f"{self.path(layer, table)}/{COMMITTED}")

    def _commit(self, layer: str, table: str, version: str) -> None:
        folder = self.path(layer, table)
        files, marker = self._file_system(f"{folder}/{COMMITTED}/{version}")
        files.create(marker, False).close()
        for old in self.versions(layer, table)[: -self.kept_versions]:
            for path in (f"{folder}/{COMMITTED}/{old}", f"{folder}/{old}"):
                files.delete(self._file_system(path)[1], True)

    def dictionary(self) -> DataFrame:
        return read_dictionary(self.spark, self.path(RAW, "diccionario_datos"))

    def read_raw_text(self, table: str, keep_order: bool = False) -> DataFrame:
        """A raw table as it is in the file, all text. ``keep_order`` adds the place of each row in the file."""
        scan = read_csv(self.spark, self.path(RAW, table), table in self.multi_line)
        return with_file_order(scan) if keep_order else scan

    def typed(self, text: DataFrame, table: str) -> DataFrame:
        """Declared types; dates are still text. Text that does not fit stays in a column of its own."""
        return apply_schema(text, table_schema(self.dictionary(), table), rescue=True)

    def read_raw(self, table: str, keep_order: bool = False) -> DataFrame:
        """A raw table with its declared types."""
        return self.typed(self.read_raw_text(table, keep_order), table)

    def read(self, layer: str, table: str) -> DataFrame:
        """The newest committed version of a table; of a report the rows of this run, or of the newest run."""
        if layer == REPORTS:
            return read_parquet(self.spark, f"{self._report_folder(table)}/{self._run_folder(self.run_time or self.runs(table)[-1])}")
        versions = self.versions(layer, table)
        if not versions:
            raise FileNotFoundError(f"{layer} has no committed version of {table}")
        return read_parquet(self.spark, f"{self.path(layer, table)}/{versions[-1]}")

    def read_all(self, layer: str, tables: Iterable[str] = TABLES) -> dict[str, DataFrame]:
        return {table: self.read(layer, table) for table in tables}

    def write(self, df: DataFrame, layer: str, table: str) -> DataFrame:
        """Write a new version of a table, commit it and go on from the written files."""
        written = self.versions(layer, table)
        version = f"{int(written[-1].split('-')[0]) + 1 if written else 1:010d}-{uuid.uuid4().hex}"
        write_parquet(df, f"{self.path(layer, table)}/{version}")
        self._commit(layer, table, version)
        return self.read(layer, table)

    def write_counted(self, df: DataFrame, layer: str, table: str, counts: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
        """Write a table and take counts of its rows on the way, without a pass of their own."""
        seen = Observation()
        names = {f"c{k}": item for k, item in enumerate(counts)}
        written = self.write(df.observe(seen, *[counts[item].alias(n) for n, item in names.items()]), layer, table)
        return written, {item: seen.get[n] for n, item in names.items()}

    def _report_folder(self, name: str) -> str:
        return self.path(REPORTS, name)

    def _run_folder(self, run_time: str) -> str:
        return f"run={quote(run_time, safe=' ')}"

    def runs(self, name: str) -> list[str]:
        """Runs that have written a report, the newest last."""
        return sorted(unquote(n.removeprefix("run=")) for n in self._names(self._report_folder(name)) if n.startswith("run="))

    def history(self, name: str) -> DataFrame:
        """A report of all runs, told apart by ``run``."""
        return self.spark.read.option("mergeSchema", "true").parquet(self._report_folder(name)).withColumn("run", F.col("run").cast("string"))

    def write_report(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows of this run. A repeated run replaces its own rows and no others."""
        path = f"{self._report_folder(name)}/{self._run_folder(self.run_time or NO_RUN)}"
        write_parquet(df, path)
        return read_parquet(self.spark, path)

    def write_report_csv(self, df: DataFrame, name: str) -> int:
        """Write one report of this run as CSV and return its rows, counted while they are written."""
        seen = Observation()
        write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{self.root}/{REPORTS}/{name}.csv/{self._run_folder(self.run_time or NO_RUN)}")
        return seen.get["rows"]


__all__ = ["BRONZE", "FILE_ORDER", "GOLD", "Lake", "RAW", "REPORTS", "SILVER", "read_csv", "read_parquet",
           "write_csv", "write_parquet"]
