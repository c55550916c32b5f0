"""Bronze columns: source tag, ingest time, row hash, lenient dates, file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from stratalake.functions.digests import row_hash
from stratalake.functions.scalars import lenient

FILE_ORDER = "_file_order"


def is_date_name(name: str) -> bool:
    return "fecha" in name.lower()


def with_file_order(scan: DataFrame) -> DataFrame:
    """Add the place of each row in its source files as (path, offset of the split, row).

    Apply it directly to a file scan. Rows of one split are read in order by one task, so the
    running id orders them within the split, and path and offset order the splits, however
    Spark packs splits into tasks.
    """
    return scan.withColumn(
        FILE_ORDER,
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def with_lenient_dates(df: DataFrame, timestamp_name: str = "timestamp", formats: Sequence[str] = ()) -> DataFrame:
    """Columns named like dates and the event time become timestamps, so a time of day stays; bad text is null.

    ISO text is read first, then ``formats`` (Spark patterns such as ``dd/MM/yyyy``) in their order. Dates
    that are typed already stay as they are.
    """
    typed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType) and (is_date_name(field.name) or field.name == timestamp_name):
            text = F.col(field.name)
            others = [F.try_to_timestamp(text, F.lit(f)).cast(T.TimestampNTZType()) for f in formats]
            typed[field.name] = F.coalesce(lenient(text, T.TimestampNTZType()), *others)
    return df.withColumns(typed) if typed else df


def with_audit(df: DataFrame, source_file: str, run_time: str, technical: Sequence[str] = (FILE_ORDER,)) -> DataFrame:
    """Audit columns. The hash covers the business columns as they come, so give the text of the file."""
    business = [c for c in df.columns if c not in technical]
    return df.withColumns({
        "_source_file": F.lit(source_file),
        "_ingestion_timestamp": F.lit(run_time),
        "_row_hash": row_hash(business),
    })


def ingest(df: DataFrame, source_file: str, run_time: str, technical: Sequence[str] = (FILE_ORDER,)) -> DataFrame:
    """Audit columns and date typing. The same row has the same hash in every run."""
    return with_lenient_dates(with_audit(df, source_file, run_time, technical))
