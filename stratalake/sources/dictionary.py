"""The data dictionary: declared types, personal-data flags, owners and retention of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratalake.functions.scalars import lenient

# Fixed format: the columns of the dictionary file, in order.
DICTIONARY_SCHEMA = (
    "tabla string, columna string, tipo_dato string, descripcion string, es_pii string, "
    "data_owner string, retencion_dias int, clasificacion string, constraint_tipo string"
)
PERSONAL = "Sí"

RESCUED = "_rescued"

SIMPLE_TYPES = {
    "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "CHAR": T.StringType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "REAL": T.FloatType(), "SMALLINT": T.ShortType(),
    "STRING": T.StringType(), "TEXT": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "VARCHAR": T.StringType(),
}


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=DICTIONARY_SCHEMA, encoding="UTF-8")


def schema_rows(dictionary: DataFrame, table: str) -> DataFrame:
    """The dictionary rows of one table."""
    return dictionary.filter(F.col("tabla") == table)


def spark_type(declared: str) -> T.DataType:
    """Spark type of a declared SQL type; an unknown one is refused."""
    name, _, inside = declared.strip().upper().partition("(")
    name = name.strip()
    if name in SIMPLE_TYPES:
        return SIMPLE_TYPES[name]
    if name in ("DECIMAL", "NUMERIC"):
        digits = [int(n) for n in re.findall(r"\d+", inside)]
        return T.DecimalType(*(digits or [38, 10]))
    raise ValueError(f"unknown declared type '{declared}'")


def table_schema(dictionary: DataFrame, table: str) -> T.StructType:
    """Typed schema of a table, with flag, owner, retention and the like as field metadata.

    Collects the dictionary rows of one table, that is one row per column.
    """
    fields = []
    for row in schema_rows(dictionary, table).collect():
        fields.append(T.StructField(row.columna, spark_type(row.tipo_dato), True, {
            "declared": row.tipo_dato,
            "description": row.descripcion or "",
            "pii": row.es_pii == PERSONAL,
            "owner": row.data_owner or "",
            "retention_days": row.retencion_dias if row.retencion_dias is not None else -1,
            "classification": row.clasificacion or "",
            "constraint": row.constraint_tipo or "",
        }))
    return T.StructType(fields)


def apply_schema(df: DataFrame, schema: T.StructType, keep_dates_as_text: bool = True, rescue: bool = False) -> DataFrame:
    """Give text columns their declared types; text that does not fit becomes null.

    Dates stay text when they are typed later, at ingestion. ``rescue`` adds a map from column to the text
    that did not fit its type, or only by losing digits; null where all fits.
    """
    declared = {f.name: f for f in schema.fields}
    columns, lost = [], []
    for name in df.columns:
        field = declared.get(name)
        column = F.col(name)
        if field is None:
            columns.append(column)
            continue
        is_date = isinstance(field.dataType, (T.DateType, T.TimestampNTZType))
        if not isinstance(field.dataType, T.StringType) and not (is_date and keep_dates_as_text):
            column = lenient(column, field.dataType)
            if isinstance(df.schema[name].dataType, T.StringType):
                lost.append((name, column))
        columns.append(column.alias(name, metadata=field.metadata))
    if rescue:
        columns.append(_misfits(lost).alias(RESCUED))
    return df.select(*columns)


def _misfits(typed: list[tuple[str, Column]]) -> Column:
    """Map from column to text, for texts that are not their typed value."""
    entries = []
    for name, value in typed:
        text = F.col(name)
        exact = text.try_cast("decimal(38,18)")
        lossy = exact.isNotNull() & ~exact.eqNullSafe(value.try_cast("decimal(38,18)"))
        entries.append(F.when(text.isNotNull() & (value.isNull() | lossy), F.struct(F.lit(name).alias("key"), text.alias("value"))))
    if not entries:
        return F.lit(None).cast("map<string,string>")
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return F.when(F.size(found) > 0, F.map_from_entries(found))


def cast_failures(df: DataFrame, table: str) -> DataFrame:
    """(table, column, rows) of texts kept aside because they did not fit their type."""
    return df.select(F.explode(RESCUED).alias("column", "value")).groupBy("column").agg(
        F.count("*").alias("rows")).select(F.lit(table).alias("table"), "column", "rows")


def personal_columns(dictionary: DataFrame, table: str) -> list[str]:
    """Columns of a table the dictionary marks as personal."""
    return [r.columna for r in schema_rows(dictionary, table).filter(F.col("es_pii") == PERSONAL).collect()]


def describe(df: DataFrame, table: str) -> DataFrame:
    """(tabla, columna, tipo) of a built table, from its schema."""
    rows = [(table, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "tabla string, columna string, tipo string")


def schema_listing(dictionary: DataFrame, table: str, built: DataFrame | None = None) -> DataFrame:
    """(tabla, columna, tipo, descripcion, pii) of a table.

    A built aggregate table is described from its own schema, a source table from the dictionary.
    """
    if built is not None:
        return describe(built, table).withColumns(
            {"descripcion": F.lit(None).cast("string"), "pii": F.lit(False)})
    return schema_rows(dictionary, table).select(
        "tabla", "columna", F.col("tipo_dato").alias("tipo"), "descripcion",
        (F.col("es_pii") == PERSONAL).alias("pii"))
