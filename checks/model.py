"""The five retail tables, derived row by row from the driver's tables.

The driver's tables hold no nulls and few defects, so known defects are put in by arithmetic on
the keys. Each text below is plain SQL that Spark and DuckDB read alike, so both sides start from
the same rows; everything computed from them is written twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stratalake.plans.silver import clean

MODEL = {
    "clientes": """
        SELECT CASE WHEN c_custkey % 149 = 148 THEN c_custkey - 1 ELSE c_custkey END AS cliente_id,
               c_name AS nombre,
               CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 'Familia ' || CAST(c_custkey % 997 AS STRING) END AS apellido,
               CASE WHEN c_custkey % 20 = 0 THEN NULL
                    ELSE 'user.' || CAST(c_custkey AS STRING) || '@mail.example' END AS email,
               CASE WHEN c_custkey % 12 = 0 THEN 'N/A' WHEN c_custkey % 50 = 7 THEN '12'
                    WHEN c_custkey % 43 = 0 THEN NULL
                    ELSE '+57 300 ' || CAST(1000000 + c_custkey AS STRING) END AS telefono,
               CASE WHEN c_custkey % 33 = 0 THEN '  ' WHEN c_custkey % 34 = 0 THEN NULL
                    ELSE 'Ciudad ' || CAST(c_custkey % 40 AS STRING) END AS ciudad,
               n_name AS pais,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'B2B' WHEN 'HOUSEHOLD' THEN 'B2C'
                    WHEN 'FURNITURE' THEN 'Premium' WHEN 'BUILDING' THEN 'Inactivo' END AS segmento,
               DATE '2023-01-01' + CAST(c_custkey % 700 AS INT) AS fecha_registro,
               DATE '2023-01-01' + CAST(c_custkey % 700 + c_custkey % 5 AS INT) AS fecha_consentimiento,
               c_custkey % 7 <> 0 AS activo
        FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey""",
    "productos": """
        SELECT p_partkey AS producto_id,
               p_name AS nombre_producto,
               p_type AS categoria,
               p_brand AS subcategoria,
               CAST(p_retailprice AS DECIMAL(12,2)) AS precio_venta,
               CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * (50 + p_size) * 0.01, 2) AS DECIMAL(12,2)) AS costo,
               CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 21 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS stock_disponible
        FROM {part}""",
    "pedidos": """
        SELECT pedido_id, cliente_id, fecha_pedido,
               CASE WHEN estado IN ('entregado', 'devuelto') THEN fecha_pedido + CAST(o_orderkey % 16 - 1 AS INT) END
                   AS fecha_entrega,
               estado, canal, metodo_pago, pais_envio, total_bruto, descuento_pct,
               CAST(ROUND(total_bruto * (1 - descuento_pct), 2) AS DECIMAL(14,2))
                   + CAST(CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 0 END AS DECIMAL(14,2)) AS total_neto,
               o_orderkey AS _file_order
        FROM (
            SELECT o_orderkey,
                   CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey - 1 ELSE o_orderkey END AS pedido_id,
                   CASE WHEN o_orderkey % 211 = 0 THEN -1 - o_custkey WHEN o_orderkey % 997 = 0 THEN NULL
                        ELSE o_custkey END AS cliente_id,
                   CASE WHEN o_orderkey % 499 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha_pedido,
                   CASE WHEN o_orderkey % 307 = 0 THEN 'desconocido' WHEN o_orderkey % 311 = 0 THEN NULL
                        WHEN o_orderstatus = 'F' THEN 'entregado'
                        WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'cancelado'
                        WHEN o_orderstatus = 'P' THEN 'devuelto'
                        WHEN o_orderkey % 3 = 0 THEN 'pendiente' ELSE 'enviado' END AS estado,
                   o_orderpriority AS canal,
                   CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'tarjeta_credito' WHEN 1 THEN 'PSE' WHEN 2 THEN 'efectivo'
                        WHEN 3 THEN 'transferencia' ELSE 'credito_tienda' END AS metodo_pago,
                   CASE WHEN o_orderkey % 601 = 0 THEN NULL ELSE n_name END AS pais_envio,
                   CAST(o_totalprice AS DECIMAL(14,2)) AS total_bruto,
                   CAST((o_orderkey % 4) * 0.05 AS DECIMAL(5,2)) AS descuento_pct
            FROM {orders} LEFT JOIN {nation} ON o_custkey % 25 = n_nationkey
        ) AS o""",
    "detalle_pedidos": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS item_id,
               l_orderkey AS pedido_id,
               l_partkey AS producto_id,
               CAST(l_quantity AS INT) AS cantidad,
               CAST(l_discount AS DECIMAL(5,2)) AS descuento_pct,
               CAST(ROUND(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))), 2)
                   AS DECIMAL(14,2)) AS subtotal
        FROM {lineitem}""",
    "eventos": """
        SELECT CASE WHEN event_id % 173 = 172 THEN event_id - 1 ELSE event_id END AS evento_id,
               CASE WHEN event_id % 10 < 3 THEN NULL ELSE user_id END AS cliente_id,
               CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                    WHEN 'signup' THEN 'checkout' WHEN 'purchase' THEN 'purchase' ELSE 'search' END AS tipo_evento,
               ts AS timestamp,
               CASE WHEN event_type IN ('click', 'purchase')
                    THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS producto_id,
               CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS dispositivo,
               CASE WHEN event_type = 'error' OR event_id % 20 = 0 THEN NULL ELSE value END AS duracion_seg
        FROM {events}""",
}

DRIVER_TABLES = ("customer", "nation", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One retail table as it comes: repeated ids, gaps and bad values included."""
    text = MODEL[table]
    used = {name: load(spark, sf_dir, name) for name in DRIVER_TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: frame(spark, sf_dir, t) for t in MODEL}


class Silver(Mapping):
    """The tables gold reads, each cleaned when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.made:
            self.made[table] = clean(table, frame(self.spark, self.sf_dir, table))
        return self.made[table]

    def __iter__(self):
        return iter(MODEL)

    def __len__(self) -> int:
        return len(MODEL)


def ctes() -> str:
    """``WITH`` clause that defines the retail tables over the driver's tables."""
    parts = []
    for table, text in MODEL.items():
        for name in DRIVER_TABLES:
            text = text.replace("{" + name + "}", name)
        parts.append(f"{table} AS ({text})")
    return "WITH " + ",\n".join(parts)


def plain(df: DataFrame) -> DataFrame:
    """Only bigint, double, string and boolean columns, so that both engines compare alike."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(column.alias(field.name))
    return df.select(*columns)
