"""DuckDB SQL for the queries, written from the meaning of each operator."""

from __future__ import annotations

from checks.model import ctes
from checks.queries import COUNTRIES, PERIOD, RUN_TIME

BRONZE = ctes()

DAY = "strftime({0}, '%Y-%m-%d') AS {0}"
# They must equal the ones in stratalake/settings.py.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\b\d{3}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b|\b57\d{10}\b|\b\d{10,12}\b"
SAFE = ", ".join(f"'{box}@example.com'" for box in (
    "unknown", "crm", "marketing", "ventas", "catalogo", "analytics", "governance", "finanzas", "logistica",
    "compras", "legal"))


def _day(name: str) -> str:
    return DAY.format(name)


def _num(name: str) -> str:
    return f"CAST({name} AS DOUBLE) AS {name}"


ORDER_COLUMNS = ", ".join([
    "pedido_id", "cliente_id", _day("fecha_pedido"), _day("fecha_entrega"), "estado", "canal", "metodo_pago",
    "pais_envio", _num("total_bruto"), _num("descuento_pct"), _num("total_neto")])
CUSTOMER_COLUMNS = ", ".join([
    "cliente_id", "nombre", "apellido", "email", "telefono", "ciudad", "pais", "segmento", _day("fecha_registro"),
    _day("fecha_consentimiento"), "activo"])
PRODUCT_COLUMNS = ", ".join([
    "producto_id", "nombre_producto", "categoria", "subcategoria", _num("precio_venta"), _num("costo"),
    "stock_disponible"])
LINE_COLUMNS = ", ".join([
    "item_id", "pedido_id", "producto_id", "CAST(cantidad AS BIGINT) AS cantidad", _num("descuento_pct"),
    _num("subtotal")])
EVENT_COLUMNS = ("evento_id, cliente_id, tipo_evento, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, "
                 "producto_id, dispositivo")

HASHED = ("CASE WHEN {0} IS NULL OR regexp_full_match({0}, '\\s*') THEN {0} ELSE sha256({0}) END")
PHONE_TAIL = ("CASE WHEN telefono IS NULL THEN NULL WHEN length(regexp_replace(telefono, '\\D', '', 'g')) < 4 "
              "THEN '****' ELSE '****' || right(regexp_replace(telefono, '\\D', '', 'g'), 4) END")


def _money(name: str) -> str:
    return f"CAST(COALESCE(SUM({name}), 0) AS DOUBLE)"


def _mean(name: str) -> str:
    return f"CAST(SUM({name}) AS DOUBLE) / COUNT({name})"


def _half_up(top: str, bottom: str, digits: int) -> str:
    """top / bottom rounded half up, in whole numbers, so that ties come out exactly."""
    top, scale = f"CAST({top} AS HUGEINT)", 10 ** digits
    return f"CAST(sign({top}) * ((2 * abs({top}) * {scale} + ({bottom})) // (2 * ({bottom}))) AS DOUBLE) / {scale}"


def _rounded_mean(number: str, digits: int = 2) -> str:
    return _half_up(f"SUM(CAST({number} AS DECIMAL(18,4))) * 10000", f"10000 * COUNT({number})", digits)


def _value(name: str, dtype: str) -> str:
    return f"nullif(\"{name}\", 'NaN'::DOUBLE)" if dtype == "double" else f'"{name}"'


def _profile(start: str, table: str, columns: dict[str, str], source: str | None = None, whole: bool = False) -> str:
    """``columns``: name to Spark type; the type decides which figures apply. ``whole`` adds the table's figures."""
    parts = []
    for name, dtype in columns.items():
        value = _value(name, dtype)
        figures = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median"
        if dtype.startswith(("bigint", "int", "decimal", "double", "boolean")):
            number = f"CAST(CAST({value} AS INT) AS DOUBLE)" if dtype == "boolean" else f"CAST({value} AS DOUBLE)"
            figures = (f"MIN({number}) AS min, MAX({number}) AS max, {_rounded_mean(number)} AS mean, "
                       f"CAST(ROUND(MEDIAN(CAST({number} AS DECIMAL(18,4))), 2) AS DOUBLE) AS median")
        more = ""
        if whole:
            rows = ", ".join(f'"{c}"' for c in columns)
            more = (f", COUNT(*) AS total_rows, CAST({len(columns)} AS BIGINT) AS total_cols, "
                    f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {rows} FROM {source or table})) AS duplicated_rows")
        parts.append(
            f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", '{dtype}' AS dtype, COUNT(*) - COUNT({value}) AS nulls, "
            f"{_half_up(f'(COUNT(*) - COUNT({value})) * 100', 'COUNT(*)', 2)} AS null_pct, "
            f"COUNT(DISTINCT {value}) AS \"unique\", "
            f"{_half_up(f'COUNT(DISTINCT {value}) * 100', 'COUNT(*)', 2)} AS cardinality_pct, {figures}{more} "
            f"FROM {source or table}")
    return f"{start} " + " UNION ALL ".join(parts)


CUSTOMER_TYPES = {
    "cliente_id": "bigint", "nombre": "string", "apellido": "string", "email": "string", "telefono": "string",
    "ciudad": "string", "pais": "string", "segmento": "string", "fecha_registro": "date",
    "fecha_consentimiento": "date", "activo": "boolean"}
ORDER_TYPES = {
    "pedido_id": "bigint", "cliente_id": "bigint", "fecha_pedido": "date", "fecha_entrega": "date",
    "estado": "string", "canal": "string", "metodo_pago": "string", "pais_envio": "string",
    "total_bruto": "decimal(14,2)", "descuento_pct": "decimal(5,2)", "total_neto": "decimal(15,2)"}
EVENT_TYPES = {
    "evento_id": "bigint", "cliente_id": "bigint", "tipo_evento": "string", "timestamp": "timestamp_ntz",
    "producto_id": "bigint", "dispositivo": "string", "duracion_seg": "double"}
PRODUCT_TYPES = {
    "producto_id": "bigint", "nombre_producto": "string", "categoria": "string", "subcategoria": "string",
    "precio_venta": "decimal(12,2)", "costo": "decimal(12,2)", "stock_disponible": "double"}
LINE_TYPES = {
    "item_id": "string", "pedido_id": "bigint", "producto_id": "bigint", "cantidad": "int",
    "descuento_pct": "decimal(5,2)", "subtotal": "decimal(14,2)"}
COUNTRY_TYPES = {
    "pais_envio": "string", "total_pedidos": "bigint", "revenue_bruto": "double", "revenue_neto": "double", "ticket_promedio": "double"}
PERSONAL = ("nombre", "apellido", "email", "telefono", "fecha_consentimiento")
DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


TYPES = {"clientes": (CUSTOMER_TYPES, "cliente_id"), "productos": (PRODUCT_TYPES, "producto_id"), "pedidos": (ORDER_TYPES, "pedido_id"),
         "detalle_pedidos": (LINE_TYPES, "item_id"), "eventos": (EVENT_TYPES, "evento_id")}


def _hash(columns: dict[str, str]) -> str:
    # Spark writes NaN with capitals
    shown = {c: f"replace(CAST({c} AS VARCHAR), 'nan', 'NaN')" if t == "double" else f"CAST({c} AS VARCHAR)" for c, t in columns.items()}
    texts = ", ".join(f"COALESCE({v}, 'nan')" for v in shown.values())
    return f"substr(sha256(concat_ws('|', {texts})), 1, 16)"


# --- quality rules ---

RULE_TESTS = {
    "R001": ("clientes", "cliente_id IN (SELECT cliente_id FROM clientes GROUP BY ALL HAVING COUNT(*) > 1)"),
    "R002": ("pedidos", "pedido_id IN (SELECT pedido_id FROM pedidos GROUP BY ALL HAVING COUNT(*) > 1)"),
    "R003": ("clientes", "email IS NULL"),
    "R004": ("clientes", "telefono = 'N/A'"),
    "R005": ("clientes", "ciudad IS NULL OR trim(ciudad) = ''"),
    "R006": ("productos", "stock_disponible IS NULL OR isnan(CAST(stock_disponible AS DOUBLE))"),
    "R007": ("pedidos", "cliente_id IS NULL OR cliente_id NOT IN (SELECT cliente_id FROM clientes)"),
    "R008": ("productos", "precio_venta <= costo"),
    "R009": ("pedidos", "abs(total_neto - total_bruto * (1 - descuento_pct)) > 1.0"),
    "R010": ("pedidos", "fecha_entrega < fecha_pedido"),
    "R011": ("pedidos", "estado IS NULL OR estado NOT IN ('pendiente', 'enviado', 'entregado', 'cancelado', 'devuelto')"),
    "R012": ("eventos", "evento_id IN (SELECT evento_id FROM eventos GROUP BY ALL HAVING COUNT(*) > 1)"),
}
RULE_TEXTS = {
    "R001": ("customer key is unique", "error"), "R002": ("order key is unique", "error"),
    "R003": ("email is present", "warning"), "R004": ("phone is not the invalid marker", "warning"),
    "R005": ("city is not blank", "warning"), "R006": ("stock is present", "warning"),
    "R007": ("customer of the order exists", "error"), "R008": ("sale price is above cost", "warning"),
    "R009": ("net total agrees with gross and discount", "warning"),
    "R010": ("delivery is not before the order", "warning"), "R011": ("order state is a known one", "error"),
    "R012": ("event key is unique", "error"),
}
ROW_COLUMNS = {
    "clientes": CUSTOMER_COLUMNS, "productos": PRODUCT_COLUMNS, "pedidos": ORDER_COLUMNS + ", _file_order",
    "eventos": EVENT_COLUMNS + ", duracion_seg"}


def _report(extra: str = "", repaired: bool = False) -> str:
    """Report lines for all rules; ``repaired`` counts the rules on cleaned tables."""
    source = {t: t for t in ("clientes", "productos", "pedidos", "eventos")}
    parts = []
    for rule, (table, test) in RULE_TESTS.items():
        text, severity = RULE_TEXTS[rule]
        if repaired:
            test = test.replace("FROM pedidos", "FROM c_pedidos").replace("FROM clientes", "FROM c_clientes")
            source[table] = table if table == "eventos" else f"c_{table}"
        parts.append(
            f"SELECT '{rule}' AS rule_id, '{table}' AS \"table\", '{text}' AS description, '{severity}' AS severity, "
            f"COUNT(*) AS violations, COUNT(*) = 0 AS passed{extra} FROM {source[table]} WHERE {test}")
    return " UNION ALL ".join(parts)


CLEANED = f""",
c_clientes AS (
    SELECT cliente_id, {HASHED.format('nombre')} AS nombre, {HASHED.format('apellido')} AS apellido,
           CASE WHEN email IS NULL THEN 'unknown@example.com' ELSE sha256(email) END AS email,
           {PHONE_TAIL.replace('telefono', "nullif(telefono, 'N/A')")} AS telefono,
           CASE WHEN ciudad IS NULL OR trim(ciudad) = '' THEN 'Desconocida' ELSE ciudad END AS ciudad,
           pais, segmento, fecha_registro, fecha_consentimiento, activo
    FROM clientes),
c_productos AS (
    SELECT * REPLACE (CAST(COALESCE(nullif(stock_disponible, 'NaN'::DOUBLE), 0) AS BIGINT) AS stock_disponible) FROM productos),
c_pedidos AS (
    SELECT * EXCLUDE (place) FROM (
        SELECT *, row_number() OVER (PARTITION BY pedido_id ORDER BY _file_order) AS place FROM pedidos)
    WHERE place = 1)"""

FILL = """,
first_fill AS (
    SELECT * REPLACE (COALESCE(duracion_seg, MEDIAN(duracion_seg) OVER (PARTITION BY tipo_evento)) AS duracion_seg)
    FROM eventos),
filled AS (
    SELECT * REPLACE (COALESCE(duracion_seg, (SELECT MEDIAN(duracion_seg) FROM first_fill)) AS duracion_seg)
    FROM first_fill)"""
FILLED = BRONZE + FILL
CLEAN = "WITH " + ", ".join(f"{table} AS ({BRONZE}{CLEANED}{FILL} SELECT * FROM {made})" for table, made in (
    ("clientes", "c_clientes"), ("productos", "c_productos"), ("pedidos", "c_pedidos"), ("detalle_pedidos", "detalle_pedidos"),
    ("eventos", "filled")))

LOG = " UNION ALL ".join(
    f"SELECT '{table}' AS tabla, '{column}' AS campo, '{action}' AS accion, {count} AS registros_afectados, "
    f"'{RUN_TIME}' AS timestamp FROM {table}"
    for table, column, action, count in (
        ("clientes", "email", "null → ''unknown@example.com''", "COUNT(*) FILTER (email IS NULL)"),
        ("clientes", "telefono", "''N/A'' → null", "COUNT(*) FILTER (telefono = 'N/A')"),
        ("clientes", "ciudad", "vacío → ''Desconocida''", "COUNT(*) FILTER (ciudad IS NULL OR trim(ciudad) = '')"),
        ("productos", "stock_disponible", "null → 0", "COUNT(*) FILTER (stock_disponible IS NULL OR isnan(stock_disponible))"),
        ("pedidos", "pedido_id", "deduplicación (keep first)", "COUNT(*) - COUNT(DISTINCT pedido_id)"),
        ("eventos", "duracion_seg", "null → mediana por tipo_evento", "COUNT(*) FILTER (duracion_seg IS NULL)"),
    ))

# --- texts ---

TEXTS = """texts AS (
    SELECT doc_id AS id, text || CASE doc_id % 5
        WHEN 0 THEN ' cel 300 ' || lpad(CAST(doc_id AS VARCHAR), 7, '0')
        WHEN 1 THEN ' ref 300' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ' crm@example.com'
        WHEN 2 THEN ' 57300' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ' unknown@example.com'
        ELSE '' END AS body
    FROM documents)"""
TURNS = """texts AS (SELECT {'conv_id': conv_id, 'turn': turn, 'role': role} AS id,
    text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' cel 300 ' || lpad(CAST(conv_id AS VARCHAR), 7, '0')
        WHEN 1 THEN ' user.' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || '@mail.example' ELSE '' END AS body
    FROM conversations)"""
PAGES = "texts AS (SELECT page_id AS id, html AS body FROM pages)"


def _located(pattern: str, kind: str, keep: str) -> str:
    return f"""
    SELECT id, '{kind}' AS type, found[i] AS value,
           CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                + COALESCE(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS BIGINT) AS position
    FROM (SELECT id, found, gaps, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT id, regexp_extract_all(body, '{pattern}') AS found,
                       string_split_regex(body, '{pattern}') AS gaps FROM texts))
    WHERE {keep.format('found[i]')}"""


def _findings(texts: str, key: str) -> str:
    return (f"WITH {texts} SELECT id AS {key}, type, value, position FROM ("
            + _located(EMAIL, "email", "lower({0}) <> 'unknown@example.com'") + " UNION ALL "
            + _located(PHONE, "phone", "TRUE") + ")")


CUED = f"""cued AS (
    SELECT id, body,
           list_concat(
               list_transform(list_filter(regexp_extract_all(body, '{EMAIL}'), lambda v: lower(v) NOT IN ({SAFE})),
                              lambda v: {{'type': 'email', 'value': v}}),
               CASE WHEN regexp_matches(lower(body), 'telefono|phone|cel|móvil')
                    THEN list_transform(regexp_extract_all(body, '{PHONE}'), lambda v: {{'type': 'phone', 'value': v}})
                    ELSE [] END) AS found
    FROM texts)"""


def _findings_cued(texts: str, key: str) -> str:
    return (f"WITH {texts}, {CUED}, hits AS (SELECT id, unnest(found) AS hit FROM cued) "
            f"SELECT id AS {key}, hit.type AS type, hit.value AS value FROM hits")


def _redacted(texts: str, key: str, text: str) -> str:
    return (f"WITH {texts} SELECT id AS {key}, regexp_replace(regexp_replace(body, '{EMAIL}', '[EMAIL_REDACTED]', 'g'), "
            f"'{PHONE}', '[PHONE_REDACTED]', 'g') AS {text} FROM texts")


def _redacted_found(texts: str, key: str, text: str) -> str:
    return f"""WITH RECURSIVE {texts}, {CUED}, steps AS (
        SELECT id, body, found, 0 AS done FROM cued
        UNION ALL
        SELECT id, replace(body, found[done + 1].value,
                           CASE found[done + 1].type WHEN 'email' THEN '[EMAIL_REDACTED]' ELSE '[PHONE_REDACTED]' END),
               found, done + 1
        FROM steps WHERE done < len(found))
    SELECT id AS {key}, body AS {text}, len(found) > 0 AS pii_found FROM steps WHERE done = len(found)"""


# --- gold ---

GOLD = {
    "gold_ventas_por_pais": f"""SELECT pais_envio, COUNT(pedido_id) AS total_pedidos, {_money('total_bruto')} AS revenue_bruto,
        {_money('total_neto')} AS revenue_neto, {_mean('total_neto')} AS ticket_promedio
        FROM pedidos WHERE pais_envio IS NOT NULL GROUP BY pais_envio""",
    "gold_ventas_por_canal": f"""SELECT canal, COUNT(pedido_id) AS total_pedidos, {_money('total_neto')} AS revenue_neto,
        {_mean('descuento_pct')} AS descuento_promedio FROM pedidos WHERE canal IS NOT NULL GROUP BY canal""",
    "gold_ventas_mensuales": f"""SELECT strftime(fecha_pedido, '%Y-%m') AS mes, COUNT(pedido_id) AS total_pedidos,
        {_money('total_neto')} AS revenue_neto FROM pedidos WHERE fecha_pedido IS NOT NULL GROUP BY 1""",
    "gold_top_productos": f"""SELECT d.producto_id, nombre_producto, categoria, subcategoria,
        CAST(SUM(cantidad) AS BIGINT) AS unidades_vendidas, {_money('subtotal')} AS revenue
        FROM detalle_pedidos d JOIN productos p ON d.producto_id = p.producto_id
        WHERE nombre_producto IS NOT NULL AND categoria IS NOT NULL AND subcategoria IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "gold_segmento_clientes": f"""SELECT segmento, COUNT(DISTINCT p.cliente_id) AS total_clientes,
        COUNT(pedido_id) AS total_pedidos, {_money('total_neto')} AS revenue_neto, {_mean('total_neto')} AS ticket_promedio
        FROM pedidos p LEFT JOIN clientes c ON p.cliente_id = c.cliente_id WHERE segmento IS NOT NULL GROUP BY segmento""",
    "gold_conversion_funnel": f"""SELECT tipo_evento, total_eventos,
        COALESCE({_half_up('total_eventos - previous', 'previous', 4)}, 0) AS conversion_rate
        FROM (SELECT *, lag(total_eventos) OVER (ORDER BY step) AS previous FROM (SELECT tipo_evento, COUNT(evento_id) AS total_eventos,
                     list_position(['page_view', 'product_view', 'add_to_cart', 'checkout', 'purchase'], tipo_evento) AS step
              FROM eventos WHERE tipo_evento IN ('page_view', 'product_view', 'add_to_cart', 'checkout', 'purchase')
              GROUP BY tipo_evento))""",
    "gold_clientes_rfm": """SELECT cliente_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
        6 - fr AS recency_score, ff AS frequency_score, fm AS monetary_score,
        CAST(6 - fr AS VARCHAR) || CAST(ff AS VARCHAR) || CAST(fm AS VARCHAR) AS rfm_score
        FROM (SELECT *,
                  greatest(1, (5 * (row_number() OVER (ORDER BY recency, cliente_id) - 1) + n - 2) // (n - 1)) AS fr,
                  greatest(1, (5 * (row_number() OVER (ORDER BY frequency, cliente_id) - 1) + n - 2) // (n - 1)) AS ff,
                  greatest(1, (5 * (row_number() OVER (ORDER BY monetary, cliente_id) - 1) + n - 2) // (n - 1)) AS fm
              FROM (SELECT cliente_id, COUNT(*) OVER () AS n,
                           date_diff('day', MAX(fecha_pedido), (SELECT MAX(fecha_pedido) + 1 FROM pedidos)) AS recency,
                           COUNT(pedido_id) AS frequency, SUM(total_neto) AS monetary
                    FROM pedidos WHERE cliente_id IS NOT NULL GROUP BY cliente_id))""",
    "gold_resumen_calidad": " UNION ALL ".join(
        f"""SELECT '{table}' AS tabla, total_filas, CAST({len(types)} AS BIGINT) AS total_columnas, CAST(total_nulos AS BIGINT) AS total_nulos,
        {_half_up(f'(total_filas * {len(types)} - total_nulos) * 100', f'total_filas * {len(types)}', 2)} AS pct_completitud
        FROM (SELECT COUNT(*) AS total_filas, {' + '.join(f'(COUNT(*) - COUNT({c}))' for c in types)} AS total_nulos FROM {table})"""
        for table, types in (("clientes", CUSTOMER_TYPES), ("productos", PRODUCT_TYPES), ("pedidos", ORDER_TYPES),
                             ("detalle_pedidos", LINE_TYPES), ("eventos", EVENT_TYPES))),
}


def _from_gold(name: str, rest: str) -> str:
    return f"{CLEAN}, {name} AS ({GOLD[name]}) {rest}"


def _counts(table: str, column: str) -> str:
    return (f"SELECT '{column}' AS \"column\", {column} AS value, COUNT(*) AS rows FROM {table} "
            f"WHERE {column} IS NOT NULL GROUP BY {column}")


def _nulls(table: str, columns: dict[str, str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls, "
        f"{_half_up(f'(COUNT(*) - COUNT({c})) * 100', 'COUNT(*)', 1)} AS null_share FROM {table}"
        for c in columns) + ") WHERE nulls > 0"


ORACLE: dict[str, str] = {
    "layer_round_trip": f"{CLEAN} SELECT {ORDER_COLUMNS} FROM pedidos",
    "csv_round_trip": f"""{BRONZE} SELECT {CUSTOMER_COLUMNS} FROM (SELECT * REPLACE (CASE cliente_id % 4
        WHEN 0 THEN '"' || ciudad || '", he said' WHEN 1 THEN 'a\\' || ciudad || '\\"' WHEN 2 THEN ciudad || chr(10) || '  two, lines'
        ELSE ciudad END AS ciudad) FROM clientes)""",

    "bronze_ingest": f"{BRONZE} " + " UNION ALL ".join(
        f"SELECT CAST({key} AS VARCHAR) AS key, '{t}.csv' AS _source_file, '{RUN_TIME}' AS _ingestion_timestamp, {_hash(c)} AS _row_hash FROM {t}"
        for t, (c, key) in TYPES.items()),
    "row_hash": f"{BRONZE} SELECT item_id, {_hash(LINE_TYPES)} AS _row_hash FROM detalle_pedidos",
    "lenient_dates": """SELECT event_id, strftime(TRY_CAST(bad AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS fecha_evento,
        strftime(TRY_CAST(bad AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS timestamp
        FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '31/12/2024 noon' ELSE CAST(ts AS VARCHAR) END AS bad FROM events)""",
    "bronze_null_problems": 'SELECT "table", "column", nulls, null_pct FROM (' + BRONZE + " " + " UNION ALL ".join(
        _profile("", t, c) for t, (c, _) in TYPES.items()) + ") WHERE nulls > 0",
    "cast_failures": """SELECT 'productos' AS "table", 'precio_venta' AS "column", COUNT(*) FILTER (p_partkey % 10 < 2) AS rows FROM part
        UNION ALL SELECT 'productos', 'stock', COUNT(*) FILTER (p_partkey % 7 = 0) FROM part""",

    "profile_clientes": _profile(BRONZE, "clientes", CUSTOMER_TYPES),
    "profile_productos": _profile(BRONZE, "productos", PRODUCT_TYPES),
    "profile_pedidos": _profile(BRONZE, "pedidos", ORDER_TYPES),
    "profile_detalle_pedidos": _profile(BRONZE, "detalle_pedidos", LINE_TYPES),
    "profile_tables": f"{BRONZE} " + " UNION ALL ".join(_profile("", t, c, whole=True) for t, (c, _) in TYPES.items()),
    "profile_eventos": _profile(BRONZE, "eventos", EVENT_TYPES),
    "profile_documents": _profile("", "documents", DOCUMENT_TYPES),
    "duplicated_documents": """SELECT 'documents' AS "table", COUNT(*) AS total_rows, CAST(5 AS BIGINT) AS total_cols,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicated_rows
        FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 10 = 0)""",
    "duplicated_lines": f"""{BRONZE} SELECT 'detalle_pedidos' AS "table", COUNT(*) AS total_rows, CAST(6 AS BIGINT) AS total_cols,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM detalle_pedidos)) AS duplicated_rows
        FROM (SELECT * FROM detalle_pedidos UNION ALL SELECT * FROM detalle_pedidos WHERE pedido_id % 9 = 0)""",
    "duplicate_keys": f"""{BRONZE} SELECT {LINE_COLUMNS} FROM detalle_pedidos
        WHERE item_id IN (SELECT item_id FROM detalle_pedidos GROUP BY item_id HAVING COUNT(*) > 1)""",

    **{f"rule_{rule.lower()}": f"{BRONZE} SELECT {ROW_COLUMNS[table]} FROM {table} WHERE {test}"
       for rule, (table, test) in RULE_TESTS.items()},
    "rule_report": f"{BRONZE} {_report()}",
    "rule_phases": f"{BRONZE}{CLEANED} {_report(chr(44) + chr(32) + repr('before') + ' AS phase')} UNION ALL "
                   f"{_report(chr(44) + chr(32) + repr('after') + ' AS phase', repaired=True)}",

    "fill_null_email": f"{BRONZE} SELECT cliente_id, COALESCE(email, 'unknown@example.com') AS email FROM clientes",
    "nullify_phone": f"{BRONZE} SELECT cliente_id, nullif(telefono, 'N/A') AS telefono FROM clientes",
    "fill_blank_city": f"""{BRONZE} SELECT cliente_id,
        CASE WHEN ciudad IS NULL OR trim(ciudad) = '' THEN 'Desconocida' ELSE ciudad END AS ciudad FROM clientes""",
    "fill_null_stock": f"{BRONZE} SELECT producto_id, CAST(COALESCE(nullif(stock_disponible, 'NaN'::DOUBLE), 0) AS BIGINT) AS stock_disponible FROM productos",
    "dedup_orders": f"{BRONZE}{CLEANED} SELECT {ORDER_COLUMNS}, _file_order FROM c_pedidos",
    "dedup_lines": """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
                  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS place FROM lineitem)
        WHERE place = 1""",
    "fill_group_median": f"{FILLED} SELECT evento_id, tipo_evento, duracion_seg FROM filled",
    "group_medians": "SELECT l_suppkey, MEDIAN(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey",
    "transformation_log": f"{BRONZE} {LOG}",

    "mask_hash": f"{BRONZE} SELECT cliente_id, {HASHED.format('ciudad')} AS ciudad FROM clientes",
    "mask_email": f"""{BRONZE} SELECT cliente_id,
        CASE WHEN email IS NULL THEN 'unknown@example.com' ELSE sha256(email) END AS email FROM clientes""",
    "mask_name": f"{BRONZE} SELECT cliente_id, sha256(apellido) AS apellido FROM clientes",
    "mask_phone_tail": f"{BRONZE} SELECT cliente_id, {PHONE_TAIL} AS telefono FROM clientes",
    "mask_customers": f"""{BRONZE} SELECT cliente_id, sha256(nombre) AS nombre, sha256(apellido) AS apellido,
        sha256(email) AS email, {PHONE_TAIL} AS telefono, ciudad, pais, segmento, {_day('fecha_registro')},
        {_day('fecha_consentimiento')}, activo FROM clientes""",

    "pii_findings_documents": _findings(TEXTS, "doc_id"),
    "pii_findings_pages": _findings(PAGES, "page_id"),
    "pii_findings_cued_documents": _findings_cued(TEXTS, "doc_id"),
    "pii_findings_cued_pages": _findings_cued(PAGES, "page_id"),
    "redact_documents": _redacted(TEXTS, "doc_id", "text"),
    "redact_pages": _redacted(PAGES, "page_id", "html"),
    "redact_output_documents": _redacted_found(TEXTS, "doc_id", "text"),
    "pii_findings_conversations": f"SELECT key.conv_id AS conv_id, key.turn AS turn, type, value, position FROM ({_findings(TURNS, 'key')})",
    "redact_output_conversations": f"""SELECT key.conv_id AS conv_id, key.turn AS turn, key.role AS role, text, pii_found
        FROM ({_redacted_found(TURNS, 'key', 'text')})""",
    "redact_output_pages": _redacted_found(PAGES, "page_id", "html"),

    "silver_clientes": f"{BRONZE}{CLEANED} SELECT {CUSTOMER_COLUMNS} FROM c_clientes",
    "silver_productos": f"{BRONZE}{CLEANED} SELECT {PRODUCT_COLUMNS} FROM c_productos",
    "silver_pedidos": f"{BRONZE}{CLEANED} SELECT {ORDER_COLUMNS} FROM c_pedidos",
    "silver_detalle_pedidos": f"{BRONZE} SELECT {LINE_COLUMNS} FROM detalle_pedidos",
    "silver_eventos": f"{FILLED} SELECT {EVENT_COLUMNS}, duracion_seg FROM filled",

    **{name: f"{CLEAN} {text}" for name, text in GOLD.items()},
    "gold_inventory": f"{CLEAN} " + " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", COUNT(*) AS total_rows, CAST({columns} AS BIGINT) AS total_cols FROM ({GOLD[name]})"
        for name, columns in zip(GOLD, (5, 4, 3, 6, 5, 3, 8, 5))),
    "country_sales_from_bronze": f"{BRONZE}{CLEANED} " + GOLD["gold_ventas_por_pais"].replace("FROM pedidos", "FROM c_pedidos"),

    "q01_top_productos_ingreso": _from_gold("gold_top_productos", """SELECT producto_id, nombre_producto, categoria,
        unidades_vendidas, ROUND(revenue, 2) AS revenue FROM gold_top_productos ORDER BY revenue DESC, producto_id LIMIT 10"""),
    "q02_ventas_por_pais": f"""{CLEAN} SELECT pais_envio AS pais, COUNT(pedido_id) AS total_pedidos,
        ROUND({_money('total_neto')}, 2) AS revenue_neto, {_rounded_mean('total_neto')} AS ticket_promedio
        FROM pedidos WHERE pais_envio IS NOT NULL GROUP BY pais_envio""",
    "q03_conversion_por_canal": f"""{CLEAN} SELECT canal, COUNT(pedido_id) AS total_pedidos,
        ROUND({_money('total_neto')}, 2) AS revenue_neto,
        {_half_up('SUM(total_neto) * 100', '100 * COUNT(pedido_id)', 2)} AS revenue_por_pedido
        FROM pedidos WHERE canal IS NOT NULL GROUP BY canal""",
    "q04_clientes_b2b_grandes": f"""{CLEAN} SELECT p.cliente_id, segmento, COUNT(pedido_id) AS total_pedidos,
        ROUND({_money('total_neto')}, 2) AS total_compras FROM pedidos p JOIN clientes c ON p.cliente_id = c.cliente_id
        WHERE segmento = 'B2B' GROUP BY p.cliente_id, segmento HAVING SUM(total_neto) > 500000""",
    "q05_comparativa_paises": f"""{CLEAN} SELECT pais_envio AS pais, COUNT(*) AS total_pedidos,
        ROUND({_money('total_neto')}, 2) AS revenue_neto, {_rounded_mean('total_neto')} AS ticket_promedio,
        {_rounded_mean('(descuento_pct * 100)')} AS descuento_prom_pct
        FROM pedidos WHERE pais_envio IN ('{COUNTRIES[0]}', '{COUNTRIES[1]}') GROUP BY pais_envio""",
    "q06_top5_productos_periodo": f"""{CLEAN} SELECT d.producto_id, nombre_producto, categoria,
        CAST(SUM(cantidad) AS BIGINT) AS unidades, ROUND({_money('subtotal')}, 2) AS revenue
        FROM detalle_pedidos d JOIN pedidos p ON d.pedido_id = p.pedido_id JOIN productos r ON d.producto_id = r.producto_id
        WHERE fecha_pedido BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'
        GROUP BY 1, 2, 3 ORDER BY revenue DESC, d.producto_id LIMIT 5""",
    "q07_metodo_pago_por_pais": f"""{CLEAN} SELECT pais_envio AS pais, metodo_pago, COUNT(*) AS total_pedidos,
        ROUND({_money('total_neto')}, 2) AS revenue_neto FROM pedidos GROUP BY pais_envio, metodo_pago""",
    "q08_tasa_cancelacion_devolucion": f"""{CLEAN} SELECT estado, COUNT(*) AS total,
        {_half_up('COUNT(*) * 100', '(SELECT COUNT(*) FROM pedidos)', 2)} AS porcentaje
        FROM pedidos WHERE estado IN ('cancelado', 'devuelto') GROUP BY estado""",
    "q09_margen_bruto_categoria": f"""{CLEAN} SELECT categoria,
        ROUND(AVG((CAST(precio_venta AS DOUBLE) - CAST(costo AS DOUBLE)) / CAST(precio_venta AS DOUBLE) * 100), 2) AS margen_bruto_pct,
        ROUND({_money('subtotal')}, 2) AS revenue_total, CAST(SUM(cantidad) AS BIGINT) AS unidades_vendidas
        FROM detalle_pedidos d JOIN productos p ON d.producto_id = p.producto_id GROUP BY categoria""",
    "q10_actividad_horaria": f"""{CLEAN} SELECT EXTRACT(HOUR FROM timestamp) AS hora, tipo_evento, COUNT(*) AS total_eventos
        FROM eventos GROUP BY 1, 2""",
    "q11_segmentacion_rfm": _from_gold("gold_clientes_rfm", f"""SELECT rfm_score, COUNT(*) AS total_clientes,
        {_rounded_mean('recency', 1)} AS recency_promedio, {_rounded_mean('frequency', 1)} AS frequency_promedio,
        {_rounded_mean('monetary')} AS monetary_promedio
        FROM gold_clientes_rfm GROUP BY rfm_score ORDER BY total_clientes DESC, rfm_score LIMIT 20"""),
    "q12_cohorte_retencion_mensual": f"""{CLEAN},
        first_month AS (SELECT cliente_id, CAST(date_trunc('month', MIN(fecha_pedido)) AS DATE) AS cohorte FROM pedidos GROUP BY cliente_id),
        months AS (SELECT DISTINCT cliente_id, CAST(date_trunc('month', fecha_pedido) AS DATE) AS mes FROM pedidos)
        SELECT {_day('cohorte')}, date_diff('month', cohorte, mes) AS meses_desde_cohorte,
               COUNT(DISTINCT m.cliente_id) AS clientes_activos
        FROM first_month f JOIN months m ON f.cliente_id = m.cliente_id
        WHERE date_diff('month', cohorte, mes) >= 0 GROUP BY 1, 2""",
    "paises_por_ingreso": _from_gold("gold_ventas_por_pais", """SELECT pais_envio, total_pedidos,
        ROUND(revenue_neto, 0) AS revenue_neto FROM gold_ventas_por_pais"""),
    "productos_mas_vendidos": _from_gold("gold_top_productos", """SELECT nombre_producto, categoria, unidades_vendidas,
        ROUND(revenue, 0) AS revenue FROM (SELECT * FROM gold_top_productos ORDER BY revenue DESC, producto_id LIMIT 10)"""),
    "ticket_promedio_por_canal": f"""{CLEAN} SELECT canal,
        {_half_up('SUM(total_neto) * 100', '100 * COUNT(pedido_id)', 0)} AS ticket_promedio
        FROM pedidos WHERE canal IS NOT NULL GROUP BY canal""",
    "metodo_pago_en_pais": f"""{CLEAN} SELECT metodo_pago, COUNT(*) AS total_pedidos FROM pedidos
        WHERE pais_envio = '{COUNTRIES[0]}' GROUP BY metodo_pago""",
    "clientes_por_segmento": f"""{CLEAN} SELECT segmento, COUNT(*) AS total_clientes FROM clientes
        WHERE segmento IS NOT NULL GROUP BY segmento""",

    "governed_customers": f"""{BRONZE}{CLEANED} SELECT cliente_id, ciudad, pais, segmento, {_day('fecha_registro')}, activo,
        CAST(NULL AS VARCHAR) AS contacto FROM c_clientes""",
    "governed_totals": f"""{CLEAN}, per AS (
            SELECT cliente_id, COUNT(*) AS pedidos, CAST(SUM(total_neto) AS DOUBLE) AS neto FROM pedidos GROUP BY cliente_id)
        SELECT c.cliente_id, segmento, per.pedidos, neto FROM per JOIN clientes c ON c.cliente_id = per.cliente_id""",
    "violations": f"{BRONZE} " + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, '{table}' AS \"table\", CAST({TYPES[table][1]} AS VARCHAR) AS key, COUNT(*) AS rows FROM {table} WHERE {test} GROUP BY ALL"
        for rule, (table, test) in RULE_TESTS.items()),
    "sketched_profile": f"""{BRONZE}
        SELECT "table", "column", total_rows AS n, nulls, null_pct, min, max, TRUE AS unique_near, TRUE AS median_near
        FROM ({" UNION ALL ".join(_profile("", t, c, whole=True) for t, (c, _) in TYPES.items() if t in ("pedidos", "productos"))})""",
    "catalog_table": f"""{BRONZE} SELECT categoria, COUNT(*) AS n, ROUND(CAST(SUM(precio_venta) AS DOUBLE), 2) AS total FROM productos GROUP BY categoria""",
    "catalog_columns": "SELECT unnest([" + ", ".join(
        f"{{'column_name': '{c}', 'column_type': '{'double' if t.startswith('decimal') else 'string' if t == 'date' else t}'}}"
        for c, t in [*ORDER_TYPES.items(), ("_file_order", "bigint")]) + "], recursive := true)",
    "catalog_names": f"{BRONZE} " + " UNION ALL ".join(f"SELECT 'checks_view_{t}' AS name, COUNT(*) AS total_rows FROM {t}" for t in TYPES),
    "governed_schema": "SELECT unnest([" + ", ".join(
        [f"{{'tabla': 'clientes', 'columna': '{c}', 'tipo': '{t}', 'pii': {c in PERSONAL}}}" for c, t in CUSTOMER_TYPES.items()]
        + [f"{{'tabla': 'gold_ventas_por_pais', 'columna': '{c}', 'tipo': '{t}', 'pii': false}}" for c, t in COUNTRY_TYPES.items()]) + "], recursive := true)",
    "sql_reports": f"""{CLEAN}
        SELECT 'por_canal' AS name, COUNT(DISTINCT canal) AS rows, FALSE AS failed FROM pedidos WHERE total_neto >= 0 AND total_neto <= 1000000
        UNION ALL SELECT 'todos', COUNT(*), FALSE FROM pedidos
        UNION ALL SELECT 'roto', NULL, TRUE UNION ALL SELECT 'borra', NULL, TRUE""",
    "governed_windows": f"""{CLEAN}
        SELECT p.pedido_id, c.segmento, ROW_NUMBER() OVER w AS turno, CAST(SUM(p.total_neto) OVER w AS DOUBLE) AS acumulado
        FROM pedidos p JOIN clientes c ON c.cliente_id = p.cliente_id
        WHERE p.total_neto >= 1000 AND p.total_neto <= (SELECT AVG(total_neto) FROM pedidos) AND p.canal IN ('1-URGENT', '2-HIGH', '5-LOW')
        WINDOW w AS (PARTITION BY p.cliente_id ORDER BY p.fecha_pedido NULLS FIRST, p.pedido_id, c.segmento NULLS FIRST)""",
    "quality_digest": f"""{BRONZE}
        SELECT 'rule' AS source, "table", rule_id AS item, violations AS value FROM ({_report()})
        UNION ALL SELECT 'nulls', "table", "column", nulls FROM ({" UNION ALL ".join(_profile('', t, c) for t, (c, _) in TYPES.items())})
        UNION ALL SELECT 'repair', tabla, campo, registros_afectados FROM ({LOG})""",
    "pipeline_from_raw": f"""WITH s AS ({CLEAN} SELECT pais_envio, SUM(total_neto) AS v FROM pedidos WHERE pais_envio IS NOT NULL GROUP BY 1),
        r AS ({BRONZE}{CLEANED} {_report(chr(44) + chr(32) + repr('before') + ' AS phase')} UNION ALL
              {_report(chr(44) + chr(32) + repr('after') + ' AS phase', repaired=True)})
        SELECT 'sales' AS kind, pais_envio AS item, ROUND(CAST(v AS DOUBLE), 2) AS value FROM s
        UNION ALL SELECT phase, rule_id, CAST(violations AS DOUBLE) FROM r""",

    "null_columns": f"{CLEAN} {_nulls('pedidos', ORDER_TYPES)}",
    "marker_counts": f"""{BRONZE} SELECT COUNT(*) FILTER (telefono = 'N/A') AS telefono_marker,
        COUNT(*) FILTER (ciudad IS NULL OR trim(ciudad) = '') AS ciudad_blank FROM clientes""",
    "value_counts": f"{CLEAN} " + " UNION ALL ".join(_counts("pedidos", c) for c in ("estado", "canal", "pais_envio")),
    "value_counts_events": f"{BRONZE} " + " UNION ALL ".join(_counts("eventos", c) for c in ("tipo_evento", "dispositivo")),
    "numeric_summary": f"""{BRONZE} SELECT CAST(MIN(precio_venta) AS DOUBLE) AS min, CAST(MAX(precio_venta) AS DOUBLE) AS max,
        {_mean('precio_venta')} AS mean FROM productos""",
    "numeric_summary_scales": " UNION ALL ".join(
        f"""SELECT '{name}' AS scale, ROUND(MIN(p_retailprice * 1e{power}) * 1e{-power}, 4) AS min,
        ROUND(MAX(p_retailprice * 1e{power}) * 1e{-power}, 4) AS max, ROUND(AVG(p_retailprice * 1e{power}) * 1e{-power}, 4) AS mean FROM part"""
        for name, power in (("tiny", -15), ("plain", 0), ("huge", 25))),
    "predicate_count": f"{BRONZE} SELECT COUNT(*) AS rows FROM productos WHERE precio_venta <= costo",
    "repeated_keys": f"{BRONZE} SELECT COUNT(*) - COUNT(DISTINCT pedido_id) AS rows FROM pedidos",
    "fk_orphans": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority
        FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "distinct_references": f"""{BRONZE} SELECT 'producto_id' AS "column", COUNT(DISTINCT producto_id) AS "distinct" FROM detalle_pedidos
        UNION ALL SELECT 'pedido_id', COUNT(DISTINCT pedido_id) FROM detalle_pedidos""",
    "histogram": """WITH edge AS (SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders),
        counted AS (SELECT least(CAST(floor((o_totalprice - low) * 20 / (high - low)) AS BIGINT), 19) AS bin, COUNT(*) AS n
                    FROM orders, edge GROUP BY 1)
        SELECT b.bin, low + b.bin * (high - low) / 20 AS "from", low + (b.bin + 1) * (high - low) / 20 AS "to",
               COALESCE(n, 0) AS rows
        FROM range(20) AS b(bin) CROSS JOIN edge LEFT JOIN counted ON counted.bin = b.bin""",
    "category_share": f"""{BRONZE} SELECT dispositivo, COUNT(*) AS rows,
        {_half_up('COUNT(*) * 100', '(SELECT COUNT(dispositivo) FROM eventos)', 1)} AS share_pct
        FROM eventos WHERE dispositivo IS NOT NULL GROUP BY dispositivo""",
    "table_shapes": f"{BRONZE} " + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", COUNT(*) AS total_rows, CAST({n} AS BIGINT) AS total_cols FROM {t}"
        for t, n in (("clientes", 11), ("productos", 7), ("pedidos", 12), ("detalle_pedidos", 6), ("eventos", 7))),
}
