"""Every operator as a query over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks.model import Silver, bronze, frame, load, plain
from stratalake.functions.digests import row_hash, sha256
from stratalake.functions.personal import mask_email, mask_name, mask_phone
from stratalake.operators import explore, masking, profiling, repair, rules, sketches as sketch, textscan
from stratalake.operators.ingest import ingest, with_lenient_dates
from stratalake.operators.ordering import group_medians
from stratalake.operators.rules import RULES, violating_rows
from stratalake.plans import access, gold, reports
from stratalake.plans.silver import clean, transformation_log
from stratalake.plans.run import run
from stratalake.session import pin, shared_dir, shuffles_freed
from stratalake.settings import AUDIT_COLUMNS, DEFAULT_SITE, INVALID_PHONE, PII_COLUMNS, UNKNOWN_CITY
from stratalake.sources import catalog
from stratalake.sources.dictionary import DICTIONARY_SCHEMA, apply_schema, cast_failures as dictionary_failures
from stratalake.sources.layers import GOLD, RAW, REPORTS, SILVER, Lake, read_csv, write_csv

Query = Callable[[SparkSession, str], DataFrame]

RUN_TIME = "2024-01-01T00:00:00"
COUNTRIES = ("NATION_1", "NATION_2")
PERIOD = ("2000-07-01", "2000-12-31")


def _work_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stratalake-checks/{uuid.uuid4().hex}"


# --- sources and sinks ---

def layer_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    lake = Lake(spark, _work_path(spark))
    return plain(lake.write(Silver(spark, sf)["pedidos"], SILVER, "pedidos"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.expr("""CASE cliente_id % 4 WHEN 0 THEN '"' || ciudad || '", he said' WHEN 1 THEN 'a\\\\' || ciudad || '\\\\"'
        WHEN 2 THEN ciudad || chr(10) || '  two, lines' ELSE ciudad END""")
    customers = frame(spark, sf, "clientes").withColumn("ciudad", odd)
    path = _work_path(spark)
    write_csv(customers, path)
    typed = with_lenient_dates(apply_schema(read_csv(spark, path, multi_line=True), customers.schema))
    return plain(typed.withColumns({c: F.col(c).cast("date") for c in ("fecha_registro", "fecha_consentimiento")}))


# --- bronze ---

def _keyed(frames: dict[str, DataFrame]):
    """(table, its key column, rows without the file order) of the five tables."""
    keys = {"clientes": "cliente_id", "productos": "producto_id", "pedidos": "pedido_id", "detalle_pedidos": "item_id", "eventos": "evento_id"}
    return [(t, keys[t], df.drop("_file_order")) for t, df in frames.items()]


def bronze_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        ingest(df, f"{t}.csv", RUN_TIME).select(F.col(key).cast("string").alias("key"), *AUDIT_COLUMNS)
        for t, key, df in _keyed(bronze(spark, sf))])


def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    lines = frame(spark, sf, "detalle_pedidos")
    return lines.select("item_id", row_hash(lines.columns).alias("_row_hash"))


def lenient_dates(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 7 == 0, F.lit("31/12/2024 noon")).otherwise(F.col("ts").cast("string"))
    texts = load(spark, sf, "events").select("event_id", bad.alias("fecha_evento"), bad.alias("timestamp"))
    return plain(with_lenient_dates(texts))


def bronze_null_problems(spark: SparkSession, sf: str) -> DataFrame:
    counts = reduce(DataFrame.unionByName, [
        profiling.null_counts(ingest(df, f"{t}.csv", RUN_TIME), t) for t, _, df in _keyed(bronze(spark, sf))])
    return profiling.null_problems(counts, AUDIT_COLUMNS)


def cast_failures(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    texts = load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("producto_id"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit("1,234.50")).when(F.col("p_partkey") % 10 == 1, F.concat(price, F.lit("7")))
        .when(F.col("p_partkey") % 10 == 2, F.lit(None)).otherwise(price).alias("precio_venta"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("47.9")).otherwise(F.col("p_size").cast("string")).alias("stock"))
    typed = apply_schema(texts, T.StructType.fromDDL("producto_id bigint, precio_venta decimal(12,2), stock int"), rescue=True)
    return dictionary_failures(typed, "productos")


# --- profile ---

def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.profile(load(spark, sf, "documents"), "documents")


def duplicated_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return profiling.duplicated_rows(docs.unionByName(docs.where("doc_id % 10 = 0")), "documents")


def duplicated_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = frame(spark, sf, "detalle_pedidos")
    return profiling.duplicated_rows(lines.unionByName(lines.where("pedido_id % 9 = 0")), "detalle_pedidos")


def profile_tables(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [profiling.table_profile(df, t) for t, _, df in _keyed(bronze(spark, sf))])


# --- text ---

def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, every other one with a number or an address of its own at the end."""
    number = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    tail = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" cel 300 "), number))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" ref 300"), number, F.lit(" crm@example.com")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit(" 57300"), number, F.lit(" unknown@example.com")))
        .otherwise(F.lit(""))
    )
    return load(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations, half of the turns with a number or an address of their own at the end."""
    number = F.lpad(F.col("conv_id").cast("string"), 7, "0")
    place = F.col("conv_id") + F.col("turn")
    tail = (
        F.when(place % 4 == 0, F.concat(F.lit(" cel 300 "), number))
        .when(place % 4 == 1, F.concat(F.lit(" user."), number, F.lit("@mail.example")))
        .otherwise(F.lit("")))
    return load(spark, sf, "conversations").withColumn("text", F.concat("text", tail))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", "html")


# --- access ---

def governed_customers(spark: SparkSession, sf: str) -> DataFrame:
    customers = clean("clientes", frame(spark, sf, "clientes"))
    answer = access.GovernedSql(spark, {"clientes": customers}).query(
        "SELECT *, email AS contacto FROM clientes WHERE ciudad <> 'drop' ORDER BY cliente_id DESC")
    return plain(answer.result)


def governed_totals(spark: SparkSession, sf: str) -> DataFrame:
    governed = access.GovernedSql(spark, dict(pedidos=(t := Silver(spark, sf))["pedidos"], clientes=t["clientes"]))
    answer = governed.query("""
        WITH por_cliente AS (
            SELECT cliente_id, count(*) AS pedidos, sum(total_neto) AS neto FROM pedidos GROUP BY cliente_id)
        SELECT c.cliente_id, c.segmento, p.pedidos, p.neto
        FROM por_cliente p JOIN clientes c ON c.cliente_id = p.cliente_id
        ORDER BY neto DESC, cliente_id""")
    return plain(answer.result)


def governed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Named windows, BETWEEN, a join hint, an inline table and a subquery, all inside the governed boundary."""
    governed = access.GovernedSql(spark, dict(pedidos=(t := Silver(spark, sf))["pedidos"], clientes=t["clientes"]))
    answer = governed.query("""
        SELECT /*+ MERGE(c) */ p.pedido_id, c.segmento, row_number() OVER w AS turno, sum(p.total_neto) OVER w AS acumulado
        FROM pedidos p JOIN clientes c ON c.cliente_id = p.cliente_id
        WHERE p.total_neto BETWEEN 1000 AND (SELECT avg(total_neto) FROM pedidos) AND p.canal IN (SELECT canal FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) AS v(canal))
        WINDOW w AS (PARTITION BY p.cliente_id ORDER BY p.fecha_pedido NULLS FIRST, p.pedido_id, c.segmento NULLS FIRST)""")
    return plain(answer.result)


def quality_digest(spark: SparkSession, sf: str) -> DataFrame:
    frames = bronze(spark, sf)
    profiles = reduce(DataFrame.unionByName, [profiling.profile(df, t) for t, _, df in _keyed(frames)])
    return access.quality_digest(rules.check_all(frames), profiles, transformation_log(frames, RUN_TIME))


# --- gold from bronze, as one plan ---

def country_sales_from_bronze(spark: SparkSession, sf: str) -> DataFrame:
    orders = clean("pedidos", frame(spark, sf, "pedidos"))
    return gold.build("gold_ventas_por_pais", {"pedidos": orders})


def _silver(table: str) -> Query:
    return lambda spark, sf: plain(clean(table, frame(spark, sf, table)))


def _gold(name: str) -> Query:
    return lambda spark, sf: plain(gold.build(name, Silver(spark, sf)))


def _profile(table: str) -> Query:
    return lambda spark, sf: profiling.profile(frame(spark, sf, table).drop("_file_order"), table)


def _violations(rule) -> Query:
    return lambda spark, sf: plain(violating_rows(rule, (f := bronze(spark, sf))[rule.table], f))


def _customers(change: Callable[[DataFrame], DataFrame], *shown: str) -> Query:
    return lambda spark, sf: frame(spark, sf, "clientes").transform(change).select("cliente_id", *shown)


def phases(spark: SparkSession, sf: str) -> DataFrame:
    before = bronze(spark, sf)
    return rules.check_phases(before, {t: pin(clean(t, df)) for t, df in before.items()})


def dedup_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    return plain(repair.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))


def violations(spark: SparkSession, sf: str) -> DataFrame:
    return rules.violations(bronze(spark, sf))


def sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of two halves of a table, merged: exact figures, and whether the others lie within their stated error."""
    parts = []
    for table, key, df in (t for t in _keyed(bronze(spark, sf)) if t[0] in ("pedidos", "productos")):
        half = F.xxhash64(key) % 2 == 0
        both = sketch.sketches(df.where(half), table).unionByName(sketch.sketches(df.where(~half), table))
        found = pin(sketch.merged(both))
        exact = profiling.profile(df, table).select("column", F.col("unique").alias("_exact"))
        ranks = df.agg(*[F.struct(F.avg((v < m).cast("int")).alias("below"), F.avg((v <= m).cast("int")).alias("upto")).alias(f.name)
                         for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
                         for v, m in [(F.nullif(F.col(f.name).cast("double"), F.lit(float("nan"))), found.where(F.col("column") == f.name).select(F.get("quantiles", F.lit(0))).scalar())]])
        ranks = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.below").alias("below"), F.col(f"{c}.upto").alias("upto")) for c in ranks.columns])))
        near = F.abs(F.col("unique") - F.col("_exact")) <= sketch.DISTINCT_ERROR * F.col("_exact")
        middle = (F.col("below") <= 0.5 + sketch.RANK_ERROR) & (F.col("upto") >= 0.5 - sketch.RANK_ERROR)
        parts.append(found.join(exact, "column").join(ranks, "column", "left").select(
            "table", "column", "n", "nulls", "null_pct", "min", "max", near.alias("unique_near"), F.coalesce(middle, F.lit(True)).alias("median_near")))
    return reduce(DataFrame.unionByName, parts)


# --- the catalog ---

def _in_catalog(spark: SparkSession, df: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` makes of a catalog table that holds df; the table's files lie in the work folder."""
    name = f"checks_{uuid.uuid4().hex}"
    catalog.save_table(df, name, _work_path(spark))
    return read(name)


def catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table saved, replaced and read back by SQL."""
    products = plain(frame(spark, sf, "productos"))
    path = _work_path(spark)
    name = f"checks_{uuid.uuid4().hex}"
    catalog.save_table(products.limit(1), name, path)
    catalog.save_table(products, name, path)
    return catalog.run_sql(spark, f"SELECT categoria, count(*) AS n, sum(precio_venta) AS total FROM {name} GROUP BY categoria").withColumn("total", F.round("total", 2))


def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _in_catalog(spark, plain(frame(spark, sf, "pedidos")), lambda name: catalog.describe_table(spark, name))


def catalog_names(spark: SparkSession, sf: str) -> DataFrame:
    """Of the listed names, those of views over this query's tables, with their rows."""
    frames = {f"checks_view_{t}": df for t, df in bronze(spark, sf).items()}
    catalog.register(frames)
    rows = profiling.inventory(frames).select(F.col("table").alias("name"), "total_rows")
    return catalog.list_tables(spark).join(rows, "name")


def governed_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a source table as the dictionary has them, and of a gold table as built."""
    customers = frame(spark, sf, "clientes")
    entries = [("clientes", f.name, f.dataType.simpleString(), "", "Sí" if f.name in PII_COLUMNS else "No", "", 365, "", "") for f in customers.schema.fields]
    countries = gold.build("gold_ventas_por_pais", Silver(spark, sf))
    governed = access.GovernedSql(spark, {"clientes": customers, "gold_ventas_por_pais": countries}, spark.createDataFrame(entries, DICTIONARY_SCHEMA))
    return governed.schema("clientes").unionByName(governed.schema("gold_ventas_por_pais")).select("tabla", "columna", "tipo", "pii")


def sql_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A file of named SQL texts over the cleaned orders: a good one, one that fails and one that is no plain read."""
    path = _work_path(spark)
    catalog.register({"checks_pedidos": plain(Silver(spark, sf)["pedidos"])})
    text = ("-- @name: por_canal\nSELECT canal, count(*) AS n FROM checks_pedidos WHERE total_neto BETWEEN 0 AND 1000000 GROUP BY canal;\n"
            "-- @name: todos\nSELECT pedido_id FROM checks_pedidos;\n-- @name: roto\nSELECT missing FROM checks_pedidos;\n-- @name: borra\nDROP VIEW checks_pedidos;\n")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    status = reports.run_reports(Lake(spark, _work_path(spark), run_time=RUN_TIME), {}, reports.load_sql_reports(path), reports={})
    return status.select("name", "rows", F.col("error").isNotNull().alias("failed"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    tables = Silver(spark, sf)
    return profiling.inventory({n: gold.build(n, tables) for n in gold.BUILDERS})


def numeric_summary_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Very small and very large values, shown again at their common scale."""
    parts = load(spark, sf, "part")
    lines = []
    for name, power in (("tiny", -15), ("plain", 0), ("huge", 25)):
        figures = explore.numeric_summary(parts.select((F.col("p_retailprice") * 10.0**power).alias("v")), "v")
        lines.append(figures.select(F.lit(name).alias("scale"), *[F.round(F.col(c) * 10.0**-power, 4).alias(c) for c in figures.columns]))
    return reduce(DataFrame.unionByName, lines)


def pipeline_from_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw CSV files and a dictionary through all layers; shown are a gold table and the rule report of both phases."""
    lake = Lake(spark, _work_path(spark))
    entries = []
    with shuffles_freed(spark):
        for table, df in bronze(spark, sf).items():
            ordered = df.orderBy("_file_order").drop("_file_order") if table == "pedidos" else df
            write_csv(ordered, lake.path(RAW, table), compression="gzip")
            for field in ordered.schema.fields:
                kind = {"string": "VARCHAR(200)", "timestamp_ntz": "TIMESTAMP"}.get(field.dataType.simpleString(), field.dataType.simpleString().upper())
                entries.append((table, field.name, kind, "", "No", "", 365, "", ""))
        write_csv(spark.createDataFrame(entries, DICTIONARY_SCHEMA), lake.path(RAW, "diccionario_datos"))
        run(spark, lake.root, run_time=RUN_TIME)
    sales = lake.read(GOLD, "gold_ventas_por_pais").select(
        F.lit("sales").alias("kind"), F.col("pais_envio").alias("item"), F.round("revenue_neto", 2).alias("value"))
    checked = lake.read(REPORTS, "silver_rules").select(F.col("phase").alias("kind"), F.col("rule_id").alias("item"), F.col("violations").cast("double").alias("value"))
    return sales.unionByName(checked)


QUERIES: dict[str, Query] = {
    "layer_round_trip": layer_round_trip,
    "csv_round_trip": csv_round_trip,

    "bronze_ingest": bronze_ingest,
    "row_hash": row_hashes,
    "lenient_dates": lenient_dates,
    "bronze_null_problems": bronze_null_problems,
    "cast_failures": cast_failures,

    "profile_clientes": _profile("clientes"),
    "profile_productos": _profile("productos"),
    "profile_pedidos": _profile("pedidos"),
    "profile_detalle_pedidos": _profile("detalle_pedidos"),
    "profile_tables": profile_tables,
    "profile_eventos": _profile("eventos"),
    "profile_documents": profile_documents,
    "duplicated_documents": duplicated_documents,
    "duplicated_lines": duplicated_lines,
    "duplicate_keys": lambda spark, sf: plain(
        profiling.duplicates_by_key(frame(spark, sf, "detalle_pedidos"), "item_id")),

    **{f"rule_{rule.rule_id.lower()}": _violations(rule) for rule in RULES},
    "rule_report": lambda spark, sf: rules.check_all(bronze(spark, sf)),
    "rule_phases": phases,
    "violations": violations,
    "sketched_profile": sketched_profile,

    "catalog_table": catalog_table,
    "catalog_columns": catalog_columns,
    "catalog_names": catalog_names,
    "governed_schema": governed_schema,
    "sql_reports": sql_reports,

    "fill_null_email": _customers(lambda df: repair.fill_null(df, "email", DEFAULT_SITE.missing_email), "email"),
    "nullify_phone": _customers(lambda df: repair.nullify(df, "telefono", INVALID_PHONE), "telefono"),
    "fill_blank_city": _customers(lambda df: repair.fill_blank(df, "ciudad", UNKNOWN_CITY), "ciudad"),
    "fill_null_stock": lambda spark, sf: plain(
        repair.fill_null_int(frame(spark, sf, "productos"), "stock_disponible").select("producto_id", "stock_disponible")),
    "dedup_orders": lambda spark, sf: plain(
        repair.keep_first(frame(spark, sf, "pedidos"), ["pedido_id"], ["_file_order"])),
    "dedup_lines": dedup_lines,
    "fill_group_median": lambda spark, sf: repair.fill_group_median(
        frame(spark, sf, "eventos"), "tipo_evento", "duracion_seg").select("evento_id", "tipo_evento", "duracion_seg"),
    "group_medians": lambda spark, sf: group_medians(load(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice"),
    "transformation_log": lambda spark, sf: transformation_log(bronze(spark, sf), RUN_TIME),

    "mask_hash": _customers(lambda df: df.withColumn("ciudad", sha256(F.col("ciudad"))), "ciudad"),
    "mask_email": _customers(lambda df: repair.fill_null(df, "email", DEFAULT_SITE.missing_email).withColumn(
        "email", mask_email(F.col("email"))), "email"),
    "mask_name": _customers(lambda df: df.withColumn("apellido", mask_name(F.col("apellido"))), "apellido"),
    "mask_phone_tail": _customers(lambda df: df.withColumn("telefono", mask_phone(F.col("telefono"))), "telefono"),
    "mask_customers": lambda spark, sf: plain(masking.mask_customers(frame(spark, sf, "clientes"))),

    "pii_findings_documents": lambda spark, sf: plain(textscan.findings(_texts(spark, sf), ["doc_id"], "text")),
    "pii_findings_pages": lambda spark, sf: plain(textscan.findings(_pages(spark, sf), ["page_id"], "html")),
    "pii_findings_cued_documents": lambda spark, sf: textscan.findings_cued(_texts(spark, sf), ["doc_id"], "text"),
    "pii_findings_cued_pages": lambda spark, sf: textscan.findings_cued(_pages(spark, sf), ["page_id"], "html"),
    "redact_documents": lambda spark, sf: textscan.redact(_texts(spark, sf), "text"),
    "redact_pages": lambda spark, sf: textscan.redact(_pages(spark, sf), "html"),
    "redact_output_documents": lambda spark, sf: textscan.redact_output(_texts(spark, sf), "text"),
    "pii_findings_conversations": lambda spark, sf: plain(
        textscan.findings(_turns(spark, sf), ["conv_id", "turn"], "text")),
    "redact_output_conversations": lambda spark, sf: textscan.redact_output(_turns(spark, sf), "text"),
    "redact_output_pages": lambda spark, sf: textscan.redact_output(_pages(spark, sf), "html"),

    "silver_clientes": _silver("clientes"),
    "silver_productos": _silver("productos"),
    "silver_pedidos": _silver("pedidos"),
    "silver_detalle_pedidos": _silver("detalle_pedidos"),
    "silver_eventos": _silver("eventos"),

    **{name: _gold(name) for name in gold.BUILDERS},
    "gold_inventory": inventory,
    "country_sales_from_bronze": country_sales_from_bronze,
    "pipeline_from_raw": pipeline_from_raw,

    "q01_top_productos_ingreso": lambda spark, sf: reports.top_products(
        gold.build("gold_top_productos", Silver(spark, sf))),
    "q02_ventas_por_pais": lambda spark, sf: reports.country_ranking(
        gold.build("gold_ventas_por_pais", Silver(spark, sf))),
    "q03_conversion_por_canal": lambda spark, sf: reports.channel_revenue(
        gold.build("gold_ventas_por_canal", Silver(spark, sf))),
    "q04_clientes_b2b_grandes": lambda spark, sf: reports.big_customers(
        (t := Silver(spark, sf))["pedidos"], t["clientes"]),
    "q05_comparativa_paises": lambda spark, sf: reports.compare_countries(Silver(spark, sf)["pedidos"], *COUNTRIES),
    "q06_top5_productos_periodo": lambda spark, sf: reports.top_products_between(
        (t := Silver(spark, sf))["detalle_pedidos"], t["pedidos"], t["productos"], *PERIOD),
    "q07_metodo_pago_por_pais": lambda spark, sf: reports.payment_by_country(Silver(spark, sf)["pedidos"]),
    "q08_tasa_cancelacion_devolucion": lambda spark, sf: reports.lost_order_share(Silver(spark, sf)["pedidos"]),
    "q09_margen_bruto_categoria": lambda spark, sf: reports.category_margin(
        (t := Silver(spark, sf))["detalle_pedidos"], t["productos"]),
    "q10_actividad_horaria": lambda spark, sf: plain(reports.hourly_activity(Silver(spark, sf)["eventos"])),
    "q11_segmentacion_rfm": lambda spark, sf: reports.rfm_distribution(
        gold.build("gold_clientes_rfm", Silver(spark, sf))),
    "q12_cohorte_retencion_mensual": lambda spark, sf: plain(reports.monthly_retention(Silver(spark, sf)["pedidos"])),
    "paises_por_ingreso": lambda spark, sf: reports.countries_by_revenue(
        gold.build("gold_ventas_por_pais", Silver(spark, sf))),
    "productos_mas_vendidos": lambda spark, sf: reports.best_sellers(
        gold.build("gold_top_productos", Silver(spark, sf))),
    "ticket_promedio_por_canal": lambda spark, sf: reports.average_ticket(
        gold.build("gold_ventas_por_canal", Silver(spark, sf))),
    "metodo_pago_en_pais": lambda spark, sf: reports.payment_in_country(Silver(spark, sf)["pedidos"], COUNTRIES[0]),
    "clientes_por_segmento": lambda spark, sf: reports.customers_per_segment(Silver(spark, sf)["clientes"]),

    "governed_customers": governed_customers,
    "governed_totals": governed_totals,
    "governed_windows": governed_windows,
    "quality_digest": quality_digest,

    "null_columns": lambda spark, sf: explore.null_columns(Silver(spark, sf)["pedidos"]),
    "marker_counts": lambda spark, sf: explore.marker_counts(
        frame(spark, sf, "clientes"), {"telefono": INVALID_PHONE}, ["ciudad"]),
    "value_counts": lambda spark, sf: explore.value_counts(Silver(spark, sf)["pedidos"], ["estado", "canal", "pais_envio"]),
    "value_counts_events": lambda spark, sf: explore.value_counts(
        frame(spark, sf, "eventos"), ["tipo_evento", "dispositivo"]),
    "numeric_summary": lambda spark, sf: explore.numeric_summary(frame(spark, sf, "productos"), "precio_venta"),
    "numeric_summary_scales": numeric_summary_scales,
    "predicate_count": lambda spark, sf: explore.count_where(
        frame(spark, sf, "productos"), F.col("precio_venta") <= F.col("costo")),
    "repeated_keys": lambda spark, sf: explore.repeated_keys(
        frame(spark, sf, "pedidos"), "pedido_id"),
    "fk_orphans": lambda spark, sf: plain(rules.orphans(
        load(spark, sf, "orders"), "o_orderkey", load(spark, sf, "lineitem"), "l_orderkey")),
    "distinct_references": lambda spark, sf: explore.distinct_references(
        frame(spark, sf, "detalle_pedidos"), ["producto_id", "pedido_id"]),
    "histogram": lambda spark, sf: explore.histogram(load(spark, sf, "orders"), "o_totalprice"),
    "category_share": lambda spark, sf: explore.category_share(frame(spark, sf, "eventos"), "dispositivo"),
    "table_shapes": lambda spark, sf: profiling.inventory(bronze(spark, sf)),
}
