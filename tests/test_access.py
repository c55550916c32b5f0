"""Governed SQL: what runs, what is refused, and that no personal value comes out."""

import pytest

from stratalake.plans.access import Answer, GovernedSql, QueryRefused, check_read_only, ungoverned_leaf, without_personal


@pytest.fixture(scope="module")
def governed(spark):
    people = [(f"C{i}", f"Ana{i}", f"Ruiz{i}", f"a{i}@mail.example", f"300{i}", "Lima") for i in range(120)]
    customers = spark.createDataFrame(
        people, "cliente_id string, nombre string, apellido string, email string, telefono string, ciudad string")
    countries = spark.createDataFrame([("Perú", 3), ("Chile", 2)], "pais_envio string, total_pedidos bigint")
    spark.createDataFrame([("secret",)], "v string").createOrReplaceTempView("raw_secret")
    return GovernedSql(spark, {"clientes": customers, "gold_ventas_por_pais": countries, "raw_secret": customers})


@pytest.mark.parametrize("query", [
    "SELECT * FROM gold_ventas_por_pais",
    "  select 1 ; ",
    "WITH t AS (SELECT 1 AS a) SELECT a FROM t",
    "SELECT 'drop table; delete' AS text -- update later",
    "SELECT created_at, updates FROM x",
])
def test_reads_pass(query, spark):
    assert check_read_only(query, spark=spark) == (True, "OK")


@pytest.mark.parametrize("query", [
    "DELETE FROM clientes", "DROP TABLE clientes", "INSERT INTO clientes VALUES (1)", "UPDATE clientes SET nombre = 'x'",
    "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "SELECT 1; DROP TABLE x", "SELECT 1 /* a */ ; truncate table x",
    "ALTER TABLE x ADD COLUMN y int", "", "SHOW TABLES", "SELECT java_method('java.lang.System', 'exit', 0)",
    "SELECT reflect ('a', 'b')", "EXECUTE IMMEDIATE 'x'", "CREATE TABLE y AS SELECT 1",
])
def test_everything_else_is_refused(query, governed):
    assert not check_read_only(query, spark=governed.session)[0]
    with pytest.raises(QueryRefused):
        governed.query(query)


def test_personal_columns_are_dropped(governed):
    answer = governed.query("SELECT * FROM clientes")
    assert answer.result.columns == ["cliente_id", "ciudad"]
    assert answer.rows.count() == answer.total() == 120
    assert len(answer.text().splitlines()) == 121


def test_a_caller_may_ask_for_a_head(governed):
    head = Answer(governed.query("SELECT * FROM clientes").result, cap=50)
    assert head.rows.count() == 50 and head.total() == 120
    assert head.text().splitlines()[-1] == "... (50 of 120 rows)"


def test_a_named_personal_column_still_runs(governed):
    assert governed.query("SELECT nombre, ciudad FROM clientes").result.columns == ["ciudad"]


@pytest.mark.parametrize("query", [
    "SELECT email AS x FROM clientes",
    "SELECT concat(nombre, ' ', apellido) AS x FROM clientes",
    "SELECT max(telefono) AS x FROM clientes",
    "SELECT x FROM (SELECT upper(email) AS x FROM clientes) t",
])
def test_an_alias_brings_nothing_back(governed, query):
    assert {r.x for r in governed.query(query).rows.collect()} == {None}


def test_a_personal_filter_finds_nothing(governed):
    answer = governed.query("SELECT cliente_id FROM clientes WHERE email = 'a1@mail.example'")
    assert answer.text() == "no results"


@pytest.mark.parametrize("query", [
    "SELECT * FROM raw_secret",
    "SELECT * FROM global_temp.stratalake_clientes",
    "SELECT * FROM `global_temp`.`stratalake_clientes`",
    "SELECT * FROM default.anything",
    "SELECT * FROM spark_catalog.default.anything",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
])
def test_only_governed_views_are_visible(governed, query):
    with pytest.raises(Exception) as refused:
        governed.query(query).rows.collect()
    assert isinstance(refused.value, QueryRefused) or "NOT_FOUND" in str(refused.value) or "UNSUPPORTED" in str(refused.value)


@pytest.mark.parametrize("query", [
    "SELECT 1 AS v -- it's\nUNION ALL SELECT v FROM default.secret -- '",
    "WITH t AS (SELECT 1 -- it's\n) INSERT INTO default.secret SELECT 'x' -- '",
    "SELECT * FROM IDENTIFIER('default.secret')",
    "SELECT 1 AS `it's`, reflect('java.lang.System', 'lineSeparator') AS `x'y`",
    "SELECT * FROM later_database.t",
    "SELECT * FROM range(10)",
    "SELECT (SELECT max(v) FROM default.secret) AS v",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM default.secret)",
    "SELECT cliente_id FROM clientes WHERE cliente_id IN (SELECT v FROM raw_secret)",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT input_file_name() FROM clientes",
    "SELECT default.my_function(1)",
    "SELECT count(*) OVER w FROM clientes WINDOW w AS (PARTITION BY (SELECT max(v) FROM default.secret))",
    """SELECT sum(cliente_id) OVER w FROM clientes WINDOW w AS
       (ORDER BY (CASE WHEN (SELECT max(v) FROM default.secret) = 'leak' THEN cliente_id ELSE -cliente_id END))""",
    "SELECT rank() OVER w FROM clientes WINDOW w AS (ORDER BY reflect('java.lang.System', 'lineSeparator'))",
    "SELECT 1 FROM (SELECT count(*) OVER b FROM clientes WINDOW a AS (ORDER BY 1), b AS (PARTITION BY (SELECT max(v) FROM raw_secret)))",
    "SELECT cliente_id, count(*) OVER (PARTITION BY (SELECT max(v) FROM default.secret)) FROM clientes",
    "SELECT * FROM clientes ORDER BY (SELECT max(v) FROM default.secret)",
    "SELECT * FROM clientes a JOIN clientes b ON a.cliente_id = (SELECT max(v) FROM default.secret)",
    "SELECT ciudad, count(*) FROM clientes GROUP BY GROUPING SETS ((ciudad), ((SELECT max(v) FROM default.secret)))",
    "SELECT * FROM clientes PIVOT (count(1) FOR ciudad IN ('Lima', (SELECT max(v) FROM default.secret)))",
    "SELECT * FROM clientes LIMIT (SELECT max(v) FROM default.secret)",
    "SELECT * FROM VALUES ((SELECT max(v) FROM default.secret)) AS t(v)",
    "SELECT * FROM clientes TABLESAMPLE (10 PERCENT)",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'lineSeparator'))",
    "SELECT /*+ UNKNOWN(clientes) */ * FROM clientes",
])
def test_ways_around_are_refused_before_anything_runs(governed, spark, query):
    spark.sql("CREATE DATABASE IF NOT EXISTS later_database")
    with pytest.raises(QueryRefused):
        governed.query(query)


def test_own_common_tables_subqueries_and_joins_pass(governed):
    answer = governed.query("""
        WITH big AS (SELECT pais_envio FROM gold_ventas_por_pais WHERE total_pedidos > 2), two AS (SELECT * FROM big)
        SELECT g.pais_envio, rank() OVER (ORDER BY total_pedidos DESC) AS place FROM gold_ventas_por_pais g
        JOIN two USING (pais_envio) WHERE total_pedidos >= (SELECT avg(total_pedidos) FROM gold_ventas_por_pais)
        ORDER BY 1 LIMIT 5""")
    assert [r.pais_envio for r in answer.rows.collect()] == ["Perú"]


@pytest.mark.parametrize("query, n", [
    ("SELECT cliente_id FROM clientes WHERE length(cliente_id) BETWEEN 2 AND 3 AND cliente_id NOT BETWEEN 'C5' AND 'C6'", 88),
    ("SELECT /*+ BROADCAST(b), MERGE(a) */ a.cliente_id FROM clientes a JOIN clientes b USING (cliente_id)", 120),
    ("SELECT /*+ REPARTITION(3) */ cliente_id FROM clientes", 120),
    ("SELECT cliente_id, row_number() OVER w AS k FROM clientes WINDOW w AS (PARTITION BY ciudad ORDER BY cliente_id)", 120),
    ("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v) WHERE k IN (SELECT total_pedidos - 1 FROM gold_ventas_por_pais)", 2),
])
def test_plain_sql_passes(governed, query, n):
    assert governed.query(query).rows.count() == n


def test_the_analysed_plan_reads_governed_views_only(governed, spark):
    leaf = lambda df: ungoverned_leaf(df._jdf.queryExecution().analyzed(), governed._views, governed._jvm)
    assert leaf(governed.session.sql("SELECT a.ciudad FROM clientes a JOIN clientes b USING (cliente_id) WHERE EXISTS (SELECT 1 FROM clientes)")) is None
    assert leaf(governed.session.sql("WITH t AS (SELECT 1 AS v) SELECT * FROM t UNION ALL SELECT * FROM t")) is None
    # another view of the same name, a table, a range, and a subquery in a named window
    spark.range(3).createOrReplaceTempView("clientes")
    assert leaf(spark.sql("SELECT * FROM clientes")) == "clientes"
    spark.catalog.dropTempView("clientes")
    other = spark.range(3)
    assert leaf(other) == "Range"
    other.createOrReplaceTempView("hidden_rows")
    assert leaf(spark.sql("SELECT count(*) OVER w FROM VALUES (1) AS t(a) WINDOW w AS (PARTITION BY (SELECT max(id) FROM hidden_rows))")) == "hidden_rows"
    assert leaf(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_two_instances_do_not_share_views(spark):
    a, b = (GovernedSql(spark, {"clientes": spark.createDataFrame([(n,)], "cliente_id int")}) for n in (1, 2))
    assert [a.query("SELECT * FROM clientes").rows.first()[0], b.query("SELECT * FROM clientes").rows.first()[0]] == [1, 2]
    a.close()
    assert b.query("SELECT * FROM clientes").rows.count() == 1


def test_tables_and_schema(governed):
    assert governed.tables() == ["clientes", "gold_ventas_por_pais"]
    listed = governed.schema("gold_ventas_por_pais").collect()
    assert [(r.columna, r.tipo) for r in listed] == [("pais_envio", "string"), ("total_pedidos", "bigint")]
    with pytest.raises(QueryRefused):
        governed.schema("raw_secret")


def test_a_database_with_tables_is_refused(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS not_empty")
    spark.range(1).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("not_empty.t")
    with pytest.raises(ValueError):
        GovernedSql(spark, {}, database="not_empty")
    spark.sql("DROP DATABASE not_empty CASCADE")


def test_result_columns_by_name(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, Email string, other string")
    assert without_personal(df).columns == ["id", "other"]
