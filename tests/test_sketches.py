"""Mergeable profiles, counts taken while writing, and all violations of a table at once."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators import rules, sketches
from stratalake.operators.tallies import ROWS, null_lines, tallies
from stratalake.plans.together import together


def test_parts_merge_to_the_whole(spark):
    df = spark.range(20_000).select(
        "id", (F.col("id") % 700).alias("k"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") * 0.5).alias("v"),
        F.concat(F.lit("t"), F.col("id") % 90).alias("t"), F.lit(None).cast("double").alias("none"), (F.col("id") % 2 == 0).alias("b"))
    parts = [sketches.sketches(df.where(F.col("id") % 3 == n), "x") for n in range(3)]
    got = {r.column: r for r in sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), [0.25, 0.5]).collect()}
    for column, unique in (("id", 20_000), ("k", 700), ("v", 15_000), ("t", 90), ("none", 0), ("b", 2)):
        assert got[column].n == 20_000
        assert abs(got[column].unique - unique) <= sketches.DISTINCT_ERROR * unique
    assert got["v"].nulls == 5_000 and got["none"].nulls == 20_000 and got["none"].null_pct == 100.0
    assert (got["k"].min, got["k"].max) == (0.0, 699.0) and got["t"].quantiles is None and got["none"].quantiles is None
    for quantile, value in zip((0.25, 0.5), got["id"].quantiles):
        assert abs(value / 20_000 - quantile) <= sketches.RANK_ERROR


def test_sketches_of_an_empty_table(spark):
    empty = sketches.sketches(spark.createDataFrame([], "a int, b string"), "x")
    assert rows(sketches.merged(empty).select("column", "n", "unique", "null_pct")) == [("a", 0, 0, 0.0), ("b", 0, 0, 0.0)]


@pytest.fixture(scope="module")
def retail(spark):
    customers = spark.createDataFrame(
        [("C1", None, "N/A", ""), ("C1", "a@b.co", "1", "Lima"), ("C2", "c@d.co", "2", "Lima"), (None, "e@f.co", "3", "Lima")],
        "cliente_id string, email string, telefono string, ciudad string")
    orders = spark.range(300).select(
        F.concat(F.lit("P"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("pedido_id"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "C9").otherwise("C1").alias("cliente_id"),
        F.lit(100.0).alias("total_bruto"), F.lit(0.0).alias("descuento_pct"), F.when(F.col("id") == 7, 50.0).otherwise(100.0).alias("total_neto"),
        F.lit("2024-02-01").cast("date").alias("fecha_pedido"), F.lit(None).cast("date").alias("fecha_entrega"),
        F.when(F.col("id") < 5, "raro").otherwise("enviado").alias("estado"))
    return {"clientes": customers, "pedidos": orders}


def test_violations_equal_the_rules_one_by_one(retail):
    got = rows(rules.violations(retail))
    expected = []
    for rule in rules.RULES:
        if rule.table in retail:
            key = rules.KEYS[rule.table]
            for r in rules.violating_rows(rule, retail[rule.table], retail).groupBy(key).count().collect():
                expected.append((rule.rule_id, rule.table, r[key], r["count"]))
    assert got == sorted(expected, key=repr)
    assert ("R002", "pedidos", "P0", 100) in got and ("R001", "clientes", "C1", 2) in got


def test_violations_scan_each_table_once(spark, retail, tmp_path):
    stored = {}
    for table, df in retail.items():
        df.write.parquet(str(tmp_path / table))
        stored[table] = spark.read.parquet(str(tmp_path / table))
    plan = rules.violations(stored)._jdf.queryExecution().optimizedPlan().toString()
    # orders once; customers once for their own rules and once more for the keys that orders refer to
    assert plan.count("Relation [") == 3 and plan.count("pedido_id#") > 0


def test_tallies_equal_queries(retail):
    orders = retail["pedidos"]
    counted = orders.agg(*[c.alias(n) for n, c in tallies(orders, "pedidos").items()]).first().asDict()
    assert counted[ROWS] == 300 and counted["null cliente_id"] == 30 and counted["R009"] == 1 and counted["R011"] == 5
    lines = {r.column: (r.nulls, r.null_pct) for r in null_lines(orders, "pedidos", counted).collect()}
    assert lines["cliente_id"] == (30, 10.0) and lines["fecha_entrega"] == (300, 100.0)


def test_jobs_at_once_raise_the_first_failure(spark):
    done = []

    def job(n):
        done.append(spark.range(n).count())
        if n == 3:
            raise ValueError("three")
        return n

    assert together(spark, {str(n): lambda n=n: job(n) for n in (1, 2)}) == {"1": 1, "2": 2}
    with pytest.raises(ValueError, match="three"):
        together(spark, {str(n): lambda n=n: job(n) for n in (3, 4, 5)})
    assert sorted(done) == [1, 2, 3, 4, 5] and together(spark, {}) == {}
