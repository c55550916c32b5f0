"""Rules at their boundaries, with null keys and hot keys."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from stratalake.operators.profiling import duplicates_by_key
from stratalake.operators.rules import RULES, check_all, check_table, orphans, rows_of_repeated_key, violating_rows

ORDER_SCHEMA = (
    "pedido_id string, cliente_id string, fecha_pedido date, fecha_entrega date, estado string, "
    "total_bruto decimal(14,2), descuento_pct decimal(5,2), total_neto decimal(14,2)"
)
DAY = date(2024, 5, 1)


def order(key, customer="C1", made=DAY, came=None, state="enviado", gross="100", discount="0.10", net="90"):
    number = [None if v is None else Decimal(v) for v in (gross, discount, net)]
    return (key, customer, made, came, state, *number)


def counts(spark, orders, customers=("C1",)):
    frames = {
        "pedidos": spark.createDataFrame(orders, ORDER_SCHEMA),
        "clientes": spark.createDataFrame([(c,) for c in customers], "cliente_id string"),
    }
    return {r.rule_id: (r.violations, r.passed) for r in check_table("pedidos", frames["pedidos"], frames).collect()}


def test_clean_orders_pass(spark):
    assert counts(spark, [order("P1"), order("P2")]) == {r: (0, True) for r in ("R002", "R007", "R009", "R010", "R011")}


def test_repeated_and_null_keys(spark):
    got = counts(spark, [order("P1"), order("P1"), order("P2"), order(None), order(None), order("P3")])
    assert got["R002"] == (4, False)


def test_unknown_and_null_customer(spark):
    assert counts(spark, [order("P1"), order("P2", "C9"), order("P3", None)])["R007"] == (2, False)


def test_net_total_boundary(spark):
    got = counts(spark, [order("P1", net="91.00"), order("P2", net="91.01"), order("P3", net="88.99"), order("P4", net=None)])
    assert got["R009"] == (2, False)


def test_delivery_and_state(spark):
    early, late = date(2024, 4, 30), date(2024, 5, 1)
    got = counts(spark, [order("P1", came=early), order("P2", came=late), order("P3", made=None, came=early),
                         order("P4", state=None), order("P5", state="ENVIADO")])
    assert got["R010"] == (1, False)
    assert got["R011"] == (2, False)


def test_customer_and_product_rules(spark):
    customers = spark.createDataFrame(
        [("C1", None, "N/A", " "), ("C2", "a@b.c", None, None), ("C2", "", "1", "x")],
        "cliente_id string, email string, telefono string, ciudad string")
    products = spark.createDataFrame(
        [(None, 10.0, 10.0), (1, 10.0, 9.0), (2, None, 9.0)], "stock_disponible int, precio_venta double, costo double")
    got = {r.rule_id: r.violations for r in check_all({"clientes": customers, "productos": products}).collect()}
    assert got == {"R001": 2, "R003": 1, "R004": 1, "R005": 2, "R006": 1, "R008": 1}


def test_empty_table_passes(spark):
    got = counts(spark, [], [])
    assert set(got.values()) == {(0, True)}


def test_violating_rows_agree_with_counts(spark):
    orders = [order("P1", "C9"), order("P1"), order("P2", net="1"), order("P3", came=date(2020, 1, 1)), order("P4", state="x")]
    frames = {"pedidos": spark.createDataFrame(orders, ORDER_SCHEMA),
              "clientes": spark.createDataFrame([("C1",)], "cliente_id string")}
    report = {r.rule_id: r.violations for r in check_table("pedidos", frames["pedidos"], frames).collect()}
    for rule in RULES:
        if rule.table == "pedidos":
            assert violating_rows(rule, frames["pedidos"], frames).count() == report[rule.rule_id], rule.rule_id


def test_hot_key_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = duplicates_by_key(df, "k")
    assert found.count() == 1000
    assert [r.id for r in found.limit(3).collect()] == [0, 3, 6]


def test_many_repeated_keys_take_the_shuffled_way(spark, monkeypatch):
    import stratalake.operators.rules as rules
    import stratalake.session as session

    monkeypatch.setattr(rules, "broadcast_if_small", lambda df: session.broadcast_if_small(df, 10))
    df = spark.range(2000).select("id", (F.col("id") % 500).alias("k"), F.when(F.col("id") > 1900, 1).alias("n"))
    assert rows_of_repeated_key(df, ["k"]).count() == 2000
    # Ids up to 1900 share a null n and repeat their k; the later ones have a k and n of their own.
    assert rows_of_repeated_key(df, ["k", "n"]).count() == 1901
    parents = spark.range(400)
    assert orphans(df, "k", parents, "id").count() == 400


def test_orphans_keep_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "k string, v int")
    assert rows(orphans(df, "k", spark.createDataFrame([("b",), ("b",)], "k string"), "k")) == sorted(
        [("a", 1), ("a", 1), (None, 2)], key=repr)
