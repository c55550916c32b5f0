"""Values that do not fit: odd CSV text, failed casts, NaN, columns without values, orders without their place."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from conftest import rows
from stratalake.operators.explore import distinct_references, numeric_summary
from stratalake.operators.ingest import with_lenient_dates
from stratalake.operators.ordering import group_medians
from stratalake.operators.repair import fill_null_int, repair_log
from stratalake.operators.rules import RULES, violating_rows
from stratalake.plans.silver import clean, repairs_of
from stratalake.sources.dictionary import RESCUED, apply_schema, cast_failures, spark_type
from stratalake.sources.layers import read_csv, write_csv

ODD = ['He said ""hi"", ok'.replace('""', '"'), "a,b", "back\\slash\\", '"', "line\nbreak", " spaces ", "", 'end\\"']


def test_a_file_written_by_pandas_reads_back(spark, tmp_path):
    path = str(tmp_path / "odd.csv")
    pd.DataFrame({"k": range(len(ODD)), "v": ODD}).to_csv(path, index=False)
    got = {int(r.k): r.v for r in read_csv(spark, path, multi_line=True).collect()}
    assert got == {k: v or None for k, v in enumerate(ODD)}


def test_a_written_file_reads_back_in_pandas(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame(list(enumerate(ODD)), "k int, v string").coalesce(1), path)
    got = pd.read_csv(next((tmp_path / "out").glob("part-*.csv")), keep_default_na=False)
    assert dict(zip(got.k, got.v)) == dict(enumerate(ODD))


def test_text_that_does_not_fit_is_kept(spark):
    df = spark.createDataFrame([("1", "1,234.50", "47.9"), ("2", "12.345", "47.0"), ("x", "12.30", None), (None, None, "7")], "a string, b string, c string")
    typed = apply_schema(df, T.StructType.fromDDL("a int, b decimal(10,2), c int"), rescue=True)
    assert [r[RESCUED] for r in typed.collect()] == [{"b": "1,234.50", "c": "47.9"}, {"b": "12.345"}, {"a": "x"}, None]
    assert rows(cast_failures(typed, "t")) == [("t", "a", 1), ("t", "b", 2), ("t", "c", 1)]


def test_declared_types(spark):
    assert [spark_type(t).simpleString() for t in ("BIGINT", "SMALLINT", "double", "NUMERIC(8, 3)", "DECIMAL", "VARCHAR(9)", "DECIMAL(7)")] == [
        "bigint", "smallint", "double", "decimal(8,3)", "decimal(38,10)", "string", "decimal(7,0)"]
    with pytest.raises(ValueError):
        spark_type("BLOB")


def test_dates_keep_their_time_and_other_patterns_can_be_read(spark):
    df = spark.createDataFrame([("2024-12-31 17:45:00",), ("2024-01-02",), ("31/12/2024",), ("?",)], "fecha_x string")
    got = [str(r[0]) for r in with_lenient_dates(df, formats=["dd/MM/yyyy"]).collect()]
    assert got == ["2024-12-31 17:45:00", "2024-01-02 00:00:00", "2024-12-31 00:00:00", "None"]


def test_nan_counts_as_missing_everywhere(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 1e300)], "producto_id int, stock_disponible double")
    assert [r[1] for r in fill_null_int(df, "stock_disponible").collect()] == [5, 0, 0, None]
    rule = next(r for r in RULES if r.rule_id == "R006")
    assert violating_rows(rule, df).count() == 2
    assert repair_log(df, repairs_of("productos"), "now").first().registros_afectados == 2


def test_means_of_tiny_and_huge_values(spark):
    small = spark.createDataFrame([(1e-12,), (3e-12,)], "v double")
    large = spark.createDataFrame([(9e27,)] * 20, "v double")
    assert abs(numeric_summary(small, "v").first()["mean"] - 2e-12) < 1e-24
    assert abs(numeric_summary(large, "v").first()["mean"] / 9e27 - 1) < 1e-12


def test_a_column_without_values_counts_zero(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a int, b int")
    assert rows(distinct_references(df, ["a", "b"])) == [("a", 0), ("b", 1)]


def test_orders_without_their_place_are_refused(spark):
    with pytest.raises(ValueError):
        clean("pedidos", spark.createDataFrame([(1,)], "pedido_id int"))


def test_medians_with_and_without_broadcasts(spark):
    from stratalake.operators.ordering import group_medians

    df = spark.createDataFrame([(k % 50, float(k * 7 % 101)) for k in range(2000)], "g int, v double")
    small = rows(group_medians(df, ["g"], "v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(group_medians(df, ["g"], "v")) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
