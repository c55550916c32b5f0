"""Every registered query against its SQL on the smallest driver tables, and what its plan may hold."""

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    same, note = compare(spark, duck, SF, QUERIES[name], ORACLE[name])
    assert same, note


FORBIDDEN = ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_is_native_and_without_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan], plan


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
