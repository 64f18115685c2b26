"""Every query with SQL gives DuckDB's rows; the others run and keep their schema."""

import pytest

from lectern.plans.catalogue import QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name].plan, QUERIES[name].sql, SF) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_runs(spark, name):
    assert QUERIES[name].plan(spark, SF).count() > 0


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
