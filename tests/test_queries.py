"""Every query runs; those with SQL give DuckDB's rows."""

import pytest
from oracle import connect, rows

import __spark_entry__ as entry
from seqmill.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = connect(sf).execute(SQL[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
