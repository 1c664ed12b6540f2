"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from sparkgauge.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    assert differences(QUERIES[name](spark, SF), db, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_text_reports_have_no_empty_text(spark, name):
    df = QUERIES[name](spark, SF)
    text = df.columns[-1]
    assert df.count() > 0
    assert df.where(df[text].isNull()).count() == 0


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
