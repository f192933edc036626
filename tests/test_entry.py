import re

import oracle
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    dealt = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}  # tested with their subpackage
    assert set(QUERIES) - set(SQL) - dealt == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.compare(spark, con, sf, QUERIES[name], SQL[name]) is None


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["app", "day", "records", "errors", "error_rate"]
    assert df.count() > 0
