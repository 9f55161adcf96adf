"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF)


def test_every_sql_has_a_query():
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert oracle.differences(got, con.execute(entry.oracle_sql()[name]).to_arrow_table()) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(NAMES)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))
