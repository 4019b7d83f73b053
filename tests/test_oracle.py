"""Every registered query against its SQL, row by row."""

import pytest
from compare import rows_of, sql_rows

from marginalia.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    names, want = sql_rows(SQL[name], sf)
    assert sorted(df.columns) == names
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
