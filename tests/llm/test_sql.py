"""Queries of the subpackage against their SQL, row by row."""

import pytest
from compare import rows_of, sql_rows

from marginalia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    names, want = sql_rows(queries.ORACLE[name], sf)
    assert sorted(df.columns) == names
    assert rows_of(df.columns, df.collect()) == want
