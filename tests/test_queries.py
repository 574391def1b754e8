"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import TESTDATA, assert_same, duckdb_tables

from millrace.plans import QUERIES, SQL


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, name, scale):
    root = str(TESTDATA / scale)
    expected = duckdb_tables(root).sql(SQL[name]).to_arrow_table()
    assert expected.num_rows > 0
    assert_same(QUERIES[name](spark, root).toArrow(), expected)
