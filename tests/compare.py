"""Comparison of a Spark result with a DuckDB result: names, types and all rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

from millrace.sources import SCHEMAS

TESTDATA = Path("/root/testdata")


def duckdb_tables(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    return connection


def _types(table: pa.Table) -> dict[str, str]:
    return {
        field.name: str(field.type).replace("large_string", "string") for field in table.schema
    }


def _rows(table: pa.Table) -> Counter:
    columns = [table.column(name).to_pylist() for name in sorted(table.column_names)]
    return Counter(zip(*columns))


def assert_same(actual: pa.Table, expected: pa.Table) -> None:
    assert _types(actual) == _types(expected)
    assert actual.num_rows == expected.num_rows
    left, right = _rows(actual), _rows(expected)
    surplus, missing = (left - right).most_common(3), (right - left).most_common(3)
    assert left == right, f"surplus {surplus}, missing {missing}"
