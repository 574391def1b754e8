"""Every batch and stream query against its SQL on small random tables with hot keys, ties,
nulls, orphans, repeated rows and dirty JSON."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same, duckdb_tables

from millrace.plans import QUERIES, SQL

TYPES = {"l": pa.int64(), "i": pa.int32(), "d": pa.float64(), "s": pa.string()}
PROPS = ['{"k": 5}', '{"k": 17}', '{"j": 1}', '{"k": null}', '{"k": "8"}', '{"k": "x"}', "{}", None]


def make(folder, seed: int) -> str:
    random = np.random.default_rng(seed)

    def some(values, rows: int, nulls: float = 0.05, hot: float = 0.33) -> list:
        """Random values, of which a third are the first and some are null."""
        values = list(values)
        picked = [values[i] for i in random.integers(0, len(values), rows)]
        dice = random.random(rows)
        return [
            values[0] if d < hot else None if d > 1 - nulls else v for v, d in zip(picked, dice)
        ]

    def cents(rows: int, low: int, high: int, nulls: float = 0.05) -> list:
        amounts = random.integers(low, high, rows) / 100
        return [None if d < nulls else float(a) for a, d in zip(amounts, random.random(rows))]

    def times(rows: int, seconds: int, step: int) -> list:
        start = datetime(1996, 6, 1) if step == 86400 else datetime(2024, 3, 9, 20)
        return [
            start + timedelta(seconds=int(s) // step * step)
            for s in random.integers(0, seconds, rows)
        ]

    def save(name: str, **columns) -> None:
        arrays, names = [], []
        for key, values in columns.items():
            column, kind = key.rsplit("__", 1)
            kind = pa.timestamp("us") if kind == "t" else TYPES[kind]
            names.append(column)
            arrays.append(pa.array(values, kind))
        pq.write_table(pa.table(arrays, names), f"{folder}/{name}.parquet")

    def names(prefix: str, rows: int) -> list:
        return [f"{prefix} {i}" for i in range(rows)]

    save("region", r_regionkey__i=[0, 1, 2], r_name__s=["A", None, "C"])
    save(
        "nation",
        n_nationkey__i=range(6),
        n_name__s=["n0", "n1", None, "n3", "n4", "n5"],
        n_regionkey__i=[0, 0, 1, 1, 2, 9],
    )
    save(
        "customer",
        c_custkey__l=range(60),
        c_name__s=names("customer", 60),
        c_nationkey__i=some(range(8), 60),
        c_acctbal__d=cents(60, -99999, 999999),
        c_mktsegment__s=some(["x", "y"], 60),
    )
    save(
        "supplier",
        s_suppkey__l=range(12),
        s_name__s=names("supplier", 12),
        s_nationkey__i=some(range(8), 12),
        s_acctbal__d=cents(12, 0, 999999),
    )
    save(
        "part",
        p_partkey__l=range(30),
        p_name__s=some(["bolt", "nut"], 30),
        p_brand__s=some(["b1", "b2", "b3"], 30),
        p_type__s=some(["t"], 30),
        p_size__i=some(range(9), 30),
        p_retailprice__d=cents(30, 0, 99999),
    )
    save(
        "orders",
        o_orderkey__l=range(400),
        o_custkey__l=some(range(70), 400),
        o_orderstatus__s=some("FOP", 400),
        o_totalprice__d=cents(400, 0, 500),
        o_orderdate__t=times(400, 2 * 365 * 86400, 86400),
        o_orderpriority__s=some(["1", "2"], 400),
    )
    save(
        "lineitem",
        l_orderkey__l=some(range(200, 450), 2000),
        l_partkey__l=some(range(35), 2000),
        l_suppkey__l=some(range(14), 2000),
        l_linenumber__i=some(range(3), 2000),
        l_quantity__d=cents(2000, 0, 5000),
        l_extendedprice__d=cents(2000, 0, 10_500_000),
        l_discount__d=cents(2000, 0, 11),
        l_tax__d=cents(2000, 0, 9),
        l_returnflag__s=some("NAR", 2000),
        l_linestatus__s=some("FO", 2000),
        l_shipdate__t=times(2000, 3 * 365 * 86400, 86400),
    )
    save(
        "events",
        event_id__l=random.permutation(3000),
        ts__t=times(3000, 40 * 3600, 60),
        user_id__l=some(range(40), 3000),
        event_type__s=some(["view", "click", "purchase"], 3000),
        value__d=cents(3000, -500, 50_000),
        props__s=some(PROPS, 3000),
    )
    return str(folder)


@pytest.fixture(scope="module", params=[1, 2])
def folder(request, tmp_path_factory):
    return make(tmp_path_factory.mktemp("awkward"), request.param)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, folder, name):
    expected = duckdb_tables(folder).sql(SQL[name]).to_arrow_table()
    assert expected.num_rows > 0
    assert_same(QUERIES[name](spark, folder).toArrow(), expected)
